"""Names: accent-insensitive normalising and similarity."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s   -     　﻿]+"


def _accented() -> tuple[str, str]:
    """Lower-case letters that decompose to a letter of a-z and marks, and those letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and "a" <= base <= "z" and all(0x300 <= ord(m) <= 0x36F for m in marks):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accented()


def normalise(name: Column) -> Column:
    """Lower case, no accents, only letters a-z, digits and single spaces. Letters without a decomposition go."""
    trimmed = F.trim(F.regexp_replace(F.lower(name), SPACES, " "))
    plain = F.regexp_replace(F.translate(trimmed, ACCENTED, PLAIN), "[^a-z0-9 ]", "")
    return F.regexp_replace(plain, " +", " ")


def similarity(query: Column, name: Column) -> Column:
    """0 to 100 of normalised strings: equal, contained, shared words, else closeness by edits when over 20."""
    asked = F.split(query, " ")
    words = F.split(name, " ")
    shared = F.size(F.filter(asked, lambda w: F.exists(words, lambda n: F.contains(n, w))))
    longest = F.greatest(F.length(query), F.length(name))
    edits = (longest - F.levenshtein(query, name)) / longest * F.lit(40.0)
    by_words = shared / F.size(asked) * F.lit(60.0)
    return F.when(name == query, 100.0).when(F.contains(name, query), 80.0).when(shared > 0, by_words).when(edits > 20, edits).otherwise(0.0)
