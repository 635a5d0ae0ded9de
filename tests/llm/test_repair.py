"""Structure repair against every possible list of edits, and against its definition on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkrank.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")
BLANKS = "\t\n\x0b\x0c\r "


def damaged(rows):
    """Rows of (conv, turn, role, text) after the damage."""
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        fault = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def flags(turns):
    """Sorted turns of one conversation as (role, text, fault)."""
    seen, out = set(), []
    for _, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())):
        solid = text.strip(BLANKS)
        out.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def all_edits(turns):
    """The best (cost, audit, repaired) of every list of edits with at most two insertions in a row."""
    gaps = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    edits = [[("D", None, 4)] + ([] if fault in ("blank", "duplicate") else [("K", role, 3 * (fault == "truncated"))] + [("R", r, 3 + 3 * (fault == "truncated")) for r in ("user", "assistant")]) for role, _, fault in turns]
    for chosen in itertools.product(*edits):
        for inserted in itertools.product(gaps, repeat=len(turns) + 1):
            said = [(r, "") for r in inserted[0]]
            audit, cost = "I" * len(inserted[0]), 3 * len(inserted[0])
            for (letter, role, price), (_, text, _), gap in zip(chosen, turns, inserted[1:]):
                said += [(role, text)] if role is not None else []
                said += [(r, "") for r in gap]
                audit, cost = audit + letter + "I" * len(gap), cost + price + 3 * len(gap)
            if all(r for r, _ in said) and LEGAL.match("".join(r[0] for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
    return best


def counts(turns, flagged):
    numbers = {t for t, _, _ in turns if t is not None}
    initials = [role[:1] for role, _, _ in flagged]
    out = {k: sum(f == k for _, _, f in flagged) for k in ("blank", "duplicate", "truncated")}
    return out | {"gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))}


def conversations(seed, n, most):
    r = random.Random(seed)
    for conv in range(n):
        for _ in range(r.randint(1, most)):
            yield conv, r.choice([None, 0, 1, 2, 3, 5, 9]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(["a.", "b?", "c", "d!\n", " \t", "", None, "é", "é."])


def found_for(spark, rows, block=256, broken=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r["conv_id"]: r for r in repair.repair((repair.damage if broken else repair.as_rows)(df), block).collect()}


@pytest.fixture(scope="module")
def small():
    return list(conversations(1, 60, 3))


@pytest.mark.parametrize("block", [1, 2, 256])
def test_equals_every_list_of_edits(spark, small, block):
    found = found_for(spark, small, block)
    for conv in {c for c, *_ in small}:
        turns = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in small if c == conv]
        flagged = flags(turns)
        cost, audit, said = all_edits(flagged)
        row = found[conv]
        assert (row["cost"], row["audit"]) == (cost, audit), flagged
        assert [(t["role"], t["text"]) for t in row["repaired"]] == said
        assert {k: row[k] for k in ("blank", "duplicate", "truncated", "gaps", "illegal")} == counts(turns, flagged)


def test_blocks_change_nothing(spark):
    rows = [(c, i, r, x) for c in range(4) for i, (_, _, r, x) in enumerate(list(conversations(7 + c, 400, 1)))]
    whole, cut = found_for(spark, rows, 10_000), found_for(spark, rows, 7)
    assert whole == cut and all(len(re.sub("I", "", r["audit"])) == 400 for r in whole.values())


def test_damage_is_by_checksum(spark):
    rows = list(conversations(3, 200, 6)) + [(None, None, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copy", F.lit(1))
    got = repair.damage(df)
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted([tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in got.where("not gone").collect()], key=key) == sorted(damaged(rows), key=key)
    assert {r[0] for r in got.select("conv_id").distinct().collect()} == {c for c, *_ in rows}


def test_conversation_that_loses_all_turns(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, turn, "user", "hi.")], "conv_id long, turn long, role string, text string")
    (row,) = repair.digests(repair.repair(repair.damage(df))).collect()
    assert row["cost"] == row["gaps"] == row["illegal"] == 0 and row["audit"] == "" and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_far_turn_numbers(spark):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, 5, "user", "a."), (2, 2**62, "assistant", "b.")]
    found = found_for(spark, rows)
    assert found[1]["gaps"] is None and found[2]["gaps"] == 2**62 - 5 + 1 - 2


def test_digest_joins_lines(spark):
    df = spark.createDataFrame([(1, 0, "user", "a\nb."), (1, 1, "user", "c.")], "conv_id long, turn long, role string, text string")
    (row,) = repair.digests(repair.repair(repair.as_rows(df))).collect()
    assert (row["cost"], row["audit"]) == (3, "KR")
    assert row["repaired_sha256"] == hashlib.sha256("user:a\nb.\nassistant:c.".encode()).hexdigest()
