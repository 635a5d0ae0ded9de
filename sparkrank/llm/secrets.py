"""Secret scans: an Aho-Corasick pass finds keywords, anchored patterns run only there, checksums confirm.

Texts are scanned whole (null: empty) as their UTF-8 bytes, so only ASCII letters fold their case; offsets are
code points, ends exclusive. Base kinds, leftmost and non-overlapping within their kind: assign, access and hex;
a match that fails its length rule is dropped but has used up its text. Further kinds need more than a
pattern: github, npm and similar tokens carry a CRC-32 in base 62, jwt a header of at most JWT_HEADER characters that decodes to JSON
with an algorithm, wherever in a run of its characters it begins, and pem a closed private key block. Keywords can't announce hex runs, so their pattern reads the whole
text. No part of a text is walked more than a few times, whatever it holds. Rows are scanned one by one: repeated
rows give equal results.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, passes

#: The keywords, patterns and least lengths of the kinds.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "api_key": "assign",
    "apikey": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT_PART = re.compile(r"[0-9A-Za-z_-]++")
JWT_REST = re.compile(r"\.eyJ[0-9A-Za-z_-]++\.[0-9A-Za-z_-]++")
#: Characters of a token's header at most.
JWT_HEADER = 4096
PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z]++ )*?PRIVATE KEY)-----")
PEM_END = re.compile(r"-----END ((?:[A-Z]++ )*?PRIVATE KEY)-----")
PEM_BODY = re.compile(r"[0-9A-Za-z+/=\s:,-]*+")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "pem"]
BASE = KINDS[:3]


def base62_crc32(body: str) -> str:
    value, out = zlib.crc32(body.encode("latin-1")), ""
    while value:
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out.rjust(6, "0")


def _checksum(m: re.Match) -> bool:
    return base62_crc32(m[1]) == m[2]


def _header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


RULES: dict[str, tuple[re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 16),
    "github": (GITHUB, _checksum),
    "npm": (NPM, _checksum),
}


class _Tokens:
    """JSON web tokens of a text. Starts come in order; a run of token characters and what follows it are walked once."""

    def __init__(self, text: str) -> None:
        self.text, self.run, self.rest = text, 0, None

    def end(self, start: int) -> int | None:
        """Where the token whose header begins at `start` ends. The header may begin within a run: every place that could be one comes."""
        if not self.text.startswith("eyJ", start):
            return None
        if start >= self.run:
            self.run = JWT_PART.match(self.text, start).end()
            self.rest = JWT_REST.match(self.text, self.run)
        if self.rest and self.run - start <= JWT_HEADER and _header(self.text[start : self.run]):
            return self.rest.end()
        return None


class _Blocks:
    """Private key blocks of a text: a begin mark, characters of a body only, and the first end mark of the same kind."""

    def __init__(self, text: str) -> None:
        self.text, self.ends, self.body = text, None, 0

    def end(self, start: int) -> int | None:
        """Where the block that begins at `start` ends. Starts come in order, so each body is walked once."""
        m = PEM_BEGIN.match(self.text, start)
        if not m:
            return None
        if self.ends is None:
            self.ends = defaultdict(list)
            for e in PEM_END.finditer(self.text):
                self.ends[e[1]].append(e.start())
        if m.end() > self.body:
            self.body = PEM_BODY.match(self.text, m.end()).end()
        ends = self.ends.get(m[1], [])
        k = bisect_left(ends, m.end())
        return ends[k] + len(m[0]) - 2 if k < len(ends) and ends[k] <= self.body else None


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def find(raw: bytes, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Spans in bytes, by start, then kind as listed in KINDS."""
    text = raw.decode("latin-1")
    spans, free, ends = [], dict.fromkeys(KINDS, 0), {"pem": _Blocks(text), "jwt": _Tokens(text)}
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in words.iter(raw.lower().decode("latin-1")))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind in ends:
            if end := ends[kind].end(start):
                free[kind] = end
                spans.append((start, end, kind))
            continue
        pattern, holds = RULES[kind]
        if m := pattern.match(text, start):
            free[kind] = m.end()
            if holds(m):
                spans.append((start, m.end(), kind))
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def code_points(raw: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The same spans counted in code points."""
    if not spans or raw.isascii():
        return spans
    heads = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(heads[a]), int(heads[b]), kind) for a, b, kind in spans]


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, a row per row of docs."""
    kind_of_id = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, out = automaton(), []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            spans = code_points(raw, find(raw, words))
            base = [s for s in spans if s[2] in BASE]
            out.append((*[sum(s[2] == k for s in base) for k in BASE], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
        columns = list(zip(*out, strict=True))
        return pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], *[pa.array(c, pa.string()) for c in columns[3:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_texts(docs, ["doc_id", "text"], "text", run, f"doc_id {kind_of_id}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs, all rows and columns, with every secret in `text` replaced by `mark`; n_chars follows a changed text."""
    names = docs.columns

    def clean(text: str | None, words: ahocorasick.Automaton) -> str | None:
        if not text:
            return text
        raw = text.encode()
        parts, at = [], 0
        for a, b, _ in find(raw, words):
            if a >= at:
                parts += [raw[at:a], mark.encode()]
            at = max(at, b)
        return b"".join([*parts, raw[at:]]).decode() if parts else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in passes(batches, "text"):
            texts = [clean(t, words) for t in batch.column("text").to_pylist()]
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    if "n_chars" not in names:
        return docs.mapInArrow(run, docs.schema)
    before = docs.withColumn("n_chars", F.struct(F.col("n_chars").alias("said"), F.length("text").alias("was")))
    kind = dict(docs.dtypes)["n_chars"]
    after = before.mapInArrow(run, before.schema)
    return after.withColumn("n_chars", F.when(F.length("text") == F.col("n_chars.was"), F.col("n_chars.said")).otherwise(F.length("text").cast(kind))).select(*names)
