"""Words, lines and word windows of many texts at once, in numpy over their UTF-8 bytes.

White space is ASCII, so no byte of a multi-byte character is ever taken for it. A substring's
hash comes from prefix sums of a polynomial modulo 2**64 over random byte codes, so one pass
gives the hash of every word and line whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import texts_of

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240611))
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_STEPS = _rng.integers(1, 2**63, 5, dtype=np.uint64) | _U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80
#: Powers of the base and its inverse are products of a near table's entry and a far one's, so a text of any length needs little.
_NEAR = 1 << 16
#: Bytes whose triples are counted at a time.
_SLICE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    table = np.full(n, base, np.uint64)
    table[:1] = 1
    return np.cumprod(table, dtype=np.uint64)


_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = _powers(_BASE, _NEAR), _powers(_INVERSE, _NEAR)
_FAR_UP, _FAR_DOWN = (pow(b, _NEAR, 1 << 64) for b in (_BASE, _INVERSE))


def _power_at(near: np.ndarray, far: int, at: np.ndarray, most: int) -> np.ndarray:
    """Powers for places below `most`."""
    if most <= _NEAR:
        return near[at]
    return near[at & (_NEAR - 1)] * _powers(far, most // _NEAR + 1)[at >> 16]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words after which every bit depends on every other."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@dataclass
class Scan:
    """data: all bytes; bounds: where each text starts, and the end; words by start, end and text."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    prefix: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        down = _power_at(_DOWN, _FAR_DOWN, starts, len(self.data))
        return mix((self.prefix[ends] - self.prefix[starts]) * down + (ends - starts).astype(np.uint64))

    def per_text(self, owner: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, weights, self.n).astype(np.int64)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        out, filled = np.zeros(self.n, np.int64), np.diff(self.bounds) > 0
        if filled.any():
            out[filled] = np.add.reduceat(flags, self.bounds[:-1][filled], dtype=np.int64)
        return out


def prefixes(data: np.ndarray) -> np.ndarray:
    """Prefix sums that give the hash of any run of bytes: see Scan.hashes."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    far = _powers(_FAR_UP, len(data) // _NEAR + 1)
    for k, at in enumerate(range(0, len(data), _NEAR)):
        part = _CODES[data[at : at + _NEAR]] * _UP[: len(data) - at] * far[k]
        part[:1] += prefix[at : at + 1]
        np.cumsum(part, dtype=np.uint64, out=prefix[at + 1 : at + 1 + len(part)])
    return prefix


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each starts, and the end."""
    texts = texts_of(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(bounds[0]), int(bounds[-1])) if len(bounds) else (0, 0)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[first:last] if raw is not None and last > first else np.zeros(0, np.uint8)
    return data, (bounds - first).astype(np.int64)


def scan(texts: pa.Array) -> Scan:
    data, bounds = bytes_of(texts)
    solid = ~_BLANK[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    owner = np.searchsorted(bounds, starts, "right") - 1
    return Scan(data, bounds, starts, ends, owner, prefixes(data))


def windows(s: Scan, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every window of `size` words within one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(s.owner[:n] == s.owner[size - 1 :])
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value += words[k : k + n] * _STEPS[k % len(_STEPS)] * _U(2 * (k // len(_STEPS)) + 1)
    return at, mix(value[at])


def grouped(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order, first: entries by (owner, value) equal ones together in their order; whether each begins a group."""
    key = value ^ mix(owner.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return order, first


def shingles(s: Scan, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, hash and count of the distinct shingles of every text, by text.

    A text of fewer words than `size` (but at least one) is a single shingle.
    """
    words = s.hashes(s.starts, s.ends)
    at, value = windows(s, words, size)
    owner = s.owner[at]
    many = s.per_text(s.owner)
    short = np.flatnonzero((many > 0) & (many < size))
    if len(short):
        small = np.flatnonzero(np.isin(s.owner, short))
        rank = small - np.searchsorted(s.owner, s.owner[small], "left")
        total = np.zeros(s.n, np.uint64)
        np.add.at(total, s.owner[small], words[small] * _STEPS[rank])
        owner, value = np.concatenate([owner, short]), np.concatenate([value, mix(total[short] + many[short].astype(np.uint64))])
    order, first = grouped(owner, value)
    heads = np.flatnonzero(first)
    counts = np.diff(np.append(heads, len(order)))
    pick = order[heads]
    owner, value = owner[pick], value[pick]
    by = np.argsort(owner, kind="stable")
    return owner[by], value[by], counts[by]


def content(s: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words."""
    words = s.hashes(s.starts, s.ends)
    firsts = np.searchsorted(s.owner, np.arange(s.n), "left")
    rank = np.arange(len(words)) - firsts[s.owner] if len(words) else np.zeros(0, np.int64)
    up = _power_at(_UP, _FAR_UP, rank, len(words))
    out = []
    for salt in (0x1234567, 0x89ABCDEF01):
        part = mix(words + _U(salt)) * up
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        lasts = np.searchsorted(s.owner, np.arange(s.n), "right")
        out.append(mix(total[lasts] - total[firsts] + (lasts - firsts).astype(np.uint64)))
    return out[0], out[1]


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Rule statistics per text: see quality_rules for what each name means."""
    s = scan(texts)
    words = s.hashes(s.starts, s.ends)
    heads = _HEAD[s.data]
    out = {"n_words": s.per_text(s.owner), "word_chars": s.sums(heads & ~_BLANK[s.data]), "n_chars": s.sums(heads)}
    del heads
    out["n_symbols"] = s.sums(np.isin(s.data, np.frombuffer(b"#*$%&|<>", np.uint8)))
    out["n_upper"] = s.sums((s.data >= 65) & (s.data <= 90))
    out["n_lower"] = s.sums((s.data >= 97) & (s.data <= 122))
    out["n_digits"] = s.sums((s.data >= 48) & (s.data <= 57))
    out["n_marks"] = s.sums(np.isin(s.data, np.frombuffer(b"!?", np.uint8)))
    # lines
    breaks = np.flatnonzero(s.data == 10)
    starts = np.unique(np.concatenate([s.bounds[:-1][np.diff(s.bounds) > 0], breaks + 1]))
    starts = starts[starts < len(s.data)]
    owner = np.searchsorted(s.bounds, starts, "right") - 1
    at = np.searchsorted(breaks, starts)
    ends = np.minimum(np.append(breaks, len(s.data))[at], s.bounds[owner + 1])
    real = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
    starts, ends, owner = starts[real], ends[real], owner[real]
    order, first = grouped(owner, s.hashes(starts, ends))
    out["n_lines"] = s.per_text(owner)
    out["n_dup_lines"] = s.per_text(owner[order[~first]])
    # words within windows that occur again
    at, value = windows(s, words, 5)
    order, first = grouped(s.owner[at], value)
    again = ~first
    again[:-1] |= ~first[1:]
    step = np.zeros(len(words) + 1, np.int64)
    hit = at[order[again]]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + 5, -1)
    out["n_repeat_words"] = s.per_text(s.owner[np.cumsum(step[:-1]) > 0])
    order, first = grouped(s.owner, words)
    out["n_distinct_words"] = s.per_text(s.owner[order[first]])
    return out


def grams(texts: pa.Array, buckets: int) -> np.ndarray:
    """Shares of a text's lower-case character triples (bytes) and of its words in as many hashed buckets each."""
    s = scan(texts)
    counts = np.zeros((2, s.n * buckets), np.int64)
    for a in range(0, len(s.data) - 2, _SLICE):  # so that a long text's triples take little memory
        b = min(a + _SLICE, len(s.data) - 2)
        first, last = np.searchsorted(s.bounds, [a, b - 1], "right") - 1
        owner = np.repeat(np.arange(first, last + 1), np.diff(np.clip(s.bounds[first : last + 2], a, b)))
        raw = s.data[a : b + 2]
        lower = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint32)
        code = (lower[:-2] << np.uint32(16)) | (lower[1:-1] << np.uint32(8)) | lower[2:]
        code = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(buckets)
        whole = np.arange(a + 2, b + 2) < s.bounds[owner + 1]
        counts[0] += np.bincount((owner * buckets + code)[whole], minlength=s.n * buckets)
    words = s.hashes(s.starts, s.ends) % _U(buckets)
    counts[1] = np.bincount(s.owner * buckets + words.astype(np.int64), minlength=s.n * buckets)
    shares = counts.reshape(2, s.n, buckets).transpose(1, 0, 2)
    return (shares / np.maximum(shares.sum(2, keepdims=True), 1)).reshape(s.n, 2 * buckets)
