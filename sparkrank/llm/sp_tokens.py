"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read field by field: pieces with scores and types, the trainer's model type and byte
fallback, and the normaliser's character map and white space rules. A unigram model keeps its scores; a BPE
model gets the merges that its scores stand for: every way to split a piece into two pieces, best scores first.
White space becomes the marker U+2581, with one in front of the text where the model wants it. Where no piece holds a
marker after another character, no merge crosses from a word to a following marker, so texts are cut there before merging,
which changes nothing but time.

Batches are encoded by several threads. Every text is checked twice: decoding its ids must give the text that the
normaliser made of it (`round_trip`), and its ids must be those that the sentencepiece library finds for the whole text
(`parity`). The ids are the backend's in any case; a false `parity` reports that the library's differ. Null texts have null ids and checks, empty ones no
ids. Special strings in a text are plain text.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import passes, texts_of
from .textscan import Scan, bytes_of, prefixes

MARK = "▁"
#: Piece types and model types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words whose ids a worker keeps; beyond, it begins anew.
MOST_WORDS = 250_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message: integers, or bytes of any other kind."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> "Model":
        m = cls()
        for number, value in fields(raw):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
                m.pieces.append(piece[1].decode())
                m.scores.append(struct.unpack("<f", piece[2])[0])
                m.types.append(piece[3])
            elif number == 2:
                trainer = dict(fields(value))
                m.kind, m.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                rules = {2: b"", 3: 1, 4: 1, 5: 1} | dict(fields(value))
                m.charsmap, m.dummy_prefix, m.squeeze, m.escape = rules[2], bool(rules[3]), bool(rules[4]), bool(rules[5])
        return m

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces in the order in which a BPE model of these scores joins them."""
        usable = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for piece, i in usable.items():
            halves = [(usable[piece[:k]], usable[piece[k:]]) for k in range(1, len(piece)) if piece[:k] in usable and piece[k:] in usable]
            found += [(-self.scores[i], i, a, b) for a, b in halves]
        return [(self.pieces[a], self.pieces[b]) for _, _, a, b in sorted(found)]

    def splits_at_marks(self) -> bool:
        """Whether no merge and no run of unknown characters can cross from a word to a following marker."""
        return MARK in self.pieces and not any(MARK in p.lstrip(MARK) for p in self.pieces)


def backend(m: Model):
    """A tokenizers.Tokenizer that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = m.types.index(UNKNOWN)
    if m.kind == BPE:
        core = models.BPE(vocab={p: i for i, p in enumerate(m.pieces)}, merges=m.merges(), unk_token=m.pieces[unknown], fuse_unk=True, byte_fallback=m.byte_fallback)
    elif m.kind == UNIGRAM:
        core = models.Unigram(list(zip(m.pieces, m.scores, strict=True)), unknown, m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    t = Tokenizer(core)
    rules = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        rules += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        rules.append(normalizers.Prepend(" "))
    if m.escape:
        rules.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(rules)
    if m.escape and m.splits_at_marks():
        t.pre_tokenizer = pre_tokenizers.Split(Regex(WORD.pattern), "isolated")
    steps = [decoders.Replace(MARK, " ")] if m.escape else []
    t.decoder = decoders.Sequence([*steps, decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all entries of the named runs, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Encoder:
    """The backend and the reference library's processor, once for each worker process.

    Where a text needs no other normalising than markers and can be cut at them, the words of a pass are told apart by
    hashes, and only those that aren't known yet go to the backend, all at once; a word's ids are the same wherever it
    stands. A wrong id, were two words to share a hash, would fail the round trip.
    """

    def __init__(self, raw: bytes, threads: int) -> None:
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece

        self.model, self.threads = Model.parse(raw), threads
        m = self.model
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.tokenizer = backend(m)
        self.tokenizer.encode_special_tokens = True
        self.by_word = not m.charsmap and not m.squeeze and m.escape and m.splits_at_marks()
        if self.by_word:
            self.words = backend(m)
            self.words.encode_special_tokens = True
            self.words.pre_tokenizer = self.words.normalizer = None
        as_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.types, strict=True)]
        self.piece_sizes = np.array([len(b) for b in as_bytes])
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(as_bytes), np.uint8)
        self._forget()

    def _forget(self) -> None:
        """Known words: sorted hashes, and for each the place of its ids in `flat`, which grows by doubling."""
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        texts = [w.decode().replace(" ", MARK) for w in words]
        ids = [e.ids for e in self.words.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int64)
        end = self.used + int(sizes.sum())
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * end - self.used, np.int32)])
        self.flat[self.used : end] = np.fromiter((i for x in ids for i in x), np.int32, end - self.used)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.used = end

    def normalised(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and bounds of the texts as the normaliser leaves them, with spaces in place of markers."""
        spaced = pc.replace_substring(texts_of(texts), MARK, " ")
        if self.model.dummy_prefix:
            none, space = (pa.scalar(x, pa.large_utf8()) for x in ("", " "))
            spaced = pc.if_else(pc.equal(spaced, none), none, pc.binary_join_element_wise(none, spaced, space))
        return bytes_of(spaced)

    def _by_word(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A word begins where a text does and at a space that follows none."""
        if len(self.hashes) > MOST_WORDS:
            self._forget()
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        words = Scan(data, bounds, starts, ends, np.zeros(0, np.int64), prefixes(data)).hashes(starts, ends)
        distinct, first, which = np.unique(words, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(distinct[new], [data[a:b].tobytes() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        sizes = self.sizes[at][which]
        flat = self.flat[ragged(self.starts[at][which], sizes)]
        return flat, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, bounds)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the bounds of each text's, and whether they decode to the text as the normaliser leaves it."""
        if not self.by_word:
            plain = texts_of(texts).to_pylist()
            found = [e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
            whole = [b == self.library.decode(self.library.encode(x)) for b, x in zip(back, plain, strict=True)]
            return np.fromiter((i for x in found for i in x), np.int32, int(bounds[-1])), bounds, np.array(whole, bool)
        data, cuts = self.normalised(texts)
        flat, bounds = self._by_word(data, cuts)
        sizes = self.piece_sizes[flat]
        decoded = self.piece_bytes[ragged(self.piece_starts[flat], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        if np.array_equal(ends, cuts) and np.array_equal(decoded, data):
            return flat, bounds, np.ones(len(texts), bool)
        return flat, bounds, np.array([np.array_equal(decoded[ends[k] : ends[k + 1]], data[cuts[k] : cuts[k + 1]]) for k in range(len(texts))], bool)


@lru_cache(maxsize=2)
def loaded(raw: bytes, threads: int) -> Encoder:
    return Encoder(raw, threads)


def encode_texts(texts: pa.Array, raw: bytes, threads: int = 2) -> tuple[pa.Array, pa.Array, pa.Array]:
    """ids, parity and round trip of each text."""
    encoder = loaded(raw, threads)
    flat, bounds, whole = encoder.encode(texts)
    plain = texts_of(texts).to_pylist()
    expected = encoder.library.encode(plain, num_threads=threads) if plain else []
    parity = np.array([ids == flat[bounds[k] : bounds[k + 1]].tolist() for k, ids in enumerate(expected)], bool)
    missing = texts.is_null()
    ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)), mask=missing)
    null = missing.to_numpy(zero_copy_only=False)
    return ids, pa.array(parity, mask=null), pa.array(whole, mask=null)


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, threads: int = 2, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id by default), n_tokens, ids, parity and round_trip, a row per row of docs.

    The model's bytes are read here and broadcast: half a megabyte, whatever the data.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = keep or ["doc_id"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text"):
            ids, parity, whole = encode_texts(batch.column("text"), model.value, threads)
            yield pa.record_batch([*[batch.column(c) for c in keep], pc.list_value_length(ids).cast(pa.int64()), ids, parity, whole], names=[*keep, "n_tokens", "ids", "parity", "round_trip"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n_tokens long, ids array<int>, parity boolean, round_trip boolean"])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str = DEFAULT_MODEL, threads: int = 2) -> DataFrame:
    """tokens with `ids` decoded to `text`; null ids give a null text."""
    with open(model_path, "rb") as f:
        model = tokens.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in tokens.columns if c != "text"]
    rows = tokens.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(model.value, threads).tokenizer
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = part.column("ids").to_pylist()
                texts = t.decode_batch([x or [] for x in ids], skip_special_tokens=False)
                yield pa.record_batch([*part.columns, pa.array([None if i is None else x for i, x in zip(ids, texts, strict=True)], pa.string())], names=[*names, "text"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", text string")
