import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkrank.llm import queries, sp_tokens

RAW = open(sp_tokens.DEFAULT_MODEL, "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=RAW)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["the", " ", "  ", "▁", "\n", "é", "<s>", "<0x41>", "😀", "ing", "\x00", "x"]), max_size=20).map("".join))
def test_parity_with_the_library(text):
    texts = pa.array(["before", text, None, "after it"])
    ids, parity, whole = sp_tokens.encode_texts(texts, RAW, 1)
    flat, bounds, _ = sp_tokens.loaded(RAW, 1).encode(texts)
    assert flat[bounds[1] : bounds[2]].tolist() == LIBRARY.encode(text)
    assert ids.to_pylist() == [LIBRARY.encode("before"), LIBRARY.encode(text), None, LIBRARY.encode("after it")]
    assert parity.to_pylist() == [True, True, None, True]
    assert whole[1].as_py() == (LIBRARY.decode(LIBRARY.encode(text)).replace("▁", " ") == text.replace("▁", " "))


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(sp_tokens, "MOST_WORDS", 5)
    encoder = sp_tokens.Encoder(RAW, 1)
    for texts in (["one two three four"], ["five six seven", "", "eight  nine"], ["one two", "ten"]) * 2:
        flat, bounds, whole = encoder.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [LIBRARY.encode(t) for t in texts] and whole.all()


def test_backend_alone_has_parity():
    encoder = sp_tokens.loaded(RAW, 1)
    texts = ["", " ", "a  b", "Über die Brücke 😀 <s>", "x" * 300, "\t\n  "]
    assert [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)] == [LIBRARY.encode(t) for t in texts]


def test_model_is_read_as_the_library_reads_it():
    m = sp_tokens.Model.parse(RAW)
    assert len(m.pieces) == LIBRARY.get_piece_size()
    assert all(m.pieces[i] == LIBRARY.id_to_piece(i) and m.scores[i] == pytest.approx(LIBRARY.get_score(i)) for i in range(0, len(m.pieces), 97))


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def entry(number, kind, value):
    return varint(number << 3 | kind) + (varint(value) if kind == 0 else value if kind == 5 else varint(len(value)) + value)


def test_unigram_models_work_too():
    import math
    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -4.0, 1), ("▁ab", -1.5, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -2.0, 1), ("abb", -2.2, 1)]
    raw = b"".join(entry(1, 2, entry(1, 2, p.encode()) + entry(2, 5, struct.pack("<f", s)) + entry(3, 0, t)) for p, s, t in pieces)
    raw += entry(2, 2, entry(3, 0, 1)) + entry(3, 2, entry(1, 2, b"identity") + entry(3, 0, 1) + entry(4, 0, 0) + entry(5, 0, 1))
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert math.isclose(library.get_score(4), -1.5)
    for text in ("ab", "abb ab", "aab bba", "b"):
        ids, parity, _ = sp_tokens.encode_texts(pa.array([text]), raw, 1)
        assert ids.to_pylist()[0] == library.encode(text) and parity.to_pylist() == [True]


def test_whole_table_and_back(spark, sf_dir):
    found = queries.op9_sentencepiece(spark, sf_dir)
    back = {r["doc_id"]: r["text"] for r in sp_tokens.decode(found).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert back == texts
    rows = found.collect()
    assert all(r["round_trip"] for r in rows) and not any(r["parity"] is False for r in rows)
    assert all(r["ids"] == LIBRARY.encode(texts[r["doc_id"]]) for r in rows)


def test_every_text_is_compared(spark, sf_dir):
    rows = queries.op9_sentencepiece(spark, sf_dir).select("parity", "ids").collect()
    assert rows and all(r["parity"] is (None if r["ids"] is None else True) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40) | st.lists(st.sampled_from(["the", " ", "  ", "▁", "\n", "é", "<s>", "<0x41>", "😀", "ing", "\x00", "x"]), max_size=20).map("".join), min_size=1, max_size=5))
def test_words_by_numpy_are_what_the_backend_makes_of_whole_texts(texts):
    """Normaliser, pre-tokenizer, ids and decoder of the rebuilt backend, each on whole texts."""
    encoder = sp_tokens.loaded(RAW, 1)
    data, cuts = encoder.normalised(pa.array(texts))
    normalised = [data[a:b].tobytes().decode().replace(" ", sp_tokens.MARK) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert normalised == [encoder.tokenizer.normalizer.normalize_str(t) for t in texts]
    flat, bounds, whole = encoder.encode(pa.array(texts))
    ids = [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert ids == [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    back = encoder.tokenizer.decode_batch(ids, skip_special_tokens=False)
    assert whole.tolist() == [b == n.replace(sp_tokens.MARK, " ")[1:] for b, n in zip(back, normalised, strict=True)]


def test_ids_that_decode_but_differ_are_reported_in_every_text(monkeypatch):
    texts = [f"the river ran past mill {k}" for k in range(64)]

    def by_character(self, known):
        """Another segmentation of the same texts."""
        found = [[LIBRARY.piece_to_id(c) for c in "▁" + x.replace(" ", "▁")] for x in known.to_pylist()]
        return np.array([i for x in found for i in x], np.int32), np.cumsum([0, *map(len, found)]), np.ones(len(found), bool)

    monkeypatch.setattr(sp_tokens.Encoder, "encode", by_character)
    ids, parity, whole = sp_tokens.encode_texts(pa.array(texts), RAW, 1)
    assert ids.to_pylist() == [[LIBRARY.piece_to_id(c) for c in "▁" + x.replace(" ", "▁")] for x in texts]
    assert parity.to_pylist() == [False] * 64 and all(whole.to_pylist())
