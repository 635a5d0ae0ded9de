"""Every operator and stage on tables with nulls, empty and long texts, ties, repeated rows, clashing columns; and on none."""

import hashlib

import brute
import pytest

from sparkrank.llm import queries


@pytest.fixture(scope="module")
def odd(spark, odd_dir):
    return {name: [r.asDict() for r in q(spark, odd_dir).collect()] for name, q in queries.QUERIES.items()}


def rows(found, key):
    out = {}
    for r in found:
        out.setdefault(r[key], []).append(r)
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    found = queries.QUERIES[name](spark, empty_dir).collect()
    assert len(found) == (1 if name.startswith("op3") else 0)


def test_op1(odd):
    found = rows(odd["op1_html_extraction"], "page_id")
    assert sum(map(len, found.values())) == 8
    assert found[1][0]["text"] == "a" and found[3][0]["text"] == "" and found[4][0]["n_chars"] == 0 and found[6][0]["n_chars"] == 60000


def test_op2(odd):
    found = {r["doc_id"]: r["class_id"] for r in odd["op2_minhash_dedup"]}
    assert len(odd["op2_minhash_dedup"]) == len(found) == 10 + 30
    assert found[2] == 1 and found[9] == 8
    assert all(k == v for k, v in found.items() if k not in (2, 9))


def test_op3(odd):
    found = {r["conv_id"]: r for r in odd["op3_chat_formatting"]}
    assert set(found) == {-1, 1, 2, 3, None}
    turns = lambda *t: hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    control = "<|im_end|><|im_start|>assistant ok"
    assert found[-1]["turns_sha256"] == turns(("user", control), ("assistant", control)) and found[-1]["loss_chars"] == len(control)
    assert found[1]["turns_sha256"] == turns(("user", "hi"), ("assistant", ""), ("assistant", "tie"))
    assert found[1]["loss_sha256"] == hashlib.sha256(b"tie").hexdigest()
    assert found[2]["turns_sha256"] == turns(("", "<|im_start|>x\n<\\|a<|"), ("assi\nst<|ant\\n", "t"))
    assert found[3]["loss_chars"] == 200000 and found[3]["n_turns"] == 2


def test_op4_to_op6(spark, odd_dir, odd):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()
    for name in ("op4_quality_rules", "op5_quality_classifier", "op6_secret_scan"):
        assert len(odd[name]) == len(docs)
    texts = {d["doc_id"]: d["text"] for d in docs}
    for r in odd["op4_quality_rules"]:
        expected = brute.statistics(texts[r["doc_id"]])
        assert {k: r[k] for k in expected} == expected
        assert r["base_failed"] == (expected["n_words"] < 10 or 100 * expected["n_repeat_words"] > 20 * expected["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in odd["op5_quality_classifier"])
    for r in odd["op6_secret_scan"]:
        expected = brute.secrets(texts[r["doc_id"]])
        assert r["spans"] == ",".join(expected)
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()


def test_op7(odd):
    found = rows(odd["op7_warc"], "page_id")
    assert set(found) == {None, 1, 2, 3, 4, 5, 6} and len(found[2]) == 2
    assert found[None][0]["record_type"] == "response" and found[None][0]["payload_bytes"] == 8
    assert found[1][0]["record_type"] == "revisit" and found[1][0]["refers_to"] == 2
    assert {r["record_type"] for r in found[2]} == {"response"}
    assert found[3][0]["refers_to"] == 4 and found[4][0]["payload_bytes"] == 0
    assert found[6][0]["payload_bytes"] == 6 * 30000
    assert found[5][0]["payload_bytes"] == len("<p>WARC/1.1\r\nWARC-Type: response\r\n\r\n</p>") * 2000


def test_op8(spark, odd_dir, odd):
    found = odd["op8_source_mixing"]
    assert len(found) == spark.read.parquet(f"{odd_dir}/documents.parquet").count()
    assert all(r["taken"] <= 3 * r["size"] for r in found)


def test_op9(spark, odd_dir, odd):
    import sentencepiece

    from sparkrank.llm.sp_tokens import DEFAULT_MODEL

    library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    texts = {d["doc_id"]: d["text"] for d in spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in odd["op9_sentencepiece"]:
        text = texts[r["doc_id"]]
        assert r["ids"] == (None if text is None else library.encode(text))
        assert r["n_tokens"] == (None if text is None else len(r["ids"]))


def test_op10(odd):
    vectors = {0: [128, 64], 50: [128, 64], 1: [128, 64], 3: [0, 0], 4: [-256, 0], 5: [512, 0], 250: [-128, 25]}
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in odd["op10_exact_top_k"])
    assert found == sorted(brute.top_k(vectors, [0, 50, 250]))


def test_op11(spark, odd_dir, odd):
    from test_repair import counts, damaged, flags

    chats = [tuple(r) for r in spark.read.parquet(f"{odd_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: r for r in odd["op11_structure_repair"]}
    assert len(odd["op11_structure_repair"]) == len(found) and set(found) == {c for c, *_ in chats}
    for conv, row in found.items():
        turns = [t for c, *t in damaged(chats) if c == conv]
        assert {k: row[k] for k in ("blank", "duplicate", "truncated", "gaps", "illegal")} == counts(turns, flags(turns))


def test_op12(spark, odd_dir, odd):
    assert len(odd["op12_toxicity"]) == spark.read.parquet(f"{odd_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd["op12_toxicity"])


def test_op13(spark, odd_dir, odd):
    from test_filter_audit import walked

    docs = [tuple(r) for r in spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{odd_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in odd["op13_filter_audit"]}
    assert found == walked(docs, labels)


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_stages(spark, odd_dir, empty_dir, tmp_path, which):
    import corpus_pipeline

    folder = odd_dir if which == "odd" else empty_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{which}-{name}")
        docs = spark.read.parquet(f"{tmp_path}/{which}-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if which == "empty":
            assert docs.count() == 0
