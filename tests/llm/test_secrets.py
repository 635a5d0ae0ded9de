import hashlib
import json
import time
from base64 import urlsafe_b64encode

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkrank.llm import queries, secrets

PIECES = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "=", ":", " ", "'", '"', "x", "é", "😀", "\n", "ſecret", "aaaaaaaa", "Ｋ", "toKen"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=25).map("".join)


def base(text):
    raw = text.encode()
    spans = secrets.code_points(raw, secrets.find(raw, secrets.automaton()))
    return [f"{k}:{a}:{b}" for a, b, k in spans if k in secrets.BASE]


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_base_by_brute_force(text):
    assert base(text) == brute.secrets(text)


def test_checksums_decide():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = f"ghp_{body}{secrets.base62_crc32(body)}"
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    header = urlsafe_b64encode(json.dumps({"alg": "none"}).encode()).decode().rstrip("=")
    text = f"{good} {bad} npm_{body}{secrets.base62_crc32(body)} {header}.eyJ9.sig eyJub3Q.eyJ9.sig -----BEGIN RSA PRIVATE KEY-----\nMII\n-----END RSA PRIVATE KEY-----"
    found = [k for _, _, k in secrets.find(text.encode(), secrets.automaton())]
    assert found == ["github", "npm", "jwt", "pem"]


def test_whole_table_by_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op6_secret_scan(spark, sf_dir).collect():
        expected = brute.secrets(texts[r["doc_id"]])
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if x.split(":")[0] in secrets.BASE] == expected
        assert spans == brute.all_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in expected) for k in secrets.BASE)


def test_redaction_leaves_no_secret(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for r in clean.collect():
        assert not brute.secrets(r["text"])
        old = before[r["doc_id"]]
        if not brute.secrets(old["text"]):
            assert r == old
        else:
            assert r["n_chars"] == len(r["text"]) and "[REDACTED]" in r["text"]


BODY = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
HEAD = urlsafe_b64encode(json.dumps({"alg": "none"}).encode()).decode().rstrip("=")
MARKS = ["-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "MIIB\n", "é", "!", " ", "-", "A ", "-----BEGIN ", "-----"]
TOKENS = [f"ghp_{BODY}{secrets.base62_crc32(BODY)}", f"npm_{BODY}{secrets.base62_crc32(BODY)}", f"gho_{BODY}000000", HEAD, ".eyJ9", ".sig", "eyJ", ".", "x", "_", "eyJub3Q", " ", "eyj", "EYJ", "keyJWT-", "keyjson_"]


@settings(max_examples=500, deadline=None)
@given((st.lists(st.sampled_from(MARKS), max_size=20) | st.lists(st.sampled_from(TOKENS), max_size=12)).map("".join))
def test_added_kinds_by_brute_force(text):
    raw = text.encode()
    found = secrets.code_points(raw, secrets.find(raw, secrets.automaton()))
    assert [f"{k}:{a}:{b}" for a, b, k in found] == brute.all_secrets(text)


def test_tokens_behind_other_marks():
    token = f"{HEAD}.eyJ9.sig"
    for before in ("keyjson_", "keyJWT-", "EYJ", "eyJ", "eyJub3Q.", "x.eyJub3Q.eyJub3Q ", "eyJhbGciOiJub25lIg."):
        raw = f"{before}{token} {token}".encode()
        assert [raw[a:b].decode() for a, b, k in secrets.find(raw, secrets.automaton()) if k == "jwt"] == [token, token], before
    long = urlsafe_b64encode(json.dumps({"alg": "none", "x": "y" * 4000}).encode()).decode().rstrip("=")
    assert not secrets.find(f"{long}.eyJ9.sig".encode(), secrets.automaton())


def test_hostile_token_runs_end():
    deep = urlsafe_b64encode(b'{"a":' * 900).decode().rstrip("=")
    for run in ("eyJ" * 300_000 + ".eyJa.b", ("eyJ" * 1300 + ".eyJa.b ") * 100, "eyJ" * 1000 + (".eyJ" + "eyJ" * 300) * 300, (deep + ".eyJa.b ") * 100):
        began = time.perf_counter()
        secrets.find(run.encode(), secrets.automaton())
        assert time.perf_counter() - began < 10


@pytest.mark.parametrize("unit", ["eyJ", "-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN A ", "eyJa.", "eyJa.eyJb", "password ", "token=", "AKIA", "ghp_", "deadbeef" * 3 + " ", "A " * 20 + "-----BEGIN "])
def test_hostile_texts_end(unit):
    raw = (unit * (1_000_000 // len(unit))).encode()
    began = time.perf_counter()
    secrets.find(raw, secrets.automaton())
    assert time.perf_counter() - began < 10


def test_hostile_blocks_of_many_kinds_end():
    names = ["".join(chr(65 + k // 26**i % 26) for i in range(4)) for k in range(20_000)]
    raw = "".join(f"-----BEGIN {n} PRIVATE KEY-----\n" for n in names).encode()
    began = time.perf_counter()
    assert not secrets.find(raw, secrets.automaton())
    assert time.perf_counter() - began < 10
