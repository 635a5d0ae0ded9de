import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkrank.llm import chat

PIECES = st.lists(st.sampled_from(["<", "|", "\\", "<|im_start|>", "<|im_end|>", "\n", "a", "é", "😀", "assistant", ">"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=6))
def test_round_trip(turns):
    roles, texts = (pa.array([t[k] for t in turns]) for k in (0, 1))
    data, bounds, _ = chat.assemble(roles, texts)
    raw = data.to_pybytes()
    found = [(chat.unescaped_role(m[1]).decode(), chat.unescaped(m[2]).decode()) for m in chat.TURN.finditer(raw)]
    assert found == turns
    assert raw.count(b"<|im_start|>") == raw.count(b"<|im_end|>") == len(turns)
    assert bounds[-1] == len(raw)


def test_a_conversation_of_many_batches_is_one(spark):
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i} " * 2000) for i in range(700)] + [(2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(rows)
    assert formatted.where("conv_id = 1").count() > 1
    found = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert found[1]["n_turns"] == 700 and found[2]["n_turns"] == 1
    assert found[1]["loss_chars"] == sum(len(f"t{i} " * 2000) for i in range(1, 700, 2))


def test_bytes_that_are_no_turn_are_told():
    reader = chat._Reader(1)
    with pytest.raises(ValueError):
        reader.read(b"<|im_start|>user\nx", [], [])


@pytest.mark.parametrize("kind", ["long", "int", "string"])
@pytest.mark.parametrize("ids", [[None], [None, None, 1], [1, None]])
def test_null_ids_are_a_conversation(spark, kind, ids):
    rows = spark.createDataFrame([(None if i is None else str(i), k, "assistant", f"t{k}") for k, i in enumerate(ids)], "conv_id string, turn long, role string, text string")
    rows = rows.withColumn("conv_id", rows["conv_id"].cast(kind)).coalesce(1)
    found = chat.read_back(chat.format_chats(rows))
    assert dict(found.dtypes)["conv_id"] == dict(rows.dtypes)["conv_id"]
    assert {r["conv_id"]: r["n_turns"] for r in found.collect()} == {i if i is None or kind != "string" else str(i): ids.count(i) for i in ids}


def test_long_texts_are_sliced(monkeypatch):
    roles, texts = pa.array(["user", "assistant", "user"]), pa.array(["é" * 40, "", "<|" * 30])
    whole = chat.assemble(roles, texts)[0].to_pybytes()
    monkeypatch.setattr(chat, "SLICED", 16)
    assert chat.assemble(roles, texts)[0].to_pybytes() == whole
