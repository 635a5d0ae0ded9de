import base64
import hashlib

import pytest

from sparkrank.llm import warc


def test_framing_round_trip():
    for payload in (b"", b"x", "é😀".encode() * 5000, b"WARC/1.1\r\n" * 3000, b"aWARC/1.1" * 7, b"0\r\n\r\n"):
        message = b"HTTP/1.1 200 OK\r\n\r\n" + warc.framed(payload, 100)
        assert warc.unframed(message) == payload
        assert b"WARC/1.1" not in message[19:]


def read(spark, tmp_path, rows, segment_bytes=500):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, segment_bytes)
    return path, {r["page_id"]: r for r in warc.read_archives(warc.archive_lines(spark, path)).collect()}


def test_segments_are_put_together(spark, tmp_path):
    texts = {1: "short", 2: "ä" * 3000, 3: "WARC/1.1\r\n" * 400, 4: "ä" * 3000, 5: "ä" * 3000, 6: None}
    path, found = read(spark, tmp_path, [(k, f"http://x/{k}", t) for k, t in texts.items()])
    for k, t in texts.items():
        payload = (t or "").encode()
        assert found[k]["payload_bytes"] == len(payload)
        assert found[k]["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert [found[k]["refers_to"] for k in (2, 4, 5)] == [5, 5, None]
    kinds = [r["type"] for r in warc.read_records(warc.archive_lines(spark, path)).collect()]
    assert kinds.count("continuation") > 10 and kinds.count("revisit") == 2


def test_a_lost_segment_is_told(spark, tmp_path):
    path, _ = read(spark, tmp_path, [(1, "u", "text " * 2000)])
    lines = warc.archive_lines(spark, path)
    with pytest.raises(Exception, match="segments"):
        warc.read_archives(lines.where("value NOT LIKE '%WARC-Segment-Number: 2%'")).collect()


def test_repeated_rows_come_back_as_often(spark, tmp_path):
    rows = [(1, "u", "text " * 2000)] * 3 + [(1, "u", "other " * 2000), (2, "u", "x"), (2, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "r"), 500)
    found = warc.read_archives(warc.archive_lines(spark, str(tmp_path / "r"))).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in found) == [(1, 10000)] * 3 + [(1, 12000)] + [(2, 1)] * 2


def test_a_common_payload_and_null_ids_come_back_whole(spark, tmp_path):
    rows = [(k if k % 5 else None, f"u{k}", "same") for k in range(300)] + [(None, "a", "alone"), (None, "b", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    found = warc.read_archives(warc.archive_lines(spark, path)).collect()
    assert len(found) == len(rows)
    same = [r for r in found if r["payload_bytes"] == 4]
    assert [r["page_id"] for r in same if r["record_type"] == "response"] == [299]
    assert all(r["refers_to"] == 299 for r in same if r["page_id"] != 299)
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in found if r["payload_bytes"] == 5] == [(None, "response", None)] * 2
