"""WARC archives: writing with segmented and revisit records, and reassembly.

Record ids hold the page_id and the payload's digest, so only rows that repeat both share one; their segments are
equal, and reading gives back as many rows as there are first segments.

Writing: a page whose payload equals that of a page with a larger page_id is a revisit of the one with the largest;
all others are responses (rows that repeat the largest page_id all are, and all where no page_id is known). A response's HTTP message has its payload
in chunked transfer framing and is cut into segments: the first record, then continuation records that name it as
origin, number themselves, and the last of which says the total length. Records are rows of text that Spark's text
writer puts into files, so they reach whatever store the path is in.

Reading: a record begins at the version line, which the writer never lets appear in a block. Continuations are
grouped by origin and ordered by number, the total length is verified, the framing decoded, and length and
digest of the payload compared with the header's. Only segmented responses are shuffled, and a group is one page.
Null html is an empty payload; null urls are left out. A null page_id is an empty field of the record's id, comes back as null, and is
never the one that others refer to.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, dealt, passes

VERSION = "WARC/1.1\r\n"
#: Bytes of an HTTP message that one record holds, and of a payload that one chunk holds, about.
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
RECORD_TAIL = "\r\n\r\n"
FIXED_DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(column: str) -> Column:
    """Base 32 of a 40-digit hex string: 5 hex digits are 4 letters."""
    letter = f"substring('{BASE32}', cast((shiftright(cast(conv(substring({column}, 5 * (i div 4) + 1, 5), 16, 10) as int), 15 - 5 * (i % 4)) & 31) as int) + 1, 1)"
    return F.expr(f"concat_ws('', transform(sequence(0, 31), i -> {letter}))")


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_digest and refers_to (null: a response)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("kept"), F.min("page_id").alias("other"), F.count("page_id").alias("named"), F.count("*").alias("n"))
    again = checkpoint(groups.where("kept <> other or named < n").select("sha1", "kept", "n"))
    total = again.agg(F.sum("n")).first()[0] or 0
    # a common payload's rows are dealt out; its group is an id
    found = dealt(rows, again, ["sha1"], total, F.xxhash64("page_id", "url"), "left")
    return found.select("page_id", "url", "html", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def framed(payload: bytes, most: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. A chunk ends between characters, and within any version mark of the payload."""
    marks = [m.start() + 4 for m in re.finditer(rb"WARC/1\.1", payload)]
    out, at, k = [], 0, 0
    while at < len(payload):
        while k < len(marks) and marks[k] <= at:
            k += 1
        end = min(at + most, len(payload), marks[k] if k < len(marks) else len(payload))
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end += 1
        out.append(b"%x\r\n%s\r\n" % (end - at, payload[at:end]))
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def unframed(message: bytes) -> bytes:
    """The payload of a chunked HTTP message."""
    at = message.index(b"\r\n\r\n") + 4
    parts = []
    while True:
        line = message.index(b"\r\n", at)
        size = int(message[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        if message[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(message[line + 2 : line + 2 + size])
        at = line + 4 + size


def _record(headers: list[tuple[str, str | int | None]], block: bytes) -> str:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", len(block))] if v is not None]
    return VERSION + "\r\n".join(lines) + "\r\n\r\n" + block.decode() + RECORD_TAIL


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[str]:
    url = re.sub(r"[\r\n]", "", url).replace("WARC/1.1", "WARC%2F1.1") if url is not None else None
    def name(k: int | None, n: int = 1) -> str:
        return f"<urn:page:{'' if k is None else k}:{digest}{f':{n}' if n > 1 else ''}>"

    shared = [("WARC-Target-URI", url), ("WARC-Date", FIXED_DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(page_id)), *shared, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to)), ("Content-Type", "application/http; msgtype=response")], block)
        return
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + framed(payload)
    cuts = [0]
    while len(message) - cuts[-1] > segment_bytes:
        end = cuts[-1] + segment_bytes
        while message[end] & 0xC0 == 0x80:
            end -= 1
        cuts.append(end)
    cuts.append(len(message))
    last = len(cuts) - 1
    for n in range(1, last + 1):
        numbered = [("WARC-Segment-Number", n)] if last > 1 else []
        if n > 1:
            numbered += [("WARC-Segment-Origin-ID", name(page_id)), ("WARC-Segment-Total-Length", len(message) if n == last else None)]
        yield _record([("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", name(page_id, n)), *shared, ("Content-Type", "application/http; msgtype=response"), *numbered], message[cuts[n - 1] : cuts[n]])


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes gzipped WARC files to a folder that all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "html"):
            out = []
            for page_id, url, page, sha1, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                # the writer ends each row with the line feed that ends the record
                out += [r[:-1] for r in records_of(page_id, url, page.encode(), digest, refers_to, segment_bytes)]
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    rows = with_roles(pages).select("page_id", "url", "html", "sha1", "refers_to")
    rows.mapInArrow(run, "value string").write.mode("overwrite").option("compression", "gzip").text(path)


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def read_records(df: DataFrame) -> DataFrame:
    """Parsed headers and the block of every record in the lines between version lines."""
    rows = df.where("value <> ''").select(F.substring_index("value", "\r\n\r\n", 1).alias("head"), "value")
    length = F.octet_length("head")
    names = {"type": "WARC-Type", "record": "WARC-Record-ID", "digest": "WARC-Payload-Digest", "refers": "WARC-Refers-To", "number": "WARC-Segment-Number", "origin": "WARC-Segment-Origin-ID", "total": "WARC-Segment-Total-Length", "size": "Content-Length"}
    parsed = rows.select(*[_header(v).alias(k) for k, v in names.items()], F.encode("value", "UTF-8").alias("raw"), length.alias("head_bytes"))
    return parsed.select("type", "record", "digest", "refers", F.col("number").cast("int").alias("number"), "origin", F.col("total").cast("long").alias("total"), F.expr("substring(raw, head_bytes + 5, cast(size as int))").alias("block"))


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests = [], []
        for record, digest, total, numbers, block in zip(*[batch.column(c).to_pylist() for c in ("record", "digest", "total", "numbers", "block")], strict=True):
            message = b"".join(block)
            if numbers != list(range(1, len(numbers) + 1)) or (total is not None and total != len(message)):
                raise ValueError(f"{record}: segments {numbers} have {len(message)} of {total} bytes")
            payload = unframed(message)
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest != f"sha1:{found}":
                raise ValueError(f"{record}: its payload's digest is {found}, not {digest}")
            sizes.append(len(payload))
            digests.append(found)
        yield pa.record_batch([batch.column("record"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["record", "payload_bytes", "payload_digest"])


def read_archives(df: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to from a folder's records.

    df: the text between version lines, as `archive_lines` reads it.
    """
    records = read_records(df)
    whole = records.where("type = 'response' and number is null").select("record", "digest", F.lit(None).cast("long").alias("total"), F.array(F.lit(1)).alias("numbers"), F.array("block").alias("block"))
    parts = records.where("number is not null").withColumn("origin", F.coalesce("origin", "record"))
    # rows that repeat a page have the same segments: each counts once in a block, first ones say how many rows
    parts = parts.groupBy("origin", "number", "block").agg(F.max("digest").alias("digest"), F.max("total").alias("total"), F.count("*").alias("copies"))
    ordered = F.sort_array(F.collect_list(F.struct("number", "block")))
    copies = F.coalesce(F.max(F.when(F.col("number") == 1, F.col("copies"))), F.lit(1))
    joined = parts.groupBy("origin").agg(F.max("digest").alias("digest"), F.max("total").alias("total"), ordered.alias("s"), copies.alias("copies"))
    joined = joined.select(F.col("origin").alias("record"), "digest", "total", F.col("s.number").alias("numbers"), F.col("s.block").alias("block"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    decoded = "record string, payload_bytes long, payload_digest string"
    page = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d*):", 1), F.lit("")).cast("long")
    responses = whole.mapInArrow(_payload, decoded).unionByName(joined.mapInArrow(_payload, decoded)).select(page("record").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    length = F.regexp_extract(F.decode("block", "UTF-8"), r"Content-Length: (\d+)", 1).cast("long")
    revisits = records.where("type = 'revisit'").select(page("record").alias("page_id"), length.alias("payload_bytes"), F.substring("digest", 6, 32).alias("payload_digest"), F.lit("revisit").alias("record_type"), page("refers").alias("refers_to"))
    return responses.unionByName(revisits)


def archive_lines(spark, path: str) -> DataFrame:
    return spark.read.option("lineSep", VERSION).text(path)
