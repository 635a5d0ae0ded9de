r"""Chat formatting by columnar byte assembly.

Every turn becomes ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles and texts the reader must never see a
control string, so each ``<`` that backslashes (or none) and a ``|`` follow gets one more backslash; taking one away
gives the text back. A role's line breaks are escaped as well. Turns are sorted by conversation, turn, role
and text, null turns first; null roles and texts count as empty. A null conv_id is a conversation of its own. A conversation with no rows doesn't exist.

For a batch of turns the lengths of all headers, contents and footers give offsets by a cumulative sum; the source
bytes are scattered to them in one buffer allocated beforehand, which becomes the Arrow column as it is. The output has a row for
each run of a conversation's turns within a batch: conv_id, part (increasing in the order of the turns), formatted, and
where the loss mask starts and ends, in bytes. Turns are dealt out by ranges of conversation, turn, role and text,
so a conversation of any length spreads over tasks and is never held whole.

Reading back sorts the parts of each conversation and streams them through one reader, as a digest of all its text
needs its turns in order; the reader holds one part and the digests' states.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passes, texts_of

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
FORMATTED = "conv_id {id}, part long, formatted binary, loss_starts array<long>, loss_ends array<long>"
DIGESTS = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Texts of so many bytes are copied as slices, so that their positions take no memory.
SLICED = 1 << 16
TURN = re.compile(re.escape(START.encode()) + rb"([^\n]*)\n(.*?)" + re.escape(END.encode()) + rb"\n", re.S)


def escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def escaped_role(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n")
    return pc.replace_substring(column, "<|", "<\\|")


def unescaped(raw: bytes) -> bytes:
    return re.sub(rb"<\\(\\*)\|", rb"<\1|", raw)


def unescaped_role(raw: bytes) -> bytes:
    raw = raw.replace(b"<\\|", b"<|")
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], raw)


def _source(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text column, and each value's start and length in them."""
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), bounds[:-1], np.diff(bounds)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """The buffer of all turns one after the other, the bounds of the turns, and the bounds of headers and contents.

    Every turn has five segments: opening mark, role, line end, text, closing mark. The cumulative sum of their lengths
    says where each goes; roles and texts are scattered there, marks by one position for each of their bytes.
    """
    marks = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END + "\n")]
    filled = {1: _source(escaped_role(texts_of(roles))), 3: _source(escaped(texts_of(texts)))}
    n = len(roles)
    lengths = np.empty((n, 5), np.int64)
    for k in range(5):
        lengths[:, k] = filled[k][2] if k in filled else len(marks[k // 2])
    segments = np.concatenate([[0], np.cumsum(lengths.ravel())]).astype(np.int64)
    buffer = pa.allocate_buffer(int(segments[-1]))
    out, begins = np.frombuffer(buffer, np.uint8), segments[:-1].reshape(n, 5)
    for k in range(5):
        if k in filled:
            raw, starts, sizes = filled[k]
            target = begins[:, k]
            long = sizes >= SLICED
            for at, start, size in zip(target[long].tolist(), starts[long].tolist(), sizes[long].tolist(), strict=True):
                out[at : at + size] = raw[start : start + size]
            target, starts, sizes = target[~long], starts[~long], sizes[~long]
            step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out[np.repeat(target, sizes) + step] = raw[np.repeat(starts, sizes) + step]
        else:
            out[begins[:, k, None] + np.arange(len(marks[k // 2]))] = marks[k // 2]
    return buffer, segments[::5], segments


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32  # ranges are in order, so the parts of a conversation are
    for batch in passes(batches, "text"):
        data, turns, segments = assemble(batch.column("role"), batch.column("text"))
        ids = batch.column("conv_id").to_pylist()
        learned = pc.fill_null(pc.equal(batch.column("role"), LEARNED), False).to_numpy(zero_copy_only=False)
        change = np.flatnonzero([k == 0 or ids[k] != ids[k - 1] for k in range(len(ids))])
        cuts = np.append(change, len(ids))
        keys, parts, starts, ends = [], [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            keys.append(ids[a])
            parts.append(part)
            part += 1
            taught = np.flatnonzero(learned[a:b]) + a
            starts.append(segments[5 * taught + 3] - turns[a])
            ends.append(segments[5 * taught + 4] - turns[a])
        offsets = pa.py_buffer(turns[cuts].astype(np.int32).tobytes())
        formatted = pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, data])
        yield pa.record_batch([pa.array(keys, batch.column("conv_id").type), pa.array(parts, pa.int64()), formatted, pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["conv_id", "part", "formatted", "loss_starts", "loss_ends"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """The formatted parts of every conversation."""
    kind = dict(conversations.dtypes)["conv_id"]
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_format, FORMATTED.format(id=kind))


class _Reader:
    """What is known of one conversation from the parts read so far."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, raw: bytes, starts: list[int], ends: list[int]) -> None:
        self.chars += len(raw.decode())
        at = 0
        for m in TURN.finditer(raw):
            if m.start() != at:
                raise ValueError(f"conversation {self.conv_id}: bytes {at} to {m.start()} are no turn")
            at = m.end()
            self.n_turns += 1
            self.turns.update(unescaped_role(m[1]) + b"\n" + unescaped(m[2]) + b"\n")
        if at != len(raw):
            raise ValueError(f"conversation {self.conv_id}: bytes from {at} on are no turn")
        for a, b in zip(starts, ends, strict=True):
            text = unescaped(raw[a:b])
            self.loss_chars += len(text.decode())
            self.loss.update(text)

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Reader | None = None
    kind = pa.null()
    for batch in batches:
        done, kind = [], batch.column("conv_id").type
        for conv_id, _, raw, starts, ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now is None or now.conv_id != conv_id:
                if now:
                    done.append(now.row())
                now = _Reader(conv_id)
            now.read(raw, starts, ends)
        yield _rows(done, kind)
    if now:
        yield _rows([now.row()], kind)


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted bytes and their loss mask alone."""
    ordered = formatted.select("conv_id", "part", "formatted", "loss_starts", "loss_ends").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(_read, DIGESTS.format(id=dict(formatted.dtypes)["conv_id"]))
