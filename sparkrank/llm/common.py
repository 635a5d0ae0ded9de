"""Table access, checkpoint folder and Arrow batch handling shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text and rows that one numpy pass holds; a longer single text is a pass of its own.
PASS_BYTES, PASS_ROWS = 1 << 20, 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session that has none (as in tests) gets one made here."""
    context = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", ""):
        return found
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkrank-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts lineage through the shared folder, so a lost executor costs no rerun of what is behind."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; what a query leaves there goes when the application's process ends."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    store = at.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(at)  # only what exists can be marked
    store.deleteOnExit(at)
    return at.toString()


class Scratch:
    """Tables written to a folder of their own under the shared one; they cut lineage and go one by one, or at the end all."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, temporary(spark, name)
        self.saved: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.saved)}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.saved.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for path in [path for table, path in self.saved if any(table is t for t in tables)]:
            remove(self.spark, path)

    def close(self) -> None:
        remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of whatever store it is in."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


#: A key's rows are dealt out in parts of about this share of all rows.
PARTS = 1024


def dealt(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, by: str | Column, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """rows joined to the one group of their keys, hot groups in parts, so that no task gets most of one.

    groups: a row for each key, with `n`, how many rows have it; total: the sum of n. Groups of over a 1024th of all
    rows are hot: there are fewer than 1024, whose hashed keys the expression of a row's parts names, so rows of other keys
    pass through no further join; each is repeated once for each of its parts. A row's part follows from its column or hash `by`.
    sizes: the keys and `n` alone, where groups cost more; they are read at once.
    """
    parts = F.ceil(F.col("n") * PARTS / F.lit(max(total, 1))).cast("int")
    hot = (groups if sizes is None else sizes).where(F.col("n") * PARTS > total).select(F.xxhash64(*keys).alias("key"), parts.alias("parts")).collect()
    levels: dict[int, list[int]] = {}  # parts are rounded up to powers of two
    for row in hot:
        levels.setdefault(1 << (row["parts"] - 1).bit_length(), []).append(row["key"])
    number = F.lit(1)
    for level, found in sorted(levels.items()):  # of equal hashes the larger group decides, on both sides alike
        number = F.when(F.xxhash64(*keys).isin(found), level).otherwise(number)
    dealt_rows = rows.withColumn("_part", F.pmod(F.xxhash64(by), number))
    dealt_groups = groups.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), number.cast("long") - 1))).drop("n")
    return dealt_rows.join(dealt_groups, [*keys, "_part"], how).drop("_part")


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column without nulls (null: empty), in one array with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_utf8()), "")


def passes(batches: Iterable[pa.RecordBatch], text: str, most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `most` bytes of the text column and PASS_ROWS rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and (held + size > most or row - start >= PASS_ROWS):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += max(size, 1)
        yield batch.slice(start)


def map_texts(df: DataFrame, columns: list[str], text: str, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies `function` to passes over the named columns, nothing else is sent to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in passes(batches, text):
            yield function(part)

    return df.select(*[F.col(c) for c in columns]).mapInArrow(run, schema)
