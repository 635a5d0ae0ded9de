"""Landed live statistics as a data source that opens only the gameweeks asked for.

    read_weeks(spark, "file:///landed/live", "gameweek BETWEEN 3 AND 5")

The folder holds gameweek=<n>/ with files of JSON lines, a document {"elements": [{"id": .., "stats": {..}}]} each. A partition
is a file. Filters on gameweek choose folders by their names before any file is opened. A file that can't be read is tried again
after a pause that doubles, three times in all by default, as an upstream that fails now and then needs; then the read
fails, or with `failed=skip` the file gives no rows, as a collector that goes on without a week does.
Paths are those that pyarrow's file systems know (local, hdfs, s3, gs).

Spark 4.1 keeps one set of pushed filters for each loaded frame: where one plan filters the same frame in two ways, both scans get the
partitions of the last. So read_weeks loads anew at each call, and hides the column from later filters, which Spark then applies to
the rows. Of the bare format take a new load for each filter.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not

from . import schemas

FOLDER = "gameweek="
STATISTICS = ["total_points", *schemas.LIVE_COUNTS, *schemas.LIVE_MEASURES]
NAMES = ["points" if c == "total_points" else c for c in STATISTICS]
ARROW = pa.schema([("player_id", pa.int64()), ("gameweek", pa.int32()), *[(c, pa.float64()) for c in NAMES]])
#: Rows of a batch.
BATCH = 8192


def test_of(f: Filter) -> Callable[[int], bool] | None:
    """What a filter says of a gameweek; None where it is about something else."""
    if isinstance(f, Not):
        inner = test_of(f.child)
        return inner and (lambda week: not inner(week))
    if getattr(f, "attribute", None) != ("gameweek",):
        return None
    if isinstance(f, IsNotNull):
        return lambda week: True
    if not hasattr(f, "value"):
        return None
    value = f.value
    kinds = {
        EqualTo: lambda week: week == value, EqualNullSafe: lambda week: week == value, In: lambda week: week in value, GreaterThan: lambda week: week > value,
        GreaterThanOrEqual: lambda week: week >= value, LessThan: lambda week: week < value, LessThanOrEqual: lambda week: week <= value,
    }
    # a comparison with null holds for no row, negated or not: Spark keeps it
    return None if value is None else kinds.get(type(f))


@dataclass
class WeekFile(InputPartition):
    gameweek: int
    path: str


class GameweekReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.tries, self.wait = options["path"], int(options.get("tries", 3)), float(options.get("wait", 1.0))
        self.skip = options.get("failed", "raise") == "skip"
        self.tests: list[Callable[[int], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the filters on gameweek, gives back the others."""
        for f in filters:
            if test := test_of(f):
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[WeekFile]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = []
        for folder in store.get_file_info(fs.FileSelector(root)):
            week = folder.base_name.removeprefix(FOLDER)
            if folder.base_name.startswith(FOLDER) and week.isdigit() and all(test(int(week)) for test in self.tests):
                files = store.get_file_info(fs.FileSelector(folder.path, recursive=True))
                found += [WeekFile(int(week), f.path) for f in files if f.is_file and not f.base_name.startswith(("_", "."))]
        return sorted(found, key=lambda f: (f.gameweek, f.path))

    def content(self, path: str) -> bytes:
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(path) as stream:
            return stream.read()

    def read(self, partition: WeekFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is asked for
            return
        for attempt in range(self.tries):
            try:
                rows = [e for line in self.content(partition.path).splitlines() if line.strip() for e in json.loads(line)["elements"]]
                break
            except (OSError, ValueError, KeyError):
                if attempt + 1 == self.tries:
                    if self.skip:
                        return
                    raise
                time.sleep(self.wait * 2**attempt)
        for at in range(0, len(rows), BATCH):
            part = rows[at : at + BATCH]
            stats = [e.get("stats") or {} for e in part]
            numbers = [pa.array([None if s.get(c) is None else float(s[c]) for s in stats], pa.float64()) for c in STATISTICS]
            yield pa.RecordBatch.from_arrays([pa.array([e["id"] for e in part], pa.int64()), pa.array([partition.gameweek] * len(part), pa.int32()), *numbers], schema=ARROW)


class GameweekSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gameweeks"

    def schema(self) -> str:
        return "player_id long, gameweek int, " + ", ".join(f"{c} double" for c in NAMES)

    def reader(self, schema) -> GameweekReader:
        return GameweekReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes format("gameweeks") known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GameweekSource)


def read_weeks(spark: SparkSession, path: str, condition: Column | str | None = None, **options: str) -> DataFrame:
    """player_id, gameweek and the 23 statistics of the gameweeks that a condition on gameweek allows, all without one."""
    register(spark)
    rows = spark.read.format("gameweeks").options(**options).load(path)
    rows = rows if condition is None else rows.where(condition)
    return rows.withColumn("gameweek", F.coalesce("gameweek", F.lit(0)))  # later filters stay above the scan
