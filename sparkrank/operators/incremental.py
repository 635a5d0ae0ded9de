"""The feature panel kept up to date by gameweeks, instead of built anew for each.

    path/features/gameweek=<n>   the panel's rows and their rolling features
    path/tail/upto=<n>           each player's last nine rows up to that gameweek, of the columns that rolling features look at

The widest rolling feature looks at ten rows, so the last nine are all that new rows need of what was before. New weeks are read
with the tail before them, never with the features of old weeks; only the folders of the new weeks are written, by Spark's dynamic
overwrite, which stages and then renames them. The tail follows when they are there. A run that died, or that brings corrected
rows, is repeated with the same weeks and starts from the same tail again. Weeks before others that are stored can't be replaced
alone, as the later ones' features hang on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .features import ROLLED, SPANS, time_features

#: Rows before a row that its features look at.
TAIL_ROWS = max(SPANS) - 1
#: What these features look at.
TAIL_COLUMNS = ["player_id", "gameweek", *ROLLED, "price", "selected_by_percent"]
#: Tails kept: a correction can go back so many increments.
KEPT_TAILS = 5


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the sub-folders <prefix><number>, by name alone."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(context._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    names = [x.getPath().getName() for x in store.listStatus(at)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def stored_weeks(spark: SparkSession, path: str) -> list[int]:
    return _numbers(spark, f"{path}/features", "gameweek=")


def add_weeks(panel: DataFrame, path: str) -> tuple[int, int] | None:
    """Adds (or replaces) the gameweeks of panel rows; returns the first and the last, None for no rows.

    ValueError where a later week is stored that the rows don't hold.
    """
    spark = panel.sparkSession
    weeks = sorted(r["gameweek"] for r in panel.select("gameweek").distinct().collect())  # as few as there are gameweeks
    if not weeks:
        return None
    later = [w for w in stored_weeks(spark, path) if w > weeks[0] and w not in weeks]
    if later:
        raise ValueError(f"weeks {later} are stored and need the new rows' weeks before them: give them too")
    tails = _numbers(spark, f"{path}/tail", "upto=")
    before = [n for n in tails if n < weeks[0]]
    old = [w for w in stored_weeks(spark, path) if w < weeks[0]]
    if old and (not before or before[-1] < old[-1]):
        raise ValueError(f"there is no tail up to week {old[-1]}: give all weeks after {before[-1] if before else old[0] - 1}")
    rows, schema = panel, panel.select(*[c for c in TAIL_COLUMNS if c in panel.columns]).schema
    if before:
        last = spark.read.schema(schema).parquet(f"{path}/tail/upto={before[-1]}")
        rows = panel.unionByName(last, allowMissingColumns=True)  # the others' columns are null in rows that aren't kept
    made = time_features(rows).where(F.col("gameweek") >= weeks[0])
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gameweek").parquet(f"{path}/features")
    # what was written is read again, as the panel may be long in the making
    new = spark.read.schema(schema).option("basePath", f"{path}/features").parquet(*[f"{path}/features/gameweek={w}" for w in weeks]).select(*schema.names)
    stored = new.unionByName(last) if before else new
    nth = F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("gameweek")))
    tail = stored.withColumn("_nth", nth).where(F.col("_nth") <= TAIL_ROWS).drop("_nth")
    tail.write.mode("overwrite").parquet(f"{path}/tail/upto={weeks[-1]}")
    for gone in [n for n in _numbers(spark, f"{path}/tail", "upto=") if n > weeks[-1]] + sorted(n for n in tails if n < weeks[-1])[: -KEPT_TAILS + 1]:
        _delete(spark, f"{path}/tail/upto={gone}")
    return weeks[0], weeks[-1]


def read_features(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The stored rows and features of a range of gameweeks; other folders aren't read."""
    rows = spark.read.parquet(f"{path}/features").withColumn("gameweek", F.col("gameweek").cast("int"))
    rows = rows if first is None else rows.where(F.col("gameweek") >= first)
    return rows if last is None else rows.where(F.col("gameweek") <= last)
