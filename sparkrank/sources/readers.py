"""Landed upstream documents and panels as DataFrames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def bootstrap(spark: SparkSession, path: str) -> DataFrame:
    """The upstream document with players, teams and events, a row per file."""
    return spark.read.schema(schemas.BOOTSTRAP).option("multiLine", True).json(path)


def _rows(document: DataFrame, array: str) -> DataFrame:
    """The elements of an array column, with their order as `ord`."""
    return document.select(F.posexplode(array).alias("ord", "row")).select(F.col("ord").cast("long").alias("ord"), "row.*")


def players(document: DataFrame) -> DataFrame:
    return _rows(document, "elements")


def teams(document: DataFrame) -> DataFrame:
    return _rows(document, "teams").drop("ord")


def events(document: DataFrame) -> DataFrame:
    return _rows(document, "events")


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Fixtures from a JSON array file; their order in the file matters and is kept as `ord`."""
    kinds = schemas.FIXTURE.replace(" ", ": ").replace(",: ", ", ")
    text = spark.read.option("wholetext", True).text(path)
    return _rows(text.select(F.from_json("value", f"array<struct<{kinds}>>").alias("rows")), "rows")


def live(spark: SparkSession, path: str) -> DataFrame:
    """Live statistics of players by gameweek, from folders gameweek=<n>; a filter on gameweek prunes folders."""
    document = spark.read.schema(schemas.LIVE).option("multiLine", True).json(path)
    rows = document.select(F.col("gameweek").cast("int").alias("gameweek"), F.explode("elements").alias("e"))
    return rows.select(F.col("e.id").alias("player_id"), "gameweek", "e.stats.*").withColumnRenamed("total_points", "points")


def current_event(document: DataFrame) -> DataFrame:
    """One row `gameweek`: the document's current event, else 1."""
    return document.agg(F.coalesce(F.first("current_event", ignorenulls=True), F.lit(1)).alias("gameweek"))


def current_gameweek(events_: DataFrame, order: Column | None = None) -> DataFrame:
    """One row `gameweek`: the first event that is current, else the largest id, else 1."""
    order = F.col("ord") if order is None else order
    first = F.min_by("id", F.when(F.col("is_current"), order))
    return events_.agg(F.coalesce(first, F.max("id"), F.lit(1)).alias("gameweek"))


def write_panel(panel: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet by gameweek, or CSV with a header."""
    if csv:
        panel.write.mode("overwrite").option("header", True).csv(path)
    else:
        panel.write.mode("overwrite").partitionBy("gameweek").parquet(path)


def save_panel(panel: DataFrame, folder: str, prefix: str = "panel", when: datetime | None = None) -> str:
    """Writes CSV with a header under a name that sorts by time, the present by default; returns the path."""
    path = f"{folder}/{prefix}_{when or datetime.now():%Y%m%d_%H%M%S}.csv"
    write_panel(panel, path, csv=True)
    return path


def read_panel_csv(spark: SparkSession, path: str, schema: str = schemas.PANEL) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def latest_snapshot(spark: SparkSession, folder: str, prefix: str) -> str:
    """The path of the file or folder whose name, of those with the prefix, sorts last; only names are listed."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(folder)
    names = [x.getPath().getName() for x in at.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(at)]
    found = sorted(n for n in names if n.startswith(prefix))
    if not found:
        raise FileNotFoundError(f"{folder} has no snapshot {prefix}")
    return f"{folder}/{found[-1]}"


def save_report(report: DataFrame, path: str) -> None:
    """Writes a report's lines as one text file, sections after each other by name; a report has some 30 lines."""
    report.orderBy("section", "rank").select("line").coalesce(1).write.mode("overwrite").text(path)


def refresh(*frames: DataFrame) -> None:
    """Drops what is kept of the frames, so that the next action reads anew."""
    for df in frames:
        df.unpersist()


def parse_squads(df: DataFrame, column: str = "json") -> DataFrame:
    """Adds `squad` parsed from a JSON string, and `problem` where it hasn't the shape of one."""
    parsed = df.withColumn("squad", F.from_json(column, schemas.SQUAD, {"mode": "PERMISSIVE"}))
    return parsed.withColumn("problem", F.when(F.col("squad.startingXI").isNull() | F.col("squad.bench").isNull(), "not a squad"))


def squads_to_json(df: DataFrame, column: str = "squad") -> DataFrame:
    return df.withColumn("json", F.to_json(column))
