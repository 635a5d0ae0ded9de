"""Landed upstream documents: JSON lines read as VARIANT and exploded into typed rows.

A source hands out its players, fixtures or statistics in pages: documents with an array of some hundred rows and the number of the
page. Each page is a line; a file holds any number of them. So no document, group or task holds a whole table, and
Spark splits the reading by files and lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schemas

#: A row's order is its page's number times this, plus its place in the page.
PAGE_PLACES = 1 << 32


def write_pages(rows: DataFrame, path: str, array: str, page: Column, folders: list[str] | None = None, **more: Column) -> None:
    """Writes rows as documents {page, `array`: [row, ..], more ..}, one for each page (and folder), sorted by the rows' first column.

    page: a row's page, by which no page gets many rows. more: aggregates over a page's rows, as further entries.
    """
    names = [c for c in rows.columns if c not in (folders or [])]
    pages = rows.groupBy(page.alias("_page"), *(folders or [])).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_rows"), *[c.alias(k) for k, c in more.items()])
    document = F.to_json(F.struct(F.col("_page").alias("page"), F.col("_rows").alias(array), *more))
    writer = pages.select(*(folders or []), document.alias("value")).write.option("compression", "gzip")  # names repeat in every row
    (writer.partitionBy(*folders) if folders else writer).text(path)


def documents(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """A VARIANT `doc` for each line, or with whole_files for each file; lines that are no JSON have null and give no rows."""
    return spark.read.option("singleVariantColumn", "doc").option("multiLine", whole_files).json(path)


def rows_of(docs: DataFrame, array: str, schema: str) -> DataFrame:
    """`ord` and the named, typed fields of each entry of an array of the documents; `array` is its path, $ for a document that is one.

    A field that is missing or has another type is null, a document without the array has no rows.
    """
    path = array if array.startswith("$") else f"$.{array}"
    entries = docs.sparkSession.tvf.variant_explode(F.try_variant_get(F.col("doc").outer(), path, "variant"))
    found = docs.lateralJoin(entries).where("key IS NULL AND pos IS NOT NULL")
    ord_ = page_number() * PAGE_PLACES + F.col("pos")
    fields = [F.try_variant_get("value", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in StructType.fromDDL(schema).fields]
    return found.select(ord_.alias("ord"), *fields)


def page_number() -> Column:
    """The page of a document, 0 for one without."""
    return F.coalesce(F.try_variant_get("doc", "$.page", "bigint"), F.lit(0).cast("long"))


def players(docs: DataFrame) -> DataFrame:
    return rows_of(docs, "elements", schemas.PLAYER)


def teams(docs: DataFrame) -> DataFrame:
    return rows_of(docs, "teams", schemas.TEAM).drop("ord")


def events(docs: DataFrame) -> DataFrame:
    return rows_of(docs, "events", schemas.EVENT)


def fixtures(docs: DataFrame) -> DataFrame:
    return rows_of(docs, "fixtures", schemas.FIXTURE)


def live(docs: DataFrame) -> DataFrame:
    """player_id, gameweek and the 23 statistics of a gameweek's documents, which name their gameweek."""
    stats = ["total_points", *schemas.LIVE_COUNTS, *schemas.LIVE_MEASURES]
    entries = docs.sparkSession.tvf.variant_explode(F.try_variant_get(F.col("doc").outer(), "$.elements", "variant"))
    found = docs.lateralJoin(entries).where("key IS NULL AND pos IS NOT NULL")
    values = [F.try_variant_get("value", f"$.stats.{c}", "double").alias("points" if c == "total_points" else c) for c in stats]
    return found.select(F.try_variant_get("value", "$.id", "bigint").alias("player_id"), F.try_variant_get("doc", "$.gameweek", "int").alias("gameweek"), *values)


def current_event(docs: DataFrame) -> DataFrame:
    """One row `gameweek`: the current event of the first page that names one, else 1."""
    event = F.try_variant_get("doc", "$.current_event", "int")
    return docs.agg(F.coalesce(F.min_by(event, F.when(event.isNotNull(), page_number())), F.lit(1)).alias("gameweek"))
