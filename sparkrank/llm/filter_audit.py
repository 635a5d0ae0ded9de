"""Audit of how five filters interact, for all their orders, from one histogram of failure masks.

A document fails A with under 200 words, B with under half of its words distinct, C with over 2 % capitals `[A-Z]` among its code points, D
with any of `#$%&*|`, E with a text that a smaller doc_id has, anywhere in the table. Words are maximal runs of anything but ASCII
white space, case-sensitive. The five bits of a document's mask say which it fails. For a part, how many documents have each of the 32
masks is all that any order of filters depends on: with passing[s] documents failing nothing in the set s, a filter f after the set s
removes passing[s] - passing[s + f].

Copies: texts are told apart by SHA-256, so none is shuffled whole. A copy's parts and masks are counted before copies meet, so the
most copied text is one row for each part and mask (a copy shares its text's A to D). E spares the rows of the least doc_id.

Nulls: a null text is empty; a null source is part '' like an empty one; a null doc_id is neither smaller nor larger than another,
so such a row fails no E and makes no other row fail it, and it has no labels. Rows repeated with the same doc_id and text count each and spare each
other. A document with contradicting labels counts for each of them: lost as good if any label of it has quality 1, as toxic if
any has toxic 1. A table without documents has no parts and no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Filter k's bit in a mask is 1 << k.
MASKS = 1 << len(FILTERS)
COUNTS = ["n", "good", "toxic"]


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the mask of A to D, a row for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = [
        words < 200,
        100 * distinct.cast("long") < 50 * words.cast("long"),
        100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 2 * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def label_marks(labels: DataFrame) -> DataFrame:
    """doc_id, good and toxic (0 or 1), a row for each labelled document."""
    marks = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*marks)


def mask_histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: how many documents of a part fail just the filters of a mask, for the masks that occur."""
    keys = ["digest", "part", "mask"]
    # one narrow row for each doc_id, so that the least one's rows can be told by their number
    rows = failure_masks(docs).groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    # rows without an id join nothing; the key spreads them
    rows = rows.withColumn("_key", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.xxhash64("doc_id")))
    rows = rows.join(label_marks(labels).withColumn("_key", F.xxhash64("doc_id")), ["_key", "doc_id"], "left")
    rows = rows.select("doc_id", *keys, "n", *[(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTS[1:]])
    known = F.col("doc_id").isNotNull()
    nameless = [F.sum(F.when(~known, F.col(c)).otherwise(0)).alias(f"{c}_nameless") for c in COUNTS]
    copies = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS], F.min(F.when(known, F.struct("doc_id", *COUNTS))).alias("least"), *nameless)
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    copies = copies.withColumn("is_first", F.coalesce(F.col("least.doc_id") == first, F.lit(False)))
    spared = [F.col(f"{c}_nameless") + F.when(F.col("is_first"), F.col(f"least.{c}")).otherwise(0) for c in COUNTS]
    spared_row = F.struct(F.col("mask").alias("mask"), *[s.alias(c) for s, c in zip(spared, COUNTS)])
    failing_row = F.struct((F.col("mask") + MASKS // 2).alias("mask"), *[(F.col(c) - s).alias(c) for s, c in zip(spared, COUNTS)])
    cells = copies.select("part", F.inline(F.array(spared_row, failing_row)))
    return cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS]).where("n > 0")


def in_set(letters: Column) -> Column:
    """The mask of the filters named."""
    return sum((F.when(F.contains(letters, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part."""
    nothing = F.lit(0).cast("long")
    masks = F.sequence(F.lit(0), F.lit(MASKS - 1))
    # a part's cells by mask, and for each set of filters the documents that fail none of it
    found = mask_histogram(docs, labels).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS)))).alias("cells"))

    def by_mask(c: str) -> Column:
        return F.transform(masks, lambda m: F.coalesce(F.try_element_at(F.col("cells"), m)[c], nothing)).alias(f"{c}_cells")

    found = found.select("part", *[by_mask(c) for c in COUNTS])

    def passing(c: str) -> Column:
        cell = lambda m: F.get(F.col(f"{c}_cells"), m)
        return F.transform(masks, lambda chosen: F.aggregate(masks, nothing, lambda sofar, m: sofar + F.when(m.bitwiseAND(chosen) == 0, cell(m)).otherwise(0)))

    found = found.select("part", "n_cells", *[passing(c).alias(c) for c in COUNTS])

    def removed(c: str, earlier: Column, bit: Column) -> Column:
        return F.get(F.col(c), earlier) - F.get(F.col(c), earlier.bitwiseOR(bit))

    # over all orders: each set of other filters comes first in |set|! (4 - |set|)! of them
    others = len(FILTERS) - 1
    many = F.array(*[F.lit(factorial(k) * factorial(others - k)).cast("long") for k in range(others + 1)])

    def shapley(bit: Column) -> Column:
        share = lambda s: F.get(many, F.bit_count(s)) * removed("n", s, bit)
        return F.aggregate(masks, nothing, lambda sofar, s: sofar + F.when(s.bitwiseAND(bit) == 0, share(s)).otherwise(0))

    found = found.withColumn("shapley", F.transform(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), shapley))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    found = found.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own, before = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    found = found.withColumn("bit", in_set(own)).withColumn("earlier", in_set(before))
    bit, earlier = F.col("bit"), F.col("earlier")
    gone = removed("n", earlier, bit)
    return found.select(
        "part", "filter_order", "step",
        F.get("n", earlier.bitwiseOR(bit)).alias("kept"), gone.alias("removed"), (removed("n", F.lit(0), bit) - gone).alias("redundant"), F.get("n_cells", bit).alias("unique_fails"),
        removed("good", earlier, bit).alias("good_lost"), removed("toxic", earlier, bit).alias("toxic_lost"), F.get("shapley", F.instr(F.lit(FILTERS), own) - 1).alias("shapley"),
    )
