"""Mixing sources to target weights by min-cost flow.

Documents belong to one or several sources. Those with the same set of sources form a membership pattern, and
only the total size of each pattern matters for the plan. Tokens flow from patterns to their sources, up to
each source's quota; a pattern's first pass costs nothing, each further one more than the last (repetition is
convexly priced), so nothing repeats while anything is unused. The flow says how much of each pattern each source
takes. A pattern's whole passes go to all its documents; of the rest, documents are selected in the order of a
seeded hash until their sizes reach it, the one at the border where that brings the sum nearer. So a pattern's plan is its whole
passes and a place in that order, which every document can be held against where it is.

Patterns are collected to the driver: there are as many as there are sets of sources in use, whatever the number
of documents. The plan is for sources that can be listed, MOST_PATTERNS sets at most; more (a source for each host, say) are
refused, not cut: group them first. The order of a pattern's documents is never sorted in one task: hash slices are summed first, and
only the slice at the border is ordered row by row.

Sizes count words of the text; a text without words (or null) has size 0, is never taken and makes no source. A null source is a source of
its own. With equal inputs and seed the result is equal.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint

#: A document is taken so often at most.
MOST_PASSES = 3
#: Sets of sources that one plan holds at most.
MOST_PATTERNS = 200_000
#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
PLAN = "pattern int, memberships array<string>, whole long, rest long, targets array<double>, source_sizes array<long>"
#: Slices of the hash order that are summed; a slice of a pattern holds a 4096th of its documents.
SLICES = 4096


def quotas(sizes: Sequence[float], weights: Sequence[float], total: float | None = None, most: float = MOST_PASSES) -> list[float]:
    """Shares of the total (the sum of sizes) by weight; a share stops at `most` times its size, the excess is shared anew."""
    total = float(sum(sizes)) if total is None else float(total)
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def route(patterns: Sequence[Sequence[int]], sizes: Sequence[int], targets: Sequence[int], most: int = MOST_PASSES) -> list[dict[int, int]]:
    """Min-cost flow from patterns to sources: what each source takes of each pattern.

    patterns: the sources each may flow to. Successive cheapest paths: from an unused pass of a pattern to a source with
    open quota, also by way of patterns that give up one source for another. Only passes cost anything, so the heap takes
    the cheapest pass and a search through the residual edges, which are free, takes it to a source.
    """
    flow: list[dict[int, int]] = [{s: 0 for s in p} for p in patterns]
    used, need = [0] * len(patterns), list(targets)
    takers: dict[int, list[int]] = {}
    for p, sources in enumerate(patterns):
        for s in sources:
            takers.setdefault(s, []).append(p)
    heap = [(0, p) for p, size in enumerate(sizes) if size > 0]
    heapq.heapify(heap)
    while heap:
        cost, p = heapq.heappop(heap)
        room = sizes[p] * (cost + 1) - used[p]
        while room > 0:
            # sources reachable from p: its own, then those that patterns feeding a reached source could feed instead
            came: dict[int, tuple[int, int | None]] = {s: (p, None) for s in patterns[p]}
            queue = list(came)
            end = next((s for s in queue if need[s] > 0), None)
            k = 0
            while end is None and k < len(queue):
                via = queue[k]
                k += 1
                for q in takers[via]:
                    if flow[q][via] > 0:
                        for s in patterns[q]:
                            if s not in came:
                                came[s] = (q, via)
                                queue.append(s)
                                if need[s] > 0 and end is None:
                                    end = s
            if end is None:
                break
            path, at = [], end
            while at is not None:
                q, via = came[at]
                path.append((q, via, at))
                at = via
            amount = min(room, need[end], *[flow[q][via] for q, via, _ in path if via is not None] or [room])
            for q, via, s in path:
                flow[q][s] += amount
                if via is not None:
                    flow[q][via] -= amount
            used[p] += amount
            need[end] -= amount
            room -= amount
        if used[p] == sizes[p] * (cost + 1) and cost + 1 < most:
            heapq.heappush(heap, (cost + 1, p))
    return flow


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def planned(documents: DataFrame, total: float | None = None, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, seed: int = 0) -> DataFrame:
    """A row for each set of sources: memberships, whole passes, the border of one more (slice and key, see `passes`), targets and source_sizes.

    documents: doc_id, size and memberships, a sorted array of distinct sources, of which null may be one.
    """
    rows = checkpoint(documents.select("doc_id", "size", "memberships"))
    found = rows.groupBy("memberships").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()  # a row for each set of sources
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"there are over {MOST_PATTERNS} sets of sources, more than one plan holds")
    found = sorted(found, key=lambda r: [(s is None, s or "") for s in r["memberships"]])
    names = sorted({s for r in found for s in r["memberships"]}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    patterns, sizes = [[number[s] for s in r["memberships"]] for r in found], [r["size"] or 0 for r in found]
    held = [0] * len(names)
    for p, size in zip(patterns, sizes, strict=True):
        for s in p:
            held[s] += size
    wanted = quotas(held, [weights[i % len(weights)] for i in range(len(names))], sum(sizes) if total is None else total, most)
    flow = route(patterns, sizes, [math.floor(t + 0.5) for t in wanted], most)
    taken = [sum(f.values()) for f in flow]
    rows_of_plan = [(k, r["memberships"], *(divmod(taken[k], sizes[k]) if sizes[k] else (0, 0)), [wanted[s] for s in patterns[k]], [held[s] for s in patterns[k]]) for k, r in enumerate(found)]
    plan = documents.sparkSession.createDataFrame(rows_of_plan, PLAN)

    # where in the seeded order each pattern's further pass ends: slices of the order are summed, only the slice at the border is ordered
    keyed = _with_plan(rows, plan).withColumn("_slice", _slice(seed))
    slices = keyed.groupBy("pattern", "_slice", "rest").agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("pattern").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = checkpoint(slices.withColumn("_before", before))
    clear = slices.where(F.col("_before") + F.col("_sum") <= F.col("rest")).groupBy("pattern").agg(F.max("_slice").alias("border"))
    split = slices.where((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_sum") > F.col("rest"))).select("pattern", "_slice", "_before")  # one for each pattern at most
    running = F.sum("size").over(Window.partitionBy("pattern").orderBy(_order(seed), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    inner = keyed.join(F.broadcast(split), ["pattern", "_slice"]).withColumn("_sofar", F.col("_before") + F.coalesce(running, F.lit(0)))
    # the document at the border is taken where that brings the sum nearer; none after one that isn't can be
    last = inner.where(2 * (F.col("rest") - F.col("_sofar")) > F.col("size")).groupBy("pattern").agg(F.max(_key(seed)).alias("last"))
    return plan.join(clear, "pattern", "left").join(last, "pattern", "left").select("memberships", "whole", "border", "last", "targets", "source_sizes")


def _order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _slice(seed: int) -> Column:
    return F.conv(F.substring(_order(seed), 1, 3), 16, 10).cast("int")


def _key(seed: int) -> Column:
    return F.struct(_order(seed).alias("order"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with what the plan says of their memberships; the plan has MOST_PATTERNS rows at most."""
    return rows.join(F.broadcast(plan), rows["memberships"].eqNullSafe(plan["memberships"])).drop(plan["memberships"])


def with_passes(rows: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """rows (doc_id, size, memberships and any others) with passes, how often each is taken, targets and source_sizes.

    A row's place in the seeded order says whether it is before the border, so rows stay where they are.
    """
    more = F.coalesce(_slice(seed) <= F.col("border"), F.lit(False)) | F.coalesce(_key(seed) <= F.col("last"), F.lit(False))
    return _with_plan(rows, plan).withColumn("passes", F.when(F.col("size") > 0, F.col("whole") + more.cast("int")).otherwise(0).cast("int")).drop("whole", "border", "last")


def mix(documents: DataFrame, total: float | None = None, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, seed: int = 0) -> DataFrame:
    """doc_id, size, memberships, passes (how often the row is taken), and its sources' targets and sizes.

    documents: doc_id, size and memberships, a non-empty array of sources, of which null may be one.
    """
    rows = checkpoint(documents.select("doc_id", "size", F.sort_array(F.array_distinct("memberships")).alias("memberships")))
    return with_passes(rows, planned(rows, total, weights, most, seed), seed).select("doc_id", "size", "memberships", "passes", "targets", "source_sizes")


def mix_by_source(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of docs that belong to the one source in their column `source`."""
    rows = sized(docs.select("doc_id", "text", "source")).select("doc_id", F.col("_size").alias("size"), F.array("source").alias("memberships"))
    mixed = mix(rows, **options)
    return mixed.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), (F.col("passes") * F.col("size")).cast("long").alias("taken"), "passes")


def keep_taken(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The rows of docs, all their columns, each as often as the mix takes it. Texts aren't shuffled."""
    narrow = lambda df: sized(df).select("doc_id", F.col("_size").alias("size"), F.array("source").alias("memberships"))
    plan = planned(narrow(docs.select("doc_id", "text", "source")), seed=seed, **options)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = sized(docs.select("doc_id", "text", "source", whole)).select("doc_id", F.col("_size").alias("size"), F.array("source").alias("memberships"), "row")
    taken = with_passes(rows, plan, seed).where("passes > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "passes")).alias("copy")).select("row.*")
