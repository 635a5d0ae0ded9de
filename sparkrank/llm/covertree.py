"""Exact top-k search by inner product with a dual-tree over cover trees.

The top of the tree is shared: pivots (distinct vectors of least hash, as many as the rows ask for, at most `PIVOTS`)
cut queries and data into cells, whose covering radii and angles are the largest from their rows to the pivot. A cell is
dealt out in blocks of about `BLOCK` rows, however many rows it has; a block is a subtree and gets a cover tree of
its own in its task.

Queries first meet the blocks of their own cell. Their kth scores then prune whole cells by two bounds of what an inner
product can be: that of balls, <c,d> + |c|s + |d|r + rs for centres c, d and radii r, s, and that of cones around the
centres. What is left of a cell's queries is dealt out in groups, and each group meets each of the cell's blocks on its
own, keyed by cell and block. Within such a pair the same bounds prune pairs of nodes against the query node's worst kth
score, best bound first, and pairs of leaves are scored by one matrix product. Scores are integers below 2**53 and exact in
doubles. Vectors without any structure can't be pruned: then every pair is scored, in blocks.

Equal vectors are searched once, with their k + 1 least ids: more can't be in any result. Queries of a vector that many
share meet its results in parts. Ties go to the smaller id,
a query never finds its own row, and with fewer candidates all are returned. Vectors that are null or hold null or
non-finite components take no part; shorter vectors end in zeros. Rows repeated with the same vec_id are one
row if their vectors are equal, else each takes part. Only pivots and a few figures for each are collected.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, dealt

PIVOTS, BLOCK, GROUP, LEAF, QUERY_LEAF = 1024, 2048, 1024, 96, 16
#: Centres that gather hardly a row after which a node's other rows count as loose, if they outnumber those that do.
MISSES = 16
#: In place of an id: none.
NONE = np.iinfo(np.int64).max
HITS = "query long, vec_id long, score long"


class CoverTree:
    """Nodes over consecutive rows of `order`: centre row, radius, angle, largest norm, row range and children.

    Children of a node of radius r are centred on rows more than r/2 apart that cover their rows within r/2. Rows that
    no centre gathers with others stay together as one child around the node's own centre.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = points
        self.norms = np.sqrt((points**2).sum(1))
        self.order = np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.rows: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._grow(0, len(points), 0, leaf)
        self.middles, self.radii = np.array(self.centre, int), np.array(self.radius)
        self.norm = self.norms[self.middles]
        held = [self.order[a:b] for a, b in self.rows]
        self.largest = np.array([self.norms[rows].max() for rows in held])
        self.angle = np.array([_angles(points[rows] @ points[c], self.norms[rows] * self.norms[c]).max() for rows, c in zip(held, self.centre, strict=True)])

    def _node(self, start: int, end: int, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.rows.append((start, end))
        self.children.append([])
        return len(self.centre) - 1

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(1))

    def _grow(self, start: int, end: int, centre: int, leaf: int) -> None:
        if start == end:
            return
        far = self._far(self.order, centre)
        todo = [self._node(start, end, centre, float(far.max()))]
        while todo:
            node = todo.pop()
            start, end = self.rows[node]
            r = self.radius[node]
            if end - start <= leaf or r == 0:
                continue
            rows, sets, loose, misses, middle = self.order[start:end], [], [], 0, self.centre[node]
            while len(rows):
                far = self._far(rows, middle)
                near = far <= r / 2
                if near.sum() >= max(2, leaf // 8):
                    sets.append((rows[near], middle, float(far[near].max())))
                else:  # a covering of so few rows would be no quicker than the rows themselves
                    loose.append(rows[near])
                    misses += 1
                rows = rows[~near]
                if misses >= MISSES and misses > len(sets):
                    loose.append(rows)
                    break
                if len(rows):
                    middle = int(rows[0])
            if not sets:
                continue
            if rest := sum(map(len, loose)):
                together = np.concatenate(loose)
                sets.append((together, self.centre[node], float(self._far(together, self.centre[node]).max())))
            at = start
            for k, (part, c, radius) in enumerate(sets):
                self.order[at : at + len(part)] = part
                child = self._node(at, at + len(part), c, radius)
                self.children[node].append(child)
                at += len(part)
                if k < len(sets) - bool(rest):  # loose rows were tried
                    todo.append(child)


def _angles(inner: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Angles of vectors from their inner products and products of norms, never too small; zero vectors have none."""
    return np.where(norms > 0, np.arccos(np.clip(inner / np.maximum(norms, 1e-300), -1, 1)) + 1e-7, 0.0)


def limits(inner: np.ndarray, c: np.ndarray, d: np.ndarray, r: np.ndarray, s: np.ndarray, angles: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """The most that an inner product of two nodes' rows can be: by their balls, and by the cones around their centres.

    inner: that of the centres; c, d: their norms; r, s: radii; angles: the sum of both cones'; largest: the product of
    the largest norms.
    """
    by_balls = inner + c * s + d * r + r * s
    apart = np.maximum(np.arccos(np.clip(inner / np.maximum(c * d, 1e-300), -1, 1)) - 1e-7 - angles, 0)
    by_cones = np.where(c * d > 0, largest * np.maximum(np.cos(apart), 0), np.inf)
    return np.minimum(by_balls, by_cones)


class Search:
    """The best `k` (score, id) pairs of each query of a block, over the blocks it has met."""

    def __init__(self, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> None:
        self.tree, self.k, self.met = CoverTree(queries, QUERY_LEAF), k, 0
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), NONE)
        self.floors = np.full(len(queries), -np.inf) if floors is None else floors

    def worst(self, node: int) -> float:
        a, b = self.tree.rows[node]
        rows = self.tree.order[a:b]
        return float(np.maximum(self.scores[rows, -1], self.floors[rows]).min())

    def meet(self, data: CoverTree, ids: np.ndarray) -> None:
        """ids: a row for each data row, its least ids in order, filled up with the largest integer."""
        if not len(self.tree.centre) or not len(data.centre):
            return
        q, rank = self.tree, np.argsort(np.argsort(ids[:, 0], kind="stable"))
        heap = [(-np.inf, 0, 0)]
        while heap:
            bound, a, b = heapq.heappop(heap)
            if -bound < self.worst(a) - 0.25:
                continue
            if not q.children[a] and not data.children[b]:
                self._score(a, b, data, ids, rank)
                continue
            split_query = bool(q.children[a]) and (not data.children[b] or q.radius[a] >= data.radius[b])
            pairs = [(x, b) for x in q.children[a]] if split_query else [(a, y) for y in data.children[b]]
            i, j = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
            inner = (q.points[q.middles[i]] * data.points[data.middles[j]]).sum(1)
            bounds = limits(inner, q.norm[i], data.norm[j], q.radii[i], data.radii[j], q.angle[i] + data.angle[j], q.largest[i] * data.largest[j])
            for pair, limit in zip(pairs, bounds.tolist(), strict=True):
                if limit >= self.worst(pair[0]) - 0.25:
                    heapq.heappush(heap, (-limit, *pair))

    def _score(self, a: int, b: int, data: CoverTree, ids: np.ndarray, rank: np.ndarray) -> None:
        rows = self.tree.order[slice(*self.tree.rows[a])]
        columns = data.order[slice(*data.rows[b])]
        self.met += len(rows) * len(columns)
        found = self.tree.points[rows] @ data.points[columns].T
        hit = found >= np.maximum(self.scores[rows, -1], self.floors[rows])[:, None]
        some, these = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(some):
            return
        rows, columns, found = rows[some], columns[these], np.where(hit, found, -np.inf)[np.ix_(some, these)]
        order = np.lexsort((np.broadcast_to(rank[columns], found.shape), -found), axis=1)[:, : self.k]
        picked = np.take_along_axis(found, order, 1)
        scores = np.concatenate([self.scores[rows], np.repeat(picked, ids.shape[1], axis=1)], axis=1)
        known = np.concatenate([self.ids[rows], ids[columns[order]].reshape(len(rows), -1)], axis=1)
        scores[known == NONE] = -np.inf
        known[scores == -np.inf] = NONE
        best = np.lexsort((known, -scores), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, best, 1), np.take_along_axis(known, best, 1)


def _matrix(structs: pa.StructArray, name: str) -> np.ndarray:
    lists = structs.field(name)
    n = len(structs)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) if n else np.zeros((0, 0))


def _filled(lists: pa.ListArray, width: int) -> np.ndarray:
    out = np.full((len(lists), width), NONE)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _search(k: int):
    """Scores block pairs: columns `queries` (rep, vec, floor) and `data` (ids, vec), arrays of structs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                queries, data = (batch.column(c)[row].values for c in ("queries", "data"))
                search = Search(_matrix(queries, "vec"), k, queries.field("floor").to_numpy(zero_copy_only=False))
                search.meet(CoverTree(_matrix(data, "vec")), _filled(data.field("ids"), k))
                real = search.ids != NONE
                reps = np.repeat(queries.field("rep").to_numpy(zero_copy_only=False), k).reshape(-1, k)
                yield pa.record_batch([pa.array(reps[real]), pa.array(search.ids[real]), pa.array(search.scores[real].astype(np.int64))], names=["query", "vec_id", "score"])

    return run


def quantised(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vec, floor(256 x) of each component, of the vectors that take part."""
    solid = F.col("vec_id").isNotNull() & F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.coalesce(solid, F.lit(False))).select("vec_id", F.transform(column, lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vec"))


def _cells(rows: DataFrame, pivots: np.ndarray, columns: list[str]) -> DataFrame:
    """Adds cell, the number of the nearest pivot, the distance and angle to it, and the norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (pivots**2).sum(1)
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            inner = x @ pivots.T
            cell = np.argmin(squares[None] - 2 * inner, axis=1)
            far, norm = np.sqrt(((x - pivots[cell]) ** 2).sum(1)), np.sqrt((x**2).sum(1))
            angle = _angles(inner[np.arange(len(x)), cell], norm * np.sqrt(squares[cell]))
            yield pa.record_batch([*[batch.column(c) for c in columns], pa.array(cell.astype(np.int32)), pa.array(far), pa.array(angle), pa.array(norm)], names=[*columns, "cell", "far", "angle", "norm"])

    kinds = dict(rows.dtypes)
    return rows.select(*columns).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", cell int, far double, angle double, norm double")


def _reaching(queries: DataFrame, centres: np.ndarray, cells: dict[str, np.ndarray]) -> DataFrame:
    """rep, vec, floor and every cell but the own one that may hold a score of floor or more.

    cells: reach (negative: empty), angle and largest norm of every cell's data.
    """
    reach, size = cells["reach"], np.sqrt((centres**2).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            norm = np.sqrt((x**2).sum(1))[:, None]
            bound = limits(x @ centres.T, norm, size[None], 0.0, np.maximum(reach, 0)[None], cells["angle"][None], norm * cells["largest"][None])
            floor = batch.column("floor").to_numpy(zero_copy_only=False)
            row, cell = np.nonzero((bound + 0.25 >= floor[:, None]) & (np.arange(len(reach))[None] != batch.column("cell").to_numpy()[:, None]) & (reach >= 0)[None])
            part = batch.take(pa.array(row))
            yield pa.record_batch([part.column("rep"), part.column("vec"), part.column("floor"), pa.array(cell.astype(np.int32))], names=["rep", "vec", "floor", "cell"])

    return queries.select("rep", "vec", "floor", "cell").mapInArrow(run, "rep long, vec array<long>, floor double, cell int")


def _blocks(rows: DataFrame, counts: dict[int, int], size: int, fields: list[str], name: str, number: str, n_cells: int) -> DataFrame:
    """Rows gathered as arrays of about `size` structs: cell, the block's number and the array."""
    block = F.pmod(F.xxhash64("rep"), _parts(counts, size, n_cells))
    return rows.withColumn(number, block).groupBy("cell", number).agg(F.collect_list(F.struct(*fields)).alias(name))


def _parts(counts: dict[int, int], size: int, n_cells: int) -> Column:
    """How many blocks of about `size` rows the row's cell has."""
    parts = F.array(*[F.lit(-(-counts.get(c, 0) // size) or 1).cast("long") for c in range(n_cells)])
    return F.element_at(parts, F.col("cell") + 1)


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, column: str = "embedding", pivots: int | None = None, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best others.

    is_query: a condition on vec_id that says which rows are queries; all rows are candidates. pivots: by default one for
    two blocks' rows, at least 16 and at most PIVOTS.
    """
    rows = quantised(embeddings, column)
    n_rows, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n_rows or not width:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = pivots or min(PIVOTS, max(16, n_rows // (2 * block)))
    rows = checkpoint(rows.select("vec_id", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec"))).alias("vec")).distinct())
    first = Window.partitionBy("vec").orderBy("vec_id")
    least = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)  # also cut before the shuffle
    data = least.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    data = data.select("rep", "vec", "ids")
    asked = rows.where(is_query).select("vec_id", "vec")
    sample = data.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(pivots).collect()  # bounded
    centres = np.array([r[0] for r in sample], float).reshape(len(sample), width)
    data = checkpoint(_cells(data, centres, ["rep", "vec", "ids"]))
    n_asked = asked.count()
    sizes = asked.groupBy("vec").agg(F.count("*").alias("n"))
    held = data.select("rep", "vec", "cell").join(sizes, "vec")
    owners = checkpoint(dealt(asked, held, ["vec"], n_asked, "vec_id", sizes=sizes))  # a row for each query
    queries = checkpoint(owners.groupBy("rep").agg(F.first("vec").alias("vec"), F.first("cell").alias("cell")))
    n = len(centres)
    figures = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("reach"), F.max("angle").alias("angle"), F.max("norm").alias("largest")).collect()  # a row for each pivot
    counts, cells = {r["cell"]: r["n"] for r in figures}, {name: np.full(n, -1.0 if name == "reach" else 0.0) for name in ("reach", "angle", "largest")}
    for r in figures:
        for name, values in cells.items():
            values[r["cell"]] = r[name]
    counted = lambda df: {r["cell"]: r["n"] for r in df.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    found = _blocks(data, counts, block, ["ids", "vec"], "data", "block", n)

    def searched(wanted: DataFrame) -> DataFrame:
        """The queries of each cell in groups, each of which meets every block of the cell on its own."""
        groups = _blocks(wanted, counted(wanted), group, ["rep", "vec", "floor"], "queries", "group", n)
        each = groups.select("cell", "queries", F.explode(F.sequence(F.lit(0).cast("long"), _parts(counts, block, n) - 1)).alias("block"))
        return each.join(found, ["cell", "block"]).select("queries", "data").mapInArrow(_search(k + 1), HITS)

    seeds = checkpoint(searched(queries.withColumn("floor", F.lit(float("-inf")))))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    kth = seeds.withColumn("n", F.row_number().over(ranked)).where(F.col("n") == k + 1).select(F.col("query").alias("rep"), F.col("score").cast("double").alias("floor"))

    # the other cells that each query's kth score leaves
    known = queries.join(kth, "rep", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    more = searched(checkpoint(_reaching(known, centres, cells)))

    hits = seeds.unionAll(more).withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1).drop("n")
    lists = hits.groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("best"))  # k + 1 at most
    sizes = owners.groupBy(F.col("rep").alias("query")).agg(F.count("*").alias("n"))
    lists = lists.join(sizes, "query")
    each = dealt(owners.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")), lists, ["query"], n_asked, "query_id", sizes=sizes)
    pairs = each.select("query_id", F.inline("best")).where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
