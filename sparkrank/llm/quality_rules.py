"""Quality rules: fixed rules on text statistics, then an isolation forest over their rates.

Rule statistics of a text (null text: empty, all zero), over the whole text:
n_words, word_chars (code points in words), n_chars, n_symbols (of ``#*$%&|<>``), n_upper, n_lower,
n_digits (ASCII), n_marks (``!?``), n_lines (lines holding a word), n_dup_lines (such lines equal to an
earlier one), n_repeat_words (words in five-word windows found twice or more, the first included) and
n_distinct_words.

A text fails the base rules when it has under 10 words, or when over a fifth of its words lie in repeated
windows. The forest judges the rest. It grows on rows labelled good, its random splits range over all labelled rows, so
rows that few splits isolate are anomalous; all labelled rows of both kinds set the cut, and at least `least_kept`
of the good ones stay. Without
labelled rows of both kinds there is no cut, and only the base rules hold. Rates don't depend on length,
so long or short texts are no anomalies as such. Repeated rows are judged one by one, alike. Of contradicting labels of a document
the better one counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts
from .textscan import statistics

STATISTICS = ["n_words", "word_chars", "n_chars", "n_symbols", "n_upper", "n_lower", "n_digits", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words"]
#: Labelled rows that fit the classifier of `bradley_terry` at most.
SAMPLE_ROWS = 20_000
#: Steps that anomalies are rounded up to where the cut is looked for: what the driver gets of all labelled rows.
STEPS = 1 << 16


def rule_statistics(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The named columns of docs (doc_id by default) and the rule statistics of `text`."""
    columns = columns or ["doc_id"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = statistics(batch.column("text"))
        return pa.record_batch([*[batch.column(c) for c in columns], *[pa.array(found[k]) for k in STATISTICS]], names=[*columns, *STATISTICS])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in columns], *[f"{k} long" for k in STATISTICS]])
    return map_texts(docs, [*columns, "text"], "text", run, schema)


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, quality and text of all labelled documents, or of at most `most`, those of least hash.

    One row for each, however often labels or documents repeat it: the better label and the least text.
    """
    picked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    if most is not None:
        picked = F.broadcast(picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # at most `most` narrow rows
    rows = docs.select("doc_id", "text").join(picked, "doc_id")
    return rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def labelled_statistics(docs: DataFrame, labels: DataFrame):
    """Statistics and `quality` of all labelled documents, in pandas: for tables whose labelled rows a driver holds."""
    return labelled_rules(docs, labels).toPandas().sort_values("doc_id", ignore_index=True)


def labelled_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality and the rule statistics of all labelled documents."""
    return rule_statistics(labelled_texts(docs, labels), ["doc_id", "quality"])


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def rates(x: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of length-free rates."""
    words, letters, lines = np.maximum(x["n_words"], 1), np.maximum(x["n_upper"] + x["n_lower"], 1), np.maximum(x["n_lines"], 1)
    return np.column_stack([x["n_symbols"] / words, x["n_marks"] / words, x["n_upper"] / letters, x["n_dup_lines"] / lines, x["n_repeat_words"] / words, x["word_chars"] / words, x["n_digits"] / np.maximum(x["word_chars"], 1)]).astype(float)


def forest_columns(x: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of symbols, marks, capitals, repeated lines and repeated words; logarithms spread the small ones."""
    return np.log1p(20 * rates(x)[:, :5])


def usual_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n entries."""
    n = np.asarray(n, float)
    many = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many))


@dataclass
class Forest:
    """Trees level by level in arrays: the split column (-1: leaf), its value, the left child and the path length."""

    column: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    sample: int
    cut: float | None = None

    @classmethod
    def fit(cls, x: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = 200, sample: int = 256, seed: int = 7) -> "Forest":
        """x: rows of the usual kind. box: least and largest values seen anywhere, which splits are drawn from;
        where x hasn't rows, a few splits lead to an empty cell."""
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x))
        deepest = 2 * max(1, int(np.ceil(np.log2(max(sample, 2)))))
        made = []
        for _ in range(trees):
            nodes: list[list] = [[-1, 0.0, 0, 0.0]]
            todo = [(0, rng.choice(len(x), sample, replace=False), 0, *box)]
            while todo:
                node, rows, depth, low, high = todo.pop()
                part = x[rows]
                open_columns = np.flatnonzero(high > low)
                if depth >= deepest or len(rows) <= 1 or not len(open_columns):
                    nodes[node][3] = depth + float(usual_path(len(rows)))
                    continue
                c = int(rng.choice(open_columns))
                v = float(rng.uniform(low[c], high[c]))
                goes = part[:, c] < v
                left = len(nodes)
                nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
                nodes[node] = [c, v, left, 0.0]
                under, over = high.copy(), low.copy()
                under[c] = over[c] = v
                todo += [(left, rows[goes], depth + 1, low, under), (left + 1, rows[~goes], depth + 1, over, high)]
            made.append(nodes)
        width = max(map(len, made))
        grid = np.zeros((trees, width, 4))
        grid[:, :, 0] = -1
        for i, nodes in enumerate(made):
            grid[i, : len(nodes)] = nodes
        return cls(grid[:, :, 0].astype(np.int64), grid[:, :, 1], grid[:, :, 2].astype(np.int64), grid[:, :, 3], sample)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; about 0.5 for usual rows."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for column, value, left, path in zip(self.column, self.value, self.left, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                c = column[at]
                inner = c >= 0
                if not inner.any():
                    break
                at = np.where(inner, left[at] + (x[rows, np.maximum(c, 0)] >= value[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.column) / max(float(usual_path(self.sample)), 1e-9))

    def calibrate(self, x: np.ndarray, good: np.ndarray, least_kept: float) -> None:
        """The cut from rows at hand."""
        at, index = np.unique(self.anomaly(x), return_inverse=True)
        self.cut_between(at, np.bincount(index[good], minlength=len(at)), np.bincount(index[~good], minlength=len(at)), least_kept)

    def cut_between(self, at: np.ndarray, good: np.ndarray, bad: np.ndarray, least_kept: float) -> None:
        """The cut with most good rows kept plus bad rows dropped, raised until `least_kept` of the good ones stay.

        good, bad: how many rows have each anomaly of `at`, which ascends.
        """
        if not good.sum() or not bad.sum():
            return
        kept = np.cumsum(good) / good.sum()
        gain = kept - np.cumsum(bad) / bad.sum()
        self.cut = float(max(at[len(at) - 1 - gain[::-1].argmax()], at[np.searchsorted(kept, least_kept)]))


def fit_forest(docs: DataFrame, labels: DataFrame, least_kept: float = 0.995, trees: int = 200, sample: int = 256) -> Forest | None:
    """A forest over rows labelled good, with split ranges and cut from all labelled rows.

    A tree is grown on `sample` rows, as isolation forests are, drawn from as many good rows of least hash as all trees take; the
    ranges and the counts behind the cut are aggregates over every labelled row.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    try:
        rows = scratch.save(labelled_rules(docs, labels).where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words"))  # as base_failed
        columns = [f"x{k}" for k in range(5)]
        kind = dict(rows.dtypes)["doc_id"]

        def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = forest_columns({k: batch.column(k).to_numpy() for k in STATISTICS})
                yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), *[pa.array(c) for c in x.T]], names=["doc_id", "quality", *columns])

        rates_of = scratch.save(rows.mapInArrow(rated, f"doc_id {kind}, quality int, " + ", ".join(f"{c} double" for c in columns)))
        box = rates_of.agg(*[F.min(c) for c in columns], *[F.max(c) for c in columns]).first()
        usual = rates_of.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(trees * sample).select("doc_id", *columns).toPandas()
        if not len(usual):
            return None
        usual = usual.sort_values("doc_id", ignore_index=True)
        forest = Forest.fit(usual[columns].to_numpy(), (np.array(box[:5]), np.array(box[5:])), trees, sample)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = np.ceil(forest.anomaly(np.column_stack([batch.column(c).to_numpy() for c in columns])) * STEPS)
                yield pa.record_batch([batch.column("quality"), pa.array(step.astype(np.int64))], names=["quality", "step"])

        counts = rates_of.mapInArrow(scored, "quality int, step long").groupBy("step").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
        counts = counts.toPandas().sort_values("step")  # a row for each step at most
        forest.cut_between(counts["step"].to_numpy() / STEPS, counts["good"].to_numpy(), counts["bad"].to_numpy(), least_kept)
        return forest
    finally:
        scratch.close()


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base statistics, anomaly (null without a forest), base_failed and kept, a row per row of docs."""
    forest = fit_forest(docs, labels, **options)
    keys = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = statistics(batch.column("text"))
        failed = base_failed(found["n_words"], found["n_repeat_words"])
        anomaly = forest.anomaly(forest_columns(found)) if forest else np.full(batch.num_rows, np.nan)
        kept = ~failed & (True if forest is None or forest.cut is None else anomaly <= forest.cut)
        return pa.record_batch([batch.column("doc_id"), *[pa.array(found[k]) for k in keys], pa.array(anomaly, mask=np.isnan(anomaly)), pa.array(failed), pa.array(kept)], names=["doc_id", *keys, "anomaly", "base_failed", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_texts(docs, ["doc_id", "text"], "text", run, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in keys) + ", anomaly double, base_failed boolean, kept boolean")
