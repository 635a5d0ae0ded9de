"""Quality classifier: Bradley-Terry pairwise ranking of documents.

A document's strength is linear in its features. Pairs of one good and one bad training row give the
logistic loss on their feature differences, which Newton steps minimise. The rejecting cut is a quantile of
the training strengths, at the share of bad rows. The returned score is a logistic curve of the strength
that passes through `at_cut` (0.3) at the cut.

Features come from the text alone: rates of the rule statistics, and shares of hashed character triples and words, which
tell language from noise of the same shape. Null and empty texts have the features of no words and are scored like
any other. Of contradicting labels of a document the better one counts; of rows repeated with the same doc_id the least
text trains. Without training rows of both labels every score is 0.5. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, passes
from .quality_rules import SAMPLE_ROWS, labelled_texts, rates
from .textscan import grams, statistics

FOLDS = 5
#: Hashed buckets of character triples, and as many of words; their weight in the ridge beside the rates.
BUCKETS, GRAM_SCALE = 64, 0.1


def held_out(column: str = "doc_id"):
    """Whether a row lies in the fold that learns nothing: the fold of a null id is none."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == 0, F.lit(False))


def features(texts: pa.Array) -> np.ndarray:
    """Rates of the rule statistics, then the roots of the shares of hashed character triples and words."""
    x = statistics(texts)
    words = np.maximum(x["n_words"], 1)
    rules = [rates(x), np.log1p(x["n_words"]), np.log1p(words / np.maximum(x["n_lines"], 1)), np.log1p(x["n_distinct_words"]) / np.log1p(words), (x["n_symbols"] + x["n_marks"]) / words]
    return np.column_stack([*rules, np.sqrt(grams(texts, BUCKETS))])


@dataclass
class Ranker:
    knots: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    at_cut: float

    @staticmethod
    def bent(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
        """Each rate and its excess over each knot, so that strengths are piecewise linear in it; grams as they are."""
        rules = x[:, : knots.shape[1]]
        return np.column_stack([rules, *[np.maximum(rules - k, 0) for k in knots], x[:, knots.shape[1] :]])

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, pairs: int = 20_000, ridge: float = 1e-3, at_cut: float = 0.3, seed: int = 11) -> "Ranker | None":
        if good.all() or not good.any():
            return None
        rng = np.random.default_rng(seed)
        rules = x.shape[1] - 2 * BUCKETS
        knots = np.quantile(x[:, :rules], [0.25, 0.5, 0.75, 0.9, 0.97], axis=0)
        z = cls.bent(x, knots)
        centre, spread = z.mean(0), z.std(0)
        spread[spread < 1e-12] = 1
        spread[len(spread) - 2 * BUCKETS :] /= GRAM_SCALE
        z = (z - centre) / spread
        d = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
        w = np.zeros(d.shape[1])
        for _ in range(12):  # near-separable pairs gain little after
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # that the bad one wins
            gradient = d.T @ p / pairs - ridge * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w += step
            if np.abs(step).max() < 1e-3:
                break
        strength = z @ w
        ordered, share = np.sort(strength), (~good).mean()
        k = min(len(ordered) - 1, max(1, round(share * len(ordered))))
        cut = float((ordered[k - 1] + ordered[k]) / 2)
        return cls(knots, centre, spread, w, cut, 4.0 / max(float(strength.std()), 1e-9), at_cut)

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = (self.bent(x, self.knots) - self.centre) / self.spread @ self.weights
        middle = np.log(self.at_cut / (1 - self.at_cut))
        return 1 / (1 + np.exp(-np.clip((strength - self.cut) * self.slope + middle, -40, 40)))


def fit_ranker(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, pairs: int = 20_000) -> Ranker | None:
    """Fits on at most `most` labelled rows outside the held-out fold."""
    rows = labelled_texts(docs, labels.where(~held_out()), most)
    names = [f"x{k}" for k in range(features(pa.array([""])).shape[1])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = features(batch.column("text"))
        return pa.record_batch([batch.column("doc_id"), batch.column("quality"), *[pa.array(c) for c in found.T]], names=["doc_id", "quality", *names])

    kind = dict(rows.dtypes)["doc_id"]
    found = map_texts(rows, ["doc_id", "quality", "text"], "text", run, f"doc_id {kind}, quality int, " + ", ".join(f"{x} double" for x in names)).toPandas()
    if not len(found):
        return None
    found = found.sort_values(["doc_id", *names], ignore_index=True)
    return Ranker.fit(found[names].to_numpy(), found["quality"].to_numpy() == 1, pairs)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= cut), a row per row of docs."""
    ranker = fit_ranker(docs, labels, **options)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = ranker.score(features(batch.column("text"))) if ranker else np.full(batch.num_rows, 0.5)
        return pa.record_batch([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = map_texts(docs, ["doc_id", "text"], "text", run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **options) -> DataFrame:
    """The rows of docs, all their columns, whose score is at least `cut`."""
    ranker = fit_ranker(docs, labels, **options)
    names = docs.columns

    def run(batches):
        for batch in passes(batches, "text"):
            if ranker:
                batch = batch.filter(pa.array(ranker.score(features(batch.column("text"))) >= cut))
            yield batch

    return docs.mapInArrow(run, docs.schema).select(*names)
