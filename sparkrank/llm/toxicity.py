"""Toxicity: a linear classifier on character n-grams, scaled by their naive Bayes log-count ratios.

A feature says whether an n-gram of 3 to 6 characters occurs in a text. Texts are lower-cased, ASCII marks and white space count as
spaces, and a text begins and ends with a space, so that grams know where words end. A gram's scale is the logarithm of its share among toxic rows
over its share among the others, both smoothed by one; logistic loss with a ridge fits the weights on the scaled features.

Which grams are features is learned as well: those whose two shares differ most against chance. Shares are first
counted for hashed buckets of grams, then in the best buckets for the grams themselves, told apart by 64-bit hashes. So a long text,
which holds grams of nearly every bucket, sets no feature whose gram it doesn't hold, and needs no scaling by its length.

At most `most` labelled rows (SAMPLE_ROWS by default, those of least hash) outside the held-out fold fit it; every row is scored, from its
whole text. Null and empty texts have no features and are scored like any other: by the intercept. Of contradicting
labels of a document the toxic one counts; of rows repeated with the same doc_id the least text trains. Without training rows of both
labels every score is 0.5. Repeated rows score alike. Nothing but the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bradley_terry import held_out
from .common import map_texts, texts_of
from .textscan import mix

#: Labelled rows that fit the classifier at most.
SAMPLE_ROWS = 20_000
SIZES = (3, 4, 5, 6)
#: Buckets that grams are counted in first, how many of them are looked into, and how many grams become features.
BUCKETS, LOOKED_INTO, FEATURES = 1 << 20, 4096, 768
#: Rows of the fit's matrix that are floats at a time.
BLOCK = 4096
#: Characters that one numpy pass hashes; a longer text goes by slices that overlap by a gram less one.
SLICE = 1 << 19

_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_SPACED = np.arange(128, dtype=np.uint32)
_SPACED[[c for c in range(128) if not chr(c).isalnum()]] = 32


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, marks as spaces, a space around each text; which text each belongs to begins where."""
    parts = [f" {t.lower()} " for t in texts_of(texts).to_pylist()]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    plain = codes < 128
    codes[plain] = _SPACED[codes[plain]]
    return codes, np.cumsum([0, *map(len, parts)])


def grams(codes: np.ndarray, bounds: np.ndarray, wanted: np.ndarray):
    """(text, hash) of the grams whose bucket is wanted (a flag for each), in slices; a gram that occurs again may come again."""
    longest = SIZES[-1]
    for at in range(0, len(codes), SLICE):
        part = codes[at : at + SLICE + longest - 1].astype(np.uint64)
        here = min(SLICE, len(codes) - at)
        value = part[: len(part)] * _STEPS[0]
        for n in range(2, longest + 1):
            if len(part) < n:
                break
            value = value[: len(part) - n + 1] + part[n - 1 :] * _STEPS[n - 1]
            if n not in SIZES:
                continue
            first = value[:here]
            hashed = mix(first + np.uint64(n))
            hits = np.flatnonzero(wanted[(hashed & np.uint64(BUCKETS - 1)).astype(np.int64)])
            text = np.searchsorted(bounds, hits + at, "right") - 1
            whole = hits + at + n <= bounds[text + 1]
            yield text[whole], hashed[hits[whole]]


def distinct_grams(texts: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct grams in wanted buckets, by text."""
    codes, bounds = characters(texts)
    found = [np.stack([text.astype(np.uint64), hashed]) for text, hashed in grams(codes, bounds, wanted)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    both = np.concatenate(found, 1)
    order = np.lexsort((both[1], both[0]))
    both = both[:, order]
    first = np.ones(both.shape[1], bool)
    first[1:] = (both[:, 1:] != both[:, :-1]).any(0)
    return both[0, first].astype(np.int64), both[1, first]


def ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of grams that so many rows of each kind hold, and how far the two shares are apart in standard deviations."""
    a, b = (toxic + 1) / (n_toxic + 2), (other + 1) / (n_other + 2)
    pooled = (toxic + other + 1) / (n_toxic + n_other + 2)
    return np.log(a / b), (toxic / n_toxic - other / n_other) / np.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / n_other))


@dataclass
class Classifier:
    """hashes: the features' grams, sorted; values: weight times ratio of each; intercept."""

    hashes: np.ndarray
    values: np.ndarray
    intercept: float

    @classmethod
    def fit(cls, rows: list[np.ndarray], toxic: np.ndarray, features: int = FEATURES, ridge: float = 1.0) -> "Classifier":
        """rows: the distinct hashes of each text that may be features."""
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        every = np.concatenate([np.zeros(0, np.uint64), *rows])
        known, index = np.unique(every, return_inverse=True)
        counts = [np.bincount(index[toxic[owner] == kind], minlength=len(known)).astype(float) for kind in (True, False)]
        ratio, apart = ratios(*counts, int(toxic.sum()), int((~toxic).sum()))
        best = np.sort(np.lexsort((known, -np.abs(apart)))[:features])
        slot = np.full(len(known), -1)
        slot[best] = np.arange(len(best))
        holds = np.zeros((len(rows), len(best)), np.uint8)
        used = slot[index] >= 0
        holds[owner[used], slot[index[used]]] = 1
        scale, y = ratio[best].astype(np.float32), toxic.astype(np.float32)
        w, b = np.zeros(len(best)), float(np.log(toxic.mean() / (1 - toxic.mean())))
        for _ in range(25):  # Newton steps on weights and intercept, in blocks of rows
            gradient, hessian = np.append(-ridge * w, 0.0), np.diag(np.append(np.full(len(w), ridge), 1e-9))
            for at in range(0, len(rows), BLOCK):
                x = np.column_stack([holds[at : at + BLOCK] * scale, np.ones(len(y[at : at + BLOCK]), np.float32)])
                p = 1 / (1 + np.exp(-np.clip(x @ np.append(w, b).astype(np.float32), -30, 30)))
                gradient += x.T @ (y[at : at + BLOCK] - p)
                x *= np.sqrt(np.maximum(p * (1 - p), 1e-6))[:, None]
                hessian += x.T @ x
            change = np.linalg.solve(hessian, gradient)
            change *= min(1.0, 2.0 / max(float(np.abs(change).max()), 1e-12))
            w, b = w + change[:-1], b + float(change[-1])
            if np.abs(change).max() < 1e-3:
                break
        return cls(known[best], w * ratio[best], b)

    def score(self, texts: pa.Array) -> np.ndarray:
        wanted = np.zeros(BUCKETS, bool)
        wanted[(self.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)] = True
        text, hashed = distinct_grams(texts, wanted)
        total = np.full(len(texts), self.intercept)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
            hit = self.hashes[at] == hashed
            np.add.at(total, text[hit], self.values[at[hit]])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, toxic and text of at most `most` labelled documents outside the held-out fold, those of least hash; one row for each."""
    picked = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most `most` narrow rows
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit_classifier(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, features: int = FEATURES) -> Classifier | None:
    rows = labelled_texts(docs, labels, most)
    kind = dict(rows.dtypes)["doc_id"]

    def bucket_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        """How many toxic and other rows of a pass hold a gram of each bucket."""
        codes, bounds = characters(batch.column("text"))
        every, counts = np.ones(BUCKETS, bool), np.zeros((2, BUCKETS), np.int64)
        for start, end, toxic in zip(bounds[:-1], bounds[1:], batch.column("toxic").to_pylist(), strict=True):
            own = np.concatenate([hashed & np.uint64(BUCKETS - 1) for _, hashed in grams(codes[start:end], np.array([0, end - start]), every)] or [np.zeros(0, np.uint64)])
            counts[toxic, np.unique(own.astype(np.int32))] += 1
        held = np.flatnonzero(counts.any(0))
        return pa.record_batch([pa.array(held), pa.array(counts[1, held]), pa.array(counts[0, held])], names=["bucket", "toxic", "other"])

    kinds = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return None
    counted = map_texts(rows, ["toxic", "text"], "text", bucket_counts, "bucket long, toxic long, other long")
    counted = counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    a, b, n = F.col("toxic"), F.col("other"), {k: float(v) for k, v in kinds.items()}
    pooled = (a + b + 1) / (n[0] + n[1] + 2)
    apart = F.abs(a / n[1] - b / n[0]) / F.sqrt(pooled * (1 - pooled))
    best = [r["bucket"] for r in counted.orderBy(apart.desc(), "bucket").select("bucket").limit(LOOKED_INTO).collect()]
    wanted = np.zeros(BUCKETS, bool)
    wanted[best] = True

    def candidates(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, hashed = distinct_grams(batch.column("text"), wanted)
        ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashed.view(np.int64)))
        return pa.record_batch([batch.column("doc_id"), batch.column("toxic"), found], names=["doc_id", "toxic", "grams"])

    held = map_texts(rows, ["doc_id", "toxic", "text"], "text", candidates, f"doc_id {kind}, toxic int, grams array<long>").toPandas().sort_values("doc_id", ignore_index=True)
    return Classifier.fit([np.asarray(g, np.int64).view(np.uint64) for g in held["grams"]], held["toxic"].to_numpy() == 1, features)


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= cut), a row per row of docs."""
    classifier = fit_classifier(docs, labels, **options)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = classifier.score(batch.column("text")) if classifier else np.full(batch.num_rows, 0.5)
        return pa.record_batch([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = map_texts(docs, ["doc_id", "text"], "text", run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
