"""Quality classification by ordinal cumulative-link regression.

Grades 0 .. K - 1 share one weight vector over hashed text features; K - 1 ordered thresholds cut the score:
P(grade <= k) = sigmoid(threshold_k - score). That gives the expected grade and any tail probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._features import adam, bounded_sample, collect_features, feature_blocks, shapes_and_words, sigmoid

DIMS = 2048


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, K - 1 of them

    def tails(self, x: np.ndarray) -> np.ndarray:
        """(n, K - 1): probabilities of grade >= 1, >= 2, ..."""
        return sigmoid((x @ self.weights)[:, None] - self.thresholds[None, :])


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "grade", text: str = "text", doc_id: str = "doc_id", most_per_grade: int = 2000, steps: int = 200) -> OrdinalModel:
    """Fit on ``ratings`` (doc_id, grade): about ``most_per_grade`` of each grade (by hash of doc_id), whole texts.

    Rows without text, doc_id or grade teach nothing; grades are integers from 0. With fewer than two grades every tail
    probability is a half. Rows count so that each grade keeps its share of the corpus.
    """
    rows = ratings.select(F.col(doc_id).alias("doc_id"), F.col(grade).cast("int").alias("grade")).filter("doc_id IS NOT NULL AND grade >= 0").dropDuplicates(["doc_id"])
    share = {r.grade: r["count"] for r in rows.groupBy("grade").count().collect()}
    if len(share) < 2:
        return OrdinalModel(np.zeros(DIMS, np.float32), np.zeros(max(1, max(share, default=1)), np.float32))
    chosen = F.broadcast(bounded_sample(rows, "grade", most_per_grade, "doc_id"))  # a bounded number of rows
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    x, got = collect_features(texts.join(chosen, "doc_id"), "grade", shapes_and_words, DIMS)
    if not len(x):
        return OrdinalModel(np.zeros(DIMS, np.float32), np.zeros(max(share), np.float32))
    y, k = np.array(got), max(share) + 1
    have = np.bincount(y, minlength=k)
    weight = np.array([share.get(g, 0) / max(have[g], 1) for g in range(k)])[y]
    weight /= weight.sum()
    scale = 1 / (x.std(axis=0) + 0.01)
    xs = x * scale
    mean = xs.mean(axis=0)
    xs -= mean
    total = sum(share.values())
    below = np.clip(np.cumsum([share.get(g, 0) / total for g in range(k)])[:-1], 1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    # Thresholds stay ordered: the first one is free, the others are sums of positive steps.
    free = np.r_[start[:1], np.log(np.maximum(np.diff(start), 1e-2))]
    edges = lambda f: np.cumsum(np.r_[f[:1], np.exp(f[1:])])

    def gradient(p: list[np.ndarray]) -> list[np.ndarray]:
        t = np.r_[-np.inf, edges(p[1]), np.inf]
        z = xs @ p[0]
        upper, lower = sigmoid(t[y + 1] - z), np.where(y > 0, sigmoid(t[y] - z), 0)
        chance = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper), lower * (1 - lower)
        by_z = weight * (up - low) / chance  # of the negative log-likelihood
        by_t = np.zeros(k - 1)
        np.add.at(by_t, y[y < k - 1], -(weight * up / chance)[y < k - 1])
        np.add.at(by_t, y[y > 0] - 1, (weight * low / chance)[y > 0])
        above = np.cumsum(by_t[::-1])[::-1]
        return [(xs.T @ by_z.astype(np.float32)) + 5e-4 * p[0], np.r_[above[:1], above[1:] * np.exp(p[1][1:])]]

    w, f = adam(gradient, [np.zeros(DIMS, np.float32), free], steps, 0.03)
    return OrdinalModel((w * scale).astype(np.float32), (edges(f) + float(mean @ w)).astype(np.float64))


def rate(docs: DataFrame, model: OrdinalModel, least_grade: int = 1, least_probability: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected) of every whole text, one row per input row.

    ``tail_probability`` is P(grade >= least_grade); ``selected`` where it reaches ``least_probability``. Null and empty
    texts have no feature: they get the model's value for a score of zero. Only the text is used; other columns are
    ignored, whatever their names, and repeated rows give a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            expected, tail = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, b, x in feature_blocks(batch.column("text"), shapes_and_words, DIMS):
                t = m.tails(x)
                expected[a:b], tail[a:b] = t.sum(axis=1), t[:, least_grade - 1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected), pa.array(tail), pa.array(tail >= least_probability)], ["doc_id", "expected_grade", "tail_probability", "selected"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("selected", T.BooleanType())]))
