"""Scoring with user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import argmax
from .latent import lists, matrix

#: A scorer maps a batch of vectors to named matrices, ``logits`` among them.
Scorer = Callable[[np.ndarray], dict[str, np.ndarray]]


@dataclass(frozen=True)
class LinearScorer:
    """Logits of a linear head. (Scorers are pickled: module-level classes or functions.)"""

    weights: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {"logits": x @ self.weights.T + self.bias}


def score(df: DataFrame, scorer: Scorer, feature: str, outputs: tuple[str, ...] = ("logits",), max_batches: int = 0, batch_rows: int = 32) -> DataFrame:
    """Add the scorer's outputs as array columns. The scorer is sent once per worker and called per Arrow batch.

    ``max_batches`` > 0 is for dry runs: any max_batches * batch_rows rows are scored. A dry run over no rows is an error.
    """
    if max_batches > 0:
        df = df.limit(max_batches * batch_rows)
        if df.isEmpty():
            raise ValueError("no rows to score")
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value(matrix(batch.column(feature))) if batch.num_rows else {}
            columns = [lists(np.asarray(found[o], np.float64)) if found else pa.array([], pa.list_(pa.float64())) for o in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *outputs])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(o, T.ArrayType(T.DoubleType())) for o in outputs]]))


def predict(df: DataFrame, prediction_fn: Callable[[Column], Column] = argmax, logits: str = "logits", into: str = "pred") -> DataFrame:
    """Labels from raw outputs; the default takes the first maximum."""
    return df.withColumn(into, prediction_fn(F.col(logits)))
