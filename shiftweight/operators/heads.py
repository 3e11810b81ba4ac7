"""Linear heads on frozen features."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import domain_accuracy
from .prep import tagged_union


def fit_weighted_head(source: DataFrame, pseudo: DataFrame | None = None, feature: str = "feat", label: str = "label", w: str = "w", pseudo_weight: float = 1.0, max_iter: int = 50, reg: float = 1e-4) -> LogisticRegressionModel:
    """Multinomial classifier on weighted source rows and, if given, pseudo-labelled target rows.

    Source weights are scaled to a mean of 1, so that ``pseudo_weight`` compares single rows of both sides.
    """
    mean = source.agg(F.avg(w).alias("m"))
    rows = source.crossJoin(F.broadcast(mean)).select(array_to_vector(feature).alias("x"), F.col(label).cast("double").alias("y"), (F.col(w) / F.col("m")).alias("v"))
    if pseudo is not None:
        rows = rows.unionByName(pseudo.select(array_to_vector(feature).alias("x"), F.col(label).cast("double").alias("y"), F.lit(float(pseudo_weight)).alias("v")))
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="v", maxIter=max_iter, regParam=reg).fit(rows)


def head_predictions(df: DataFrame, head: LogisticRegressionModel, feature: str = "feat") -> DataFrame:
    """Add probs and pred."""
    rows = head.transform(df.withColumn("x", array_to_vector(feature)))
    return rows.withColumns({"probs": vector_to_array("probability"), "pred": F.col("prediction").cast("int")}).drop("x", "rawPrediction", "probability", "prediction")


def domain_separability(source: DataFrame, target: DataFrame, feature: str = "feat", max_iter: int = 50, reg: float = 1e-2) -> DataFrame:
    """(domain_accuracy) of a classifier trained to tell source from target; near the larger share if it cannot."""
    both = tagged_union(source.select(feature), target.select(feature)).select(array_to_vector(feature).alias("x"), F.col("domain_label").cast("double").alias("y"))
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=max_iter, regParam=reg).fit(both)
    return domain_accuracy(model.transform(both).select(F.col("y").alias("domain_label"), F.col("prediction").alias("domain_pred")))
