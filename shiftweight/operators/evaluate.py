"""Accuracies and confusion matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metric names in the order in which a primary score is looked for.
PRIMARY = ["acc_wg", "acc_avg", "accuracy", "acc"]


def _right(label: str, pred: str) -> Column:
    return F.when(F.col(label) == F.col(pred), 1.0).otherwise(0.0)


def accuracy(df: DataFrame, scale: float = 100.0, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.agg((F.avg(_right(label, pred)) * scale).alias("accuracy"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(label, pred, n) for all pairs of classes that occur on either side, zero cells too."""
    classes = df.select(F.col(label).alias("c")).unionByName(df.select(F.col(pred).alias("c"))).distinct()
    cells = classes.withColumnRenamed("c", label).crossJoin(classes.withColumnRenamed("c", pred))  # classes squared, not rows
    return cells.join(df.groupBy(label, pred).agg(F.count("*").alias("n")), [label, pred], "left").select(label, pred, F.coalesce("n", F.lit(0)).alias("n"))


def group_accuracy(df: DataFrame, group: str = "grp", label: str = "label", pred: str = "pred") -> DataFrame:
    """(group, accuracy, n) per group."""
    return df.groupBy(group).agg(F.avg(_right(label, pred)).alias("accuracy"), F.count("*").alias("n"))


def group_summary(df: DataFrame, group: str = "grp", label: str = "label", pred: str = "pred") -> DataFrame:
    """One row: average and worst-group accuracy."""
    g = group_accuracy(df, group, label, pred)
    return g.agg((F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("acc_avg"), F.min("accuracy").alias("acc_wg"))


def primary_score(df: DataFrame) -> Column:
    """The first metric of :data:`PRIMARY` that a row has."""
    return F.coalesce(*[F.col(c) for c in PRIMARY if c in df.columns], F.lit(None).cast("double"))


def domain_accuracy(df: DataFrame, domain: str = "domain_label", pred: str = "domain_pred") -> DataFrame:
    return df.agg(F.avg(_right(domain, pred)).alias("domain_accuracy"))
