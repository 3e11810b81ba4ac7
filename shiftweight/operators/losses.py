"""Weighted and domain losses, and averages of batch logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_cross_entropy(df: DataFrame, mode: str = "batch", by: str = "batch_no", ce: str = "ce", w: str = "w", n_total: int | None = None) -> DataFrame:
    """(batch, loss). ``batch``: sum w ce / max(sum w, 1e-12); ``global``: sum w ce * N / B; ``oneshot``: over sum w + 1e-8."""
    s, t = F.sum(F.col(w) * F.col(ce)), F.sum(w)
    if mode == "global" and n_total is None:
        raise ValueError("global mode needs n_total")
    loss = {"batch": lambda: s / F.greatest(t, F.lit(1e-12)), "global": lambda: s * F.lit(float(n_total)) / F.count("*"), "oneshot": lambda: s / (t + 1e-8)}[mode]()
    return df.groupBy(by).agg(loss.alias("loss"))


def adaptation_loss(source: DataFrame, pseudo: DataFrame | None, weight: float = 1.0, weighted: bool = True, ce: str = "ce", w: str = "w") -> DataFrame:
    """Source loss (weighted or plain mean) plus ``weight`` times the mean loss of pseudo-labelled rows, as one row."""
    of_source = F.sum(F.col(w) * F.col(ce)) / (F.sum(w) + 1e-8) if weighted else F.avg(ce)
    out = source.agg(of_source.alias("source_loss"))
    if pseudo is None:
        return out.select("source_loss", F.lit(0.0).alias("pseudo_loss"), F.col("source_loss").alias("loss"))
    both = out.crossJoin(pseudo.agg(F.coalesce(F.avg(ce), F.lit(0.0)).alias("pseudo_loss")))
    return both.withColumn("loss", F.col("source_loss") + weight * F.col("pseudo_loss"))


def epoch_averages(log: DataFrame, by: list[str], pseudo: Column | None = None) -> DataFrame:
    """Means of loss and acc weighted by batch_size; rows flagged ``pseudo`` count in the loss only."""
    n, real = F.col("batch_size"), F.lit(True) if pseudo is None else ~pseudo
    acc_n = F.when(real, n)
    return log.groupBy(*by).agg((F.sum(F.col("loss") * n) / F.sum(n)).alias("loss"), (F.sum(F.col("acc") * acc_n) / F.sum(acc_n)).alias("acc"))


def domain_loss(df: DataFrame, balanced: bool = True, ce: str = "ce", domain: str = "domain_label", weight: str | None = None) -> DataFrame:
    """Half the mean loss of each domain (0 source, 1 target), or the mean over all rows; optionally weighted."""
    mean = lambda keep: F.sum(F.when(keep, F.col(ce) * (F.col(weight) if weight else F.lit(1.0)))) / F.sum(F.when(keep, F.col(weight) if weight else F.lit(1.0)))
    if balanced:
        return df.agg((0.5 * (mean(F.col(domain) == 0) + mean(F.col(domain) == 1))).alias("loss"))
    return df.agg(mean(F.lit(True)).alias("loss"))
