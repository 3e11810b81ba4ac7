"""Importance weights: post-processing, summaries, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import order_statistics

FLOOR = 1e-12


def _scaled(df: DataFrame, w: str) -> DataFrame:
    """Divide by the sum; a sum of 1e-12 or less is an error. The sum is a one-row cross join, not a collect."""
    s = df.agg(F.sum(w).alias("_s"))
    ok = F.when(F.col("_s") > FLOOR, F.col(w) / F.col("_s")).otherwise(F.raise_error(F.lit("weights collapsed")).cast("double"))
    return df.crossJoin(F.broadcast(s)).withColumn(w, ok).drop("_s")


def normalize(df: DataFrame, w: str = "w") -> DataFrame:
    return _scaled(df.withColumn(w, F.greatest(F.col(w), F.lit(0.0))), w)


def postprocess_weights(df: DataFrame, clip_max: float | None = None, mix_alpha: float = 1.0, mode: str = "update", w: str = "w") -> DataFrame:
    """Clamp at 0, normalise, clip, normalise, mix with the uniform weight 1 / N.

    The two modes give the mixing number opposite meanings: ``update`` keeps alpha of the weights
    (alpha * w + (1 - alpha) / N), ``oneshot`` keeps 1 - alpha of them ((1 - alpha) * w + alpha / N).
    """
    if mode not in ("update", "oneshot"):
        raise ValueError(f"unknown mode {mode!r}")
    if clip_max is not None and clip_max <= 0:
        raise ValueError("clip_max must be positive")
    out = normalize(df, w)
    if clip_max is not None:
        out = _scaled(out.withColumn(w, F.least(F.col(w), F.lit(float(clip_max)))), w)
    kept = mix_alpha if mode == "update" else 1 - mix_alpha
    if kept < 1:
        n = out.agg(F.count("*").alias("_n"))
        out = out.crossJoin(F.broadcast(n)).withColumn(w, F.col(w) * kept + (1 - kept) / F.col("_n")).drop("_n")
    return out


def weights_summary(df: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.9, 0.99), entropy: str = "plus", exact: bool = False, w: str = "w") -> DataFrame:
    """n, sum, min, mean, max, entropy, effective sample size and percentiles in one aggregation.

    ``entropy``: ``plus`` is -sum w ln(w + 1e-12), ``floor`` -sum v ln v with v = max(w, 1e-12). Percentiles
    come from a sketch of fixed size; with ``exact`` they are those of ``exact_percentiles``.
    """
    c = F.col(w)
    v = F.greatest(c, F.lit(FLOOR))
    h = -F.sum(c * F.ln(c + FLOOR)) if entropy == "plus" else -F.sum(v * F.ln(v))
    ess = F.sum(c) * F.sum(c) / F.greatest(F.sum(c * c), F.lit(FLOOR))
    names = [f"p{round(100 * p):02d}" for p in percentiles]
    sketched = [] if exact else [F.percentile_approx(c, p, 10_000).alias(name) for p, name in zip(percentiles, names, strict=True)]
    out = df.agg(F.count("*").alias("n"), F.sum(c).alias("sum"), F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max"), h.alias("entropy"), ess.alias("ess"), *sketched)
    if exact:
        out = out.withColumns({name: F.lit(x).cast("double") for name, x in zip(names, exact_percentiles(df, percentiles, w), strict=True)})
    return out


def exact_percentiles(df: DataFrame, percentiles: tuple[float, ...], w: str = "w") -> list[float | None]:
    """Percentiles with linear interpolation between the two ranks around each; null and NaN weights are left out.

    The ranks are found by ranges (``ranges.order_statistics``): no task holds or sorts all weights. No weights: all null.
    """
    if any(not 0 <= p <= 1 for p in percentiles):
        raise ValueError("percentiles must be between 0 and 1")
    df = df.filter(F.col(w).isNotNull() & ~F.isnan(w))
    n = df.count()
    if not n:
        return [None] * len(percentiles)
    at = [p * (n - 1) for p in percentiles]
    known = order_statistics(df, w, sorted({int(x) for x in at} | {min(int(x) + 1, n - 1) for x in at}))
    return [float(known[int(x)] if x == int(x) else known[int(x)] + (x - int(x)) * (known[int(x) + 1] - known[int(x)])) for x in at]


def weight_histogram(df: DataFrame, bins: int = 50, w: str = "w") -> DataFrame:
    """(bin, count) of an equal-width histogram between the smallest and largest weight; the last bin is closed."""
    r = df.agg(F.min(w).alias("lo"), F.max(w).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(w) - F.col("lo")) / width), F.lit(bins - 1)))
    return df.crossJoin(F.broadcast(r)).select(b.cast("int").alias("bin")).groupBy("bin").count()


def attach_weights(samples: DataFrame, weights: DataFrame, id_col: str = "sample_id", w: str = "w") -> DataFrame:
    """Join the weights to their samples; a weight that is negative or not finite is an error."""
    ok = (F.col(w) >= 0) & (F.col(w) < float("inf")) & ~F.isnan(w)
    checked = weights.select(id_col, F.when(ok, F.col(w)).otherwise(F.raise_error(F.lit("bad weight")).cast("double")).alias(w))
    return samples.join(checked, id_col)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int = 200, id_col: str = "sample_id") -> None:
    """Store a table in buckets of its id, each sorted and one file, so that tables stored alike join where they lie."""
    df.repartition(buckets, id_col).write.option("path", path).bucketBy(buckets, id_col).sortBy(id_col).saveAsTable(table)


def attach_bucketed(spark: SparkSession, samples: str, weights: str, id_col: str = "sample_id", w: str = "w") -> DataFrame:
    """``attach_weights`` of two tables of ``write_bucketed`` with equally many buckets: buckets are merged, no row is exchanged.

    Features are stored once and weights again after each update; the weights then come to the features without a shuffle of either.
    """
    return attach_weights(spark.table(samples), spark.table(weights).hint("merge"), id_col, w)
