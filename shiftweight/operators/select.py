"""Selection of rows: confidence masks, lowest entropies, pseudo labels, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import argmax, entropy, is_finite, max_prob
from .ranges import cut


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose array columns hold finite numbers only."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & is_finite(F.col(c))
    return df.filter(keep)


def confidence_mask(df: DataFrame, mode: str, tau: float, max_entropy: float | None = None, force_all: bool = False, probs: str = "probs") -> DataFrame:
    """``maxprob``: confidence >= tau; ``entropy``: H <= tau. ``max_entropy`` holds in any case, also with ``force_all``."""
    h = entropy(F.col(probs), "floor")
    if mode not in ("maxprob", "entropy"):
        raise ValueError(f"unknown confidence mode {mode!r}")
    keep = F.lit(True) if force_all else (max_prob(F.col(probs)) >= tau if mode == "maxprob" else h <= tau)
    return df.filter(keep if max_entropy is None else keep & (h <= max_entropy))


def exact_lowest(df: DataFrame, score: str, n: int, id_col: str = "sample_id", descending: bool = False, small: int | None = None) -> DataFrame:
    """The n rows of lowest (or highest) score; ties go to the smaller id, null and NaN scores come last.

    n may be a large part of the table, so no limit over it is used: the cut is found by counts of ranges (``ranges.cut``),
    better ranges are taken whole, and only the rows at the border (``small`` at most, or ranges.SMALL) are sorted.
    """
    if n <= 0:
        return df.limit(0)
    known = F.when(~F.isnan(score), F.col(score).cast("double"))
    rows = df.withColumn("_k", -known if descending else known)
    whole, border, rest, _ = cut(rows, ["_k", id_col], n, small)
    inside = rows.filter(border).orderBy(F.col("_k").asc_nulls_last(), F.col(id_col).asc_nulls_last()).limit(rest)
    return rows.filter(reduce(Column.__or__, whole)).unionByName(inside).drop("_k")


def low_entropy_keep(df: DataFrame, keep_ratio: float, score: str = "entropy", id_col: str = "sample_id", small: int | None = None) -> DataFrame:
    """The max(1, ceil(n * ratio)) rows of lowest entropy; ratio 1 keeps all."""
    if not 0 < keep_ratio:
        raise ValueError("keep_ratio must be positive")
    if keep_ratio >= 1:
        return df
    n = df.count()
    return exact_lowest(df, score, max(1, -int(-n * keep_ratio // 1)), id_col, small=small)


def relaxed_threshold(scores: DataFrame, mode: str, min_count: int, score: str = "score", small: int | None = None) -> float | None:
    """Threshold at which ``min_count`` rows pass: the min_count-th best score, or the worst if there are fewer (none: null)."""
    key = -F.col(score) if mode == "maxprob" else F.col(score)
    rows = scores.select(key.cast("double").alias("k")).filter("k IS NOT NULL AND NOT isnan(k)")
    _, border, rest, tie = cut(rows, ["k"], min_count, small)
    inside = rows.filter(border)
    worst = (rows if not rest else inside if tie else inside.orderBy("k").limit(rest)).agg(F.max("k")).first()[0]
    return None if worst is None else -worst if mode == "maxprob" else worst


def select_confident(df: DataFrame, mode: str, tau: float, min_count: int, policy: str = "lower_thresh", max_entropy: float | None = None, probs: str = "probs") -> tuple[DataFrame | None, float, str]:
    """(rows, threshold used, status) with the fallback for too few rows: relax, skip, or use all."""
    kept = confidence_mask(df, mode, tau, max_entropy, probs=probs)
    if kept.count() >= min_count:
        return kept, tau, "selected"
    if policy == "skip_update":
        return None, tau, "skipped_low_confidence"
    if policy == "use_all":
        return confidence_mask(df, mode, tau, max_entropy, force_all=True, probs=probs), tau, "used_all"
    if policy != "lower_thresh":
        raise ValueError(f"unknown policy {policy!r}")
    score = max_prob(F.col(probs)) if mode == "maxprob" else entropy(F.col(probs), "floor")
    relaxed = relaxed_threshold(df.select(score.alias("score")), mode, min_count)
    if relaxed is None:
        return None, tau, "skipped_empty"
    return confidence_mask(df, mode, relaxed, max_entropy, probs=probs), relaxed, "relaxed"


def select_pseudo_labels(target: DataFrame, conf_thresh: float, max_ratio: float, n_source: int, probs: str = "probs", id_col: str = "sample_id") -> DataFrame:
    """(id, pseudo_label, confidence) of confident rows, the int(max_ratio * n_source) most confident at most.

    A negative ratio means no limit; a limit of 0 selects nothing. Ties go to the smaller id.
    """
    rows = target.select(id_col, argmax(F.col(probs)).alias("pseudo_label"), max_prob(F.col(probs)).alias("confidence")).filter(F.col("confidence") >= conf_thresh)
    return rows if max_ratio < 0 else exact_lowest(rows, "confidence", int(max_ratio * n_source), id_col, descending=True)


def apply_pseudo_labels(target: DataFrame, pseudo: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Selected target rows with their label replaced by the pseudo label."""
    return target.drop("label").join(pseudo.select(id_col, F.col("pseudo_label").alias("label")), id_col)


def fit_sample(df: DataFrame, most: int, seed: int = 0, id_col: str = "sample_id") -> DataFrame:
    """``most`` rows without replacement, always the same ones for a seed: those of lowest hash.

    Rows are first cut at a hash that a few more than ``most`` stay below, so that the sort sees these only.
    """
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    n = df.count()
    if n > 4 * most:
        share = (most + 6 * most**0.5 + 100) / n
        low = df.filter(h < int(-(2**63) + share * 2**64))
        if low.count() >= most:
            df = low
    return df.orderBy(h, id_col).limit(most)


def cap_per_domain(manifest: DataFrame, n: int, domain: str = "domain", order: str = "path") -> DataFrame:
    """The first n rows of each domain in file order."""
    return manifest.withColumn("_n", F.row_number().over(Window.partitionBy(domain).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def top_weights(weights: DataFrame, k: int = 10, w: str = "w", id_col: str = "sample_id") -> DataFrame:
    """The k largest weights; ties go to the smaller id, null and NaN weights come last."""
    known = F.when(~F.isnan(w), F.col(w))
    return weights.orderBy(known.desc_nulls_last(), id_col).limit(k)
