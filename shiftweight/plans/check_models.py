"""Registered queries of fitted models: results depend on an iterative fit, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heads, latent, select
from . import fixtures as X, jobs


def m2_select_gmm_bic(spark: SparkSession, d: str) -> DataFrame:
    """Component weights of the mixture of two to four components that BIC picks on the whole target vectors."""
    rows = X.samples(spark, d).filter("domain = 'target'")
    m = latent.select_gmm_bic(rows, "feat", hi=4)
    return spark.createDataFrame([(k, float(w)) for k, w in enumerate(m.weights)], "component int, weight double")


def m4_fit_vmf(spark: SparkSession, d: str) -> DataFrame:
    """Mean responsibility per component of prototypes fitted on the whole target vectors."""
    rows = X.samples(spark, d).filter("domain = 'target'").select("sample_id", "feat")
    model = latent.fit_vmf(rows, "feat", 3)
    g = latent.responsibilities(rows, model, "feat", "g")
    return g.select(F.posexplode("g").alias("component", "g")).groupBy("component").agg(F.avg("g").alias("mean"))


def m6_fit_target_structure(spark: SparkSession, d: str) -> DataFrame:
    """Norms of the prototypes of both layers, fitted on the target half of lowest entropy."""
    rows = X.with_probs(X.samples(spark, d)).filter("domain = 'target'")
    models = latent.fit_target_structure(rows, X.CONSTRAINTS.layers, "vmf", clean_ratio=0.5)
    return spark.createDataFrame([(name, k, round(float(c @ c), 6)) for name, m in models.items() for k, c in enumerate(m.centroids)], "layer string, component int, norm double")


def one_shot_weights(spark: SparkSession, d: str) -> DataFrame:
    """Source weights of the one-shot job with its defaults."""
    rows = X.samples(spark, d).withColumn("logits", F.slice("feat", 1, X.CLASSES))
    out, _, _ = jobs.one_shot_weights(rows.filter("domain = 'source'"), rows.filter("domain = 'target'"), jobs.WeightConfig(X.CONSTRAINTS.layers, X.CLASSES))
    return out.select("sample_id", "w")


def m13_update_importance_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of one confidence-filtered update."""
    rows = X.with_probs(X.samples(spark, d))
    cfg = jobs.WeightConfig({"l0": 4, "l1": 3}, X.CLASSES, tau=0.5, min_count=100)
    out, _ = jobs.update_importance_weights(rows.filter("domain = 'source'"), rows.filter("domain = 'target'").drop("label"), cfg)
    return out


def m18_weighted_head(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of a head trained on weighted source rows and pseudo-labelled target rows."""
    rows = X.with_probs(X.samples(spark, d))
    source, target = rows.filter("domain = 'source'").withColumn("w", (F.col("sample_id") % 7 + 1) / 100.0), rows.filter("domain = 'target'")
    pseudo = select.apply_pseudo_labels(target, select.select_pseudo_labels(target, 0.8, 0.5, source.count()))
    return heads.head_predictions(target, heads.fit_weighted_head(source, pseudo, max_iter=10)).select("sample_id", "pred")


def m19_domain_separability(spark: SparkSession, d: str) -> DataFrame:
    rows = X.samples(spark, d)
    return heads.domain_separability(rows.filter("domain = 'source'"), rows.filter("domain = 'target'"), max_iter=10)


QUERIES = {f.__name__: f for f in (m2_select_gmm_bic, m4_fit_vmf, m6_fit_target_structure, one_shot_weights, m13_update_importance_weights, m18_weighted_head, m19_domain_separability)}
SQL: dict[str, str] = {}
