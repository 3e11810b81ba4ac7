"""Registered queries over the manifest fixture (documents, labels) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, prep, select
from . import fixtures as X
from .fixtures import manifest_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("p3_drop_labels", manifest_sql("SELECT sample_id, -1 AS label FROM splits"))
def p3(spark, d):
    return prep.drop_labels(X.splits(spark, d)).select("sample_id", "label")


@query("p5_route_splits", manifest_sql("SELECT sample_id, role, CASE WHEN role = 'adapt' THEN -1 ELSE label END AS label FROM (SELECT *, CASE split WHEN 'train' THEN 'source' WHEN 'test_unlabeled' THEN 'adapt' WHEN 'test' THEN 'eval' END AS role FROM splits) WHERE role IS NOT NULL"))
def p5(spark, d):
    return prep.route_splits(X.splits(spark, d), "uda_target").select("sample_id", "role", "label")


@query("j3_class_mismatch", manifest_sql("SELECT class_name, 'target' AS missing_in FROM (SELECT class_name FROM manifest WHERE domain = 'en' EXCEPT SELECT class_name FROM manifest WHERE domain = 'es' AND doc_id % 5 = 0) UNION ALL SELECT class_name, 'source' FROM (SELECT class_name FROM manifest WHERE domain = 'es' AND doc_id % 5 = 0 EXCEPT SELECT class_name FROM manifest WHERE domain = 'en')"))
def j3(spark, d):
    m = X.manifest(spark, d)
    return prep.class_mismatch(m.filter("domain = 'en'"), m.filter("domain = 'es' AND doc_id % 5 = 0"))


@query("x1_same_class_set", manifest_sql("SELECT count(*) = 0 AS same FROM (SELECT class_name FROM manifest WHERE domain = 'en' EXCEPT SELECT class_name FROM manifest WHERE domain = 'de')"))
def x1(spark, d):
    m = X.manifest(spark, d)
    return prep.class_mismatch(m.filter("domain = 'en'"), m.filter("domain = 'de'")).filter("missing_in = 'target'").agg((F.count("*") == 0).alias("same"))


@query("a2_confusion_matrix", manifest_sql("SELECT a.c AS label, b.c AS pred, count(p.label) AS n FROM (SELECT DISTINCT label AS c FROM predictions UNION SELECT DISTINCT pred FROM predictions) a CROSS JOIN (SELECT DISTINCT label AS c FROM predictions UNION SELECT DISTINCT pred FROM predictions) b LEFT JOIN predictions p ON p.label = a.c AND p.pred = b.c GROUP BY 1, 2"))
def a2(spark, d):
    return evaluate.confusion_matrix(X.predictions(spark, d))


@query("a3_group_accuracy", manifest_sql("SELECT grp, round(avg((label = pred)::INT), 6) AS accuracy, count(*) AS n FROM predictions GROUP BY grp"))
def a3(spark, d):
    return evaluate.group_accuracy(X.predictions(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query("a3_group_summary", manifest_sql("SELECT round(avg((label = pred)::INT), 6) AS acc_avg, (SELECT round(min(a), 6) FROM (SELECT avg((label = pred)::INT) AS a FROM predictions GROUP BY grp)) AS acc_wg, (SELECT round(min(a), 6) FROM (SELECT avg((label = pred)::INT) AS a FROM predictions GROUP BY grp)) AS primary_score FROM predictions"))
def a3s(spark, d):
    out = evaluate.group_summary(X.predictions(spark, d))
    return out.select(F.round("acc_avg", 6).alias("acc_avg"), F.round("acc_wg", 6).alias("acc_wg"), F.round(evaluate.primary_score(out), 6).alias("primary_score"))


@query("a16_step_budget", manifest_sql("SELECT *, source_steps * 50 + adapt_steps * 10 AS total_steps FROM (SELECT *, least(source_steps, target_steps) AS adapt_steps FROM (SELECT n_source, n_target, ceil(n_source / 32)::BIGINT AS source_steps, ceil(n_target / 32)::BIGINT AS target_steps FROM (SELECT count(*) FILTER (domain = 'en') AS n_source, count(*) FILTER (domain = 'fr') AS n_target FROM manifest)))"))
def a16(spark, d):
    m = X.manifest(spark, d).withColumn("domain", F.when(F.col("domain") == "en", "source").when(F.col("domain") == "fr", "target"))
    return prep.step_budget(m, 32, 50, 10)


@query("a18_num_classes", manifest_sql("SELECT count(DISTINCT class_name) AS num_classes FROM manifest"))
def a18(spark, d):
    return prep.num_classes(X.manifest(spark, d))


@query("w1_cap_per_domain", manifest_sql("SELECT path, domain FROM manifest QUALIFY row_number() OVER (PARTITION BY domain ORDER BY path) <= 20"))
def w1(spark, d):
    return select.cap_per_domain(X.manifest(spark, d), 20).select("path", "domain")


@query("w2_class_to_idx", manifest_sql("SELECT path, (dense_rank() OVER (ORDER BY class_name) - 1)::INTEGER AS label FROM manifest"))
def w2(spark, d):
    return prep.with_class_index(X.manifest(spark, d)).select("path", "label")


@query("w10_sample_index", manifest_sql("SELECT path, row_number() OVER (ORDER BY path) - 1 AS sample_id FROM manifest"))
def w10(spark, d):
    return prep.sample_index(X.manifest(spark, d).select("path"))


@query("p4_assert_labels_dropped", manifest_sql("SELECT true AS dropped_pass, bool_or(label <> -1) AS raw_rejected FROM splits"))
def p4(spark, d):
    """Labels that were dropped pass; the table as it is is rejected."""
    rows, passed = X.splits(spark, d), []
    for df in (prep.drop_labels(rows), rows):
        try:
            prep.assert_labels_dropped(df)
            passed.append(True)
        except ValueError:
            passed.append(False)
    return spark.createDataFrame([(passed[0], not passed[1])], "dropped_pass boolean, raw_rejected boolean")


@query("w2_shared_class_index", "SELECT 'c' || (doc_id % 7) AS class_name, (doc_id % 7)::INTEGER AS idx FROM documents GROUP BY ALL")
def w2s(spark, d):
    """Seven classes in two domains; the preferred one is the target."""
    m = X.manifest(spark, d).select(F.when(F.col("doc_id") % 14 < 7, "D").otherwise("A").alias("domain"), F.concat(F.lit("c"), F.col("doc_id") % 7).alias("class_name"))
    return prep.shared_class_index(m, "D", "A")


@query("w10_sample_index_heavy", manifest_sql("SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS sample_id FROM manifest"))
def w10h(spark, d):
    """Few values, each with many equal rows, numbered in blocks of 50."""
    return prep.sample_index(X.manifest(spark, d).select("domain"), "domain", range_rows=50)
