"""Registered queries over the feature fixture (embeddings) and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import align, evaluate, iis, latent, losses, prep, scoring, select, weights
from ..sources.files import shared_folder
from . import fixtures as X
from . import jobs
from .fixtures import features_sql, iis_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(df: DataFrame, *plain: str) -> DataFrame:
    """Round doubles to six digits for comparison."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in plain else F.col(c) for c, t in df.dtypes])


def _solved(spark: SparkSession, d: str, iterations: int = 3):
    source, target = X.source_target(spark, d)
    pg = iis.target_moments(target, X.CONSTRAINTS)
    return (*iis.solve_iis(source, X.CONSTRAINTS, pg, max_iter=iterations), source, target, pg)


@query("slice0_class_marginals", features_sql("""
SELECT t.class, round(target, 6) AS target, round(source, 6) AS source, round(weighted, 6) AS weighted FROM (SELECT class, avg(p) AS target FROM probs WHERE domain = 'target' GROUP BY class) t
JOIN (SELECT c.class, avg((label = c.class)::INT) AS source, sum(w * (label = c.class)::INT) AS weighted FROM s JOIN w3 USING (sample_id), (SELECT DISTINCT class FROM cent) c GROUP BY c.class) u USING (class)""", iis_sql(3)))
def slice0(spark, d):
    """Class marginals of the target and of the source before and after three solver iterations."""
    out, _, _, _, target, _ = _solved(spark, d)
    return r6(iis.class_marginals(out, target))


@query("p7_finite_rows", features_sql("SELECT domain, count(*) AS n FROM s WHERE sample_id % 50 <> 7 GROUP BY domain"))
def p7(spark, d):
    rows = X.samples(spark, d).withColumn("feat", F.when(F.col("sample_id") % 50 == 7, F.transform("feat", lambda v, i: F.when(i == 3, F.lit(float("nan"))).otherwise(v))).otherwise(F.col("feat")))
    return select.finite_rows(rows, ["feat"]).groupBy("domain").agg(F.count("*").alias("n"))


@query("p8_confidence_mask", features_sql("SELECT sample_id FROM pl WHERE domain = 'target' AND conf >= 0.5 AND h <= 1.5"))
def p8(spark, d):
    return select.confidence_mask(X.with_probs(X.samples(spark, d)).filter("domain = 'target'"), "maxprob", 0.5, 1.5).select("sample_id")


@query("p8_entropy_mask", features_sql("SELECT sample_id FROM pl WHERE domain = 'target' AND h <= 1.2"))
def p8e(spark, d):
    return select.confidence_mask(X.with_probs(X.samples(spark, d)).filter("domain = 'target'"), "entropy", 1.2).select("sample_id")


@query("p9_label_violations", features_sql("SELECT sample_id, label FROM s WHERE (label < 0 OR label >= 5) AND label <> 9"))
def p9(spark, d):
    return prep.label_violations(X.samples(spark, d), 5, ignore_index=9).select("sample_id", "label")


def _id_weights(rows: DataFrame) -> DataFrame:
    return rows.select("sample_id", ((F.col("sample_id") % 7 + 1) / 100.0).alias("w"))


@query("j1_attach_weights", features_sql("SELECT sample_id, label, round((sample_id % 7 + 1) / 100::DOUBLE, 6) AS w FROM s WHERE domain = 'source'"))
def j1(spark, d):
    rows = X.samples(spark, d).filter("domain = 'source'")
    return r6(weights.attach_weights(rows.select("sample_id", "label"), _id_weights(rows)))


PSEUDO = "pp AS (SELECT sample_id, pred, conf FROM pl WHERE domain = 'target' AND conf >= 0.5 ORDER BY conf DESC, sample_id LIMIT (SELECT (0.2::DOUBLE * count(*))::BIGINT - CASE WHEN (0.2::DOUBLE * count(*))::BIGINT > 0.2::DOUBLE * count(*) THEN 1 ELSE 0 END FROM s WHERE domain = 'source'))"


@query("t3_select_pseudo_labels", features_sql("SELECT sample_id, pred::INTEGER AS pseudo_label, round(conf, 6) AS confidence FROM pp", PSEUDO))
def t3(spark, d):
    rows = X.with_probs(X.samples(spark, d))
    return r6(select.select_pseudo_labels(rows.filter("domain = 'target'"), 0.5, 0.2, rows.filter("domain = 'source'").count()))


@query("j2_apply_pseudo_labels", features_sql("SELECT sample_id, pred::INTEGER AS label FROM pp", PSEUDO))
def j2(spark, d):
    rows = X.with_probs(X.samples(spark, d))
    target = rows.filter("domain = 'target'")
    return select.apply_pseudo_labels(target, select.select_pseudo_labels(target, 0.5, 0.2, rows.filter("domain = 'source'").count())).select("sample_id", "label")


@query("j9_pair_batches_cycle", features_sql("SELECT x.batch_no, y.batch_no AS target_batch FROM (SELECT DISTINCT batch_no FROM b WHERE domain = 'source') x JOIN (SELECT DISTINCT batch_no FROM b WHERE domain = 'target') y ON y.batch_no = x.batch_no % (SELECT count(DISTINCT batch_no) FROM b WHERE domain = 'target')"))
def j9c(spark, d):
    b = X.batches(X.samples(spark, d))
    return prep.pair_batches(b.filter("domain = 'source'"), b.filter("domain = 'target'"), "cycle")


@query("j9_pair_batches_zip", features_sql("SELECT x.batch_no, x.batch_no AS target_batch FROM (SELECT DISTINCT batch_no FROM b WHERE domain = 'source') x JOIN (SELECT DISTINCT batch_no FROM b WHERE domain = 'target') y USING (batch_no)"))
def j9z(spark, d):
    b = X.batches(X.samples(spark, d))
    return prep.pair_batches(b.filter("domain = 'source'"), b.filter("domain = 'target'"), "zip")


@query("a1_accuracy", features_sql("SELECT round(100 * avg((pred = label)::INT), 6) AS accuracy FROM pl WHERE domain = 'target'"))
def a1(spark, d):
    return r6(evaluate.accuracy(X.with_probs(X.samples(spark, d)).filter("domain = 'target'").select("label", V.argmax(F.col("probs")).alias("pred"))))


@query("a4_domain_accuracy", features_sql("SELECT round(avg(((feat[1] > 0) = (domain = 'target'))::INT), 6) AS domain_accuracy FROM s"))
def a4(spark, d):
    rows = X.samples(spark, d)
    both = prep.tagged_union(rows.filter("domain = 'source'"), rows.filter("domain = 'target'"))
    return r6(evaluate.domain_accuracy(both.withColumn("domain_pred", (F.get("feat", 0) > 0).cast("int"))))


@query("a6_target_moments", features_sql("SELECT layer, component::INTEGER AS component, class::INTEGER AS class, round(pg, 6) AS moment FROM pg"))
def a6(spark, d):
    _, target = X.source_target(spark, d)
    c = X.CONSTRAINTS
    pg = iis.target_moments(target, c)
    return r6(spark.createDataFrame([(*c.decode(i), float(v)) for i, v in enumerate(pg)], "layer string, component int, class int, moment double"))


@query("a6_target_moments_exploded", features_sql("SELECT layer, component::INTEGER AS component, class::INTEGER AS class, round(pg, 6) AS moment FROM pg"))
def a6e(spark, d):
    return r6(iis.moments_long(X.source_target(spark, d)[1], X.CONSTRAINTS))


IDW = "iw AS (SELECT sample_id, (sample_id % 7 + 1) / 100::DOUBLE AS w FROM s WHERE domain = 'source')"


@query("a7_model_moments", features_sql("SELECT layer, component::INTEGER AS component, c.class::INTEGER AS class, round(coalesce(sum(w * g) FILTER (f.class = c.class), 0), 6) AS moment FROM f JOIN iw USING (sample_id), (SELECT DISTINCT class FROM cent) c GROUP BY layer, component, c.class", IDW))
def a7(spark, d):
    source, _ = X.source_target(spark, d)
    c = X.CONSTRAINTS
    pm = iis.model_moments(weights.attach_weights(source, _id_weights(source)), c)
    return r6(spark.createDataFrame([(*c.decode(i), float(v)) for i, v in enumerate(pm)], "layer string, component int, class int, moment double"))


@query("a9_weights_summary", features_sql("SELECT count(*) AS n, round(sum(w), 6) AS sum, round(min(w), 6) AS min, round(avg(w), 6) AS mean, round(max(w), 6) AS max, round(-sum(w * ln(w + 1e-12)), 6) AS entropy, round(sum(w) * sum(w) / sum(w * w), 6) AS ess, round(quantile_cont(w, 0.5), 6) AS p50, round(quantile_cont(w, 0.9), 6) AS p90, round(quantile_cont(w, 0.99), 6) AS p99 FROM iw", IDW))
def a9(spark, d):
    return r6(weights.weights_summary(_id_weights(X.samples(spark, d).filter("domain = 'source'")), exact=True))


@query("a10_weight_histogram", features_sql("SELECT bin::INTEGER AS bin, count(*) AS count FROM (SELECT least(floor((w - (SELECT min(w) FROM w3)) / (((SELECT max(w) FROM w3) - (SELECT min(w) FROM w3)) / 20)), 19) AS bin FROM w3) GROUP BY bin", iis_sql(3)))
def a10(spark, d):
    return weights.weight_histogram(_solved(spark, d)[0], 20)


@query("a11_feature_mass_stats", features_sql("SELECT round(min(m), 6) AS min, round(max(m), 6) AS max, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, round(stddev_samp(m) / avg(m), 6) AS rel_std FROM (SELECT list_sum(feat[1:8]) * 1.5 AS m FROM s)"))
def a11(spark, d):
    rows = X.samples(spark, d).select(F.slice("feat", 1, 8).alias("x"), F.array(F.lit(1.0), F.lit(0.5)).alias("probs"))
    return r6(iis.feature_mass_stats(rows, ["x"]).withColumn("rel_std", F.col("std") / F.col("mean")))


CE = "z AS (SELECT s.*, feat[1:10] AS lg FROM s), ce AS (SELECT sample_id, domain, label, list_max(lg) + ln(list_sum([exp(v - list_max(lg)) FOR v IN lg])) - lg[label + 1] AS ce FROM z)"


def _losses(spark, d) -> DataFrame:
    rows = X.batches(X.samples(spark, d)).withColumn("logits", F.slice("feat", 1, 10))
    return rows.withColumn("ce", V.cross_entropy(F.col("logits"), F.col("label"))).join(_id_weights(rows), "sample_id")


@query("f12_cross_entropy", features_sql("SELECT sample_id, CASE WHEN label <> 9 THEN round(ce, 6) END AS ce FROM ce", CE))
def f12(spark, d):
    return r6(X.samples(spark, d).select("sample_id", V.cross_entropy(F.slice("feat", 1, 10), F.col("label"), 9).alias("ce")))


@query("a19_domain_loss", features_sql("SELECT round(0.5 * avg(ce) FILTER (domain = 'source') + 0.5 * avg(ce) FILTER (domain = 'target'), 6) AS loss FROM ce", CE))
def a19(spark, d):
    return r6(losses.domain_loss(_losses(spark, d).withColumn("domain_label", (F.col("domain") == "target").cast("int"))))


for _mode, _loss in {"batch": "sum(w * ce) / greatest(sum(w), 1e-12)", "global": "sum(w * ce) * 1000 / count(*)", "oneshot": "sum(w * ce) / (sum(w) + 1e-8)"}.items():

    @query(f"m14_weighted_cross_entropy_{_mode}", features_sql(f"SELECT batch_no, round({_loss}, 6) AS loss FROM ce JOIN iw USING (sample_id) JOIN b USING (sample_id) GROUP BY batch_no", CE + ", " + IDW))
    def m14(spark, d, mode=_mode):
        return r6(losses.weighted_cross_entropy(_losses(spark, d).filter("domain = 'source'"), mode, n_total=1000))


@query("m17_adaptation_loss", features_sql("SELECT round(a, 6) AS source_loss, round(p, 6) AS pseudo_loss, round(a + 0.5 * p, 6) AS loss FROM (SELECT sum(w * ce) / (sum(w) + 1e-8) AS a FROM ce JOIN iw USING (sample_id)), (SELECT avg(ce) AS p FROM ce WHERE domain = 'target')", CE + ", " + IDW))
def m17(spark, d):
    rows = _losses(spark, d)
    return r6(losses.adaptation_loss(rows.filter("domain = 'source'"), rows.filter("domain = 'target'"), 0.5))


@query("t1_low_entropy_keep", features_sql("SELECT sample_id FROM pl WHERE domain = 'target' ORDER BY -list_sum([least(greatest(p, 0), 1) * ln(least(greatest(p, 0), 1) + 1e-12) FOR p IN probs]), sample_id LIMIT (SELECT ceil(count(*) * 0.3)::BIGINT FROM s WHERE domain = 'target')"))
def t1(spark, d):
    rows = X.with_probs(X.samples(spark, d)).filter("domain = 'target'").withColumn("entropy", V.entropy(F.col("probs")))
    return select.low_entropy_keep(rows, 0.3).select("sample_id")


@query("t2_relaxed_threshold", features_sql("SELECT round(min(conf), 6) AS tau FROM (SELECT conf FROM pl WHERE domain = 'target' ORDER BY conf DESC LIMIT 100)"))
def t2(spark, d):
    scores = X.with_probs(X.samples(spark, d)).filter("domain = 'target'").select(V.max_prob(F.col("probs")).alias("score"))
    return r6(spark.createDataFrame([(select.relaxed_threshold(scores, "maxprob", 100),)], "tau double"))


@query("t4_top_weights", features_sql("SELECT sample_id, round(w, 6) AS w FROM w3 ORDER BY w3.w DESC, sample_id LIMIT 10", iis_sql(3)))
def t4(spark, d):
    return r6(select.top_weights(_solved(spark, d)[0].select("sample_id", "w")))


@query("t5_fit_sample")
def t5(spark, d):
    return select.fit_sample(X.samples(spark, d).select("sample_id", "label"), 100, seed=1)


@query("x2_tagged_union", features_sql("SELECT (domain = 'target')::INTEGER AS domain_label, count(*) AS n, sum(sample_id)::BIGINT AS ids FROM s GROUP BY 1"))
def x2(spark, d):
    rows = X.samples(spark, d)
    return prep.tagged_union(rows.filter("domain = 'source'"), rows.filter("domain = 'target'")).groupBy("domain_label").agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids"))


@query("f1_softmax_argmax", features_sql("SELECT sample_id, round(list_max(e) / list_sum(e), 6) AS max_prob, (list_position(e, list_max(e)) - 1)::INTEGER AS pred, round(e[1] / list_sum(e), 6) AS p0 FROM (SELECT sample_id, [exp(v - list_max(feat[1:10])) FOR v IN feat[1:10]] AS e FROM s)"))
def f1(spark, d):
    p = X.samples(spark, d).select("sample_id", V.softmax(F.slice("feat", 1, 10)).alias("p"))
    return r6(p.select("sample_id", V.max_prob(F.col("p")).alias("max_prob"), V.argmax(F.col("p")).alias("pred"), F.get("p", 0).alias("p0")))


@query("f2_one_hot", features_sql("SELECT sample_id, array_to_string([(i = label)::INTEGER FOR i IN generate_series(0, 9)], '') AS code FROM s"))
def f2(spark, d):
    return X.samples(spark, d).select("sample_id", F.array_join(F.transform(V.class_probs("onehot", label=F.col("label"), classes=10), lambda v: v.cast("int").cast("string")), "").alias("code"))


@query("f4_entropies", features_sql("SELECT sample_id, round(-list_sum([p * ln(p + 1e-12) FOR p IN probs]), 6) AS clip, round(h, 6) AS floor, round(-list_sum([greatest(p, 1e-6) * ln(greatest(p, 1e-6)) FOR p IN probs]), 6) AS clamp FROM pl"))
def f4(spark, d):
    p = F.col("probs")
    return r6(X.with_probs(X.samples(spark, d)).select("sample_id", *[V.entropy(p, v).alias(v) for v in ("clip", "floor", "clamp")]))


@query("f5_l2_normalize", features_sql("SELECT sample_id, round(feat[1] / sqrt(list_inner_product(feat, feat)), 6) AS x0, round(feat[64] / sqrt(list_inner_product(feat, feat)), 6) AS x63 FROM s"))
def f5(spark, d):
    u = X.samples(spark, d).select("sample_id", V.l2_normalize(F.col("feat")).alias("u"))
    return r6(u.select("sample_id", F.get("u", 0).alias("x0"), F.get("u", 63).alias("x63")))


@query("f6_row_normalize", features_sql("SELECT sample_id, round(greatest(feat[1], 0) / list_sum([greatest(v, 0) FOR v IN feat]), 6) AS x0, round(list_max(feat) / list_sum([greatest(v, 0) FOR v IN feat]), 6) AS top FROM s"))
def f6(spark, d):
    u = X.samples(spark, d).select("sample_id", V.row_normalize(F.col("feat"), clamp=True).alias("u"))
    return r6(u.select("sample_id", F.get("u", 0).alias("x0"), F.array_max("u").alias("top")))


@query("f7_joint", features_sql("SELECT sample_id, round(feat[1] * feat[11], 6) AS first, round(feat[2] * feat[11], 6) AS eleventh, round(list_sum(feat[1:4]) * list_sum(feat[11:20]), 6) AS mass FROM s"))
def f7(spark, d):
    u = X.samples(spark, d).select("sample_id", V.joint(F.slice("feat", 1, 4), F.slice("feat", 11, 10)).alias("u"))
    return r6(u.select("sample_id", F.get("u", 0).alias("first"), F.get("u", 10).alias("eleventh"), V.total(F.col("u")).alias("mass")))


@query("f8_conditional_representation", features_sql("SELECT sample_id, round(feat[1] * feat[61], 6) AS first, round(feat[1] * feat[62], 6) AS second_class, 16::INTEGER AS size FROM s"))
def f8(spark, d):
    u = X.samples(spark, d).select("sample_id", V.conditional_representation(F.slice("feat", 1, 4), F.slice("feat", 61, 4)).alias("u"))
    return r6(u.select("sample_id", F.get("u", 0).alias("first"), F.get("u", 4).alias("second_class"), F.size("u").alias("size")))


@query("f9_entropy_weight", features_sql("SELECT sample_id, round(1 + exp(list_sum([greatest(p, 1e-6) * ln(greatest(p, 1e-6)) FOR p IN probs])), 6) AS weight FROM pl"))
def f9(spark, d):
    return r6(X.with_probs(X.samples(spark, d)).select("sample_id", V.entropy_weight(F.col("probs")).alias("weight")))


@query("f10_constraint_id", features_sql("SELECT layer, component::INTEGER AS component, class::INTEGER AS class, (CASE layer WHEN 'l0' THEN 0 ELSE 40 END + component * 10 + class)::INTEGER AS constraint_id FROM (SELECT layer, component FROM proto), (SELECT DISTINCT class FROM cent)"))
def f10(spark, d):
    # Keys as they come from the data: every component and class that scored rows have.
    rows = X.source_target(spark, d)[0]
    parts = [rows.select(F.lit(name).alias("layer"), F.posexplode(name).alias("component", "g"), "probs") for name in X.CONSTRAINTS.layers]
    keys = parts[0].unionByName(parts[1]).select("layer", "component", F.posexplode("probs").alias("class", "p")).select("layer", "component", "class").distinct()
    return keys.withColumn("constraint_id", X.CONSTRAINTS.column(F.col("layer"), F.col("component"), F.col("class")))


HEAD_W, HEAD_B = np.array([[((7 * k + 3 * i) % 11 - 5) / 10 for i in range(64)] for k in range(4)]), np.array([0.1, -0.2, 0.3, 0.0])
LOGITS = "hd AS (SELECT sample_id, [list_inner_product(feat, [((7 * k + 3 * i) % 11 - 5) / 10::DOUBLE FOR i IN generate_series(0, 63)]) + [0.1, -0.2, 0.3, 0.0][k + 1]::DOUBLE FOR k IN generate_series(0, 3)] AS lg FROM s)"
HEAD_SQL = "SELECT sample_id, round(lg[1], 6) AS l0, round(lg[4], 6) AS l3, (list_position(lg, list_max(lg)) - 1)::INTEGER AS pred FROM hd"


@query("u1_score_linear", features_sql(HEAD_SQL, LOGITS))
def u1(spark, d):
    out = scoring.predict(scoring.score(X.samples(spark, d).select("sample_id", "feat"), scoring.LinearScorer(HEAD_W, HEAD_B), "feat"))
    return r6(out.select("sample_id", F.get("logits", 0).alias("l0"), F.get("logits", 3).alias("l3"), "pred"))


@query("f11_linear_logits", features_sql(HEAD_SQL, LOGITS))
def f11(spark, d):
    out = X.samples(spark, d).select("sample_id", V.dense_logits(F.col("feat"), HEAD_W.tolist(), HEAD_B.tolist()).alias("logits"))
    return r6(scoring.predict(out).select("sample_id", F.get("logits", 0).alias("l0"), F.get("logits", 3).alias("l3"), "pred"))


@query("m5_vmf_responsibilities", features_sql("SELECT sample_id, layer, component::INTEGER AS component, round(g, 6) AS g FROM gamma"))
def m5(spark, d):
    rows = X.scored(spark, d)
    parts = [rows.select("sample_id", F.lit(name).alias("layer"), F.posexplode(name).alias("component", "g")) for name in X.CONSTRAINTS.layers]
    return r6(parts[0].unionByName(parts[1]))


#: Fixed mixture for checks: two components with plain numbers.
MIX = latent.MixtureModel(np.array([0.4, 0.6]), np.array([[0.1] * 4, [-0.2] * 4]), np.array([[0.5] * 4, [0.8] * 4]))
MIX_SQL = """mx AS (SELECT sample_id, feat[1:4] AS x FROM s WHERE domain = 'target'),
mz AS (SELECT sample_id, x, ln(0.4) - 0.5 * list_sum([(v - 0.1) * (v - 0.1) / 0.5 + ln(2 * pi() * 0.5) FOR v IN x]) AS a, ln(0.6) - 0.5 * list_sum([(v + 0.2) * (v + 0.2) / 0.8 + ln(2 * pi() * 0.8) FOR v IN x]) AS b FROM mx),
mr AS (SELECT sample_id, x, 1 / (1 + exp(b - a)) AS r0, 1 / (1 + exp(a - b)) AS r1 FROM mz)"""


def _mix_rows(spark, d) -> DataFrame:
    return X.samples(spark, d).filter("domain = 'target'").select("sample_id", F.slice("feat", 1, 4).alias("x"))


@query("m3_gmm_responsibilities", features_sql("SELECT sample_id, round(r0, 6) AS r0, round(r1, 6) AS r1 FROM mr", MIX_SQL))
def m3(spark, d):
    return r6(latent.responsibilities(_mix_rows(spark, d), MIX, "x", "g").select("sample_id", F.get("g", 0).alias("r0"), F.get("g", 1).alias("r1")))


@query("m1_em_step", features_sql("SELECT k AS component, round(weight, 6) AS weight, round(mean, 6) AS mean, round(q - mean * mean + 1e-6, 6) AS variance FROM (SELECT 0 AS k, avg(r0) AS weight, sum(r0 * x[1]) / sum(r0) AS mean, sum(r0 * x[1] * x[1]) / sum(r0) AS q FROM mr UNION ALL SELECT 1, avg(r1), sum(r1 * x[1]) / sum(r1), sum(r1 * x[1] * x[1]) / sum(r1) FROM mr)", MIX_SQL))
def m1(spark, d):
    m = latent.em_step(_mix_rows(spark, d), "x", MIX)
    return r6(spark.createDataFrame([(k, float(m.weights[k]), float(m.means[k, 0]), float(m.variances[k, 0])) for k in range(2)], "component int, weight double, mean double, variance double"))


@query("m7_validate_joint", features_sql("SELECT round(min(g * p), 6) AS min_entry, 0.0::DOUBLE AS max_layer_error, 0.0::DOUBLE AS max_total_error, true AS valid FROM gamma JOIN probs USING (sample_id) WHERE gamma.domain = 'target'"))
def m7(spark, d):
    return r6(iis.validate_joint(X.source_target(spark, d)[1], list(X.CONSTRAINTS.layers)))


@query("m8_unachievable_constraints", features_sql("SELECT layer, component::INTEGER AS component, class::INTEGER AS class FROM pg WHERE pg > 0 AND class NOT IN (SELECT label FROM s WHERE domain = 'source' AND label <> 3)"))
def m8(spark, d):
    source, target = X.source_target(spark, d)
    c = X.CONSTRAINTS
    return spark.createDataFrame(iis.unachievable_constraints(source.filter("label <> 3"), iis.target_moments(target, c), c), "layer string, component int, class int")


for _n in (1, 3):

    @query("m9_iis_step" if _n == 1 else "m10_solve_iis", features_sql(f"SELECT sample_id, round(w, 9) AS w FROM w{_n}", iis_sql(_n)))
    def m10(spark, d, n=_n):
        return _solved(spark, d, n)[0].select("sample_id", F.round("w", 9).alias("w"))


@query("m10_history", features_sql("SELECT i AS iteration, round(max(abs(pm - pg)), 6) AS max_error, round(sqrt(sum((pm - pg) * (pm - pg))), 6) AS l2_error, round(sum(pg * ln((pg + 1e-8) / (pm + 1e-8))), 6) AS kl FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, pg, coalesce(pm, 0) AS pm FROM pg LEFT JOIN m{i + 1} USING (layer, component, class)" for i in range(3)) + ") GROUP BY i", iis_sql(4)))
def m10h(spark, d):
    return r6(iis.history_table(spark, _solved(spark, d)[2]).select("iteration", "max_error", "l2_error", "kl"))


@query("w5_objective_decreased", features_sql("SELECT i AS iteration, false AS decreased FROM generate_series(0, 2) t(i)").replace("SELECT i AS iteration", "SELECT i::INTEGER AS iteration"))
def w5(spark, d):
    out = _solved(spark, d)
    return iis.objective_decreased(iis.history_table(spark, out[2]), n_source=out[3].count()).select("iteration", "decreased")


for _mode, _mix in {"update": "0.8 * c + 0.2 / n", "oneshot": "0.2 * c + 0.8 / n"}.items():

    @query(f"m12_postprocess_{_mode}", features_sql(f"SELECT sample_id, round({_mix}, 9) AS w FROM (SELECT sample_id, c / sum(c) OVER () AS c, count(*) OVER () AS n FROM (SELECT sample_id, least(w / sum(w) OVER (), 0.004) AS c FROM iw))", IDW))
    def m12(spark, d, mode=_mode):
        out = weights.postprocess_weights(_id_weights(X.samples(spark, d).filter("domain = 'source'")), 0.004, 0.8, mode)
        return out.select("sample_id", F.round("w", 9).alias("w"))


def _mmd_sql(joint: bool) -> str:
    parts = ["SELECT sample_id, domain, batch_no, 0 AS rep, feat AS x FROM b "] + (["SELECT sample_id, b.domain, batch_no, 1, probs FROM b JOIN pl USING (sample_id)"] if joint else [])
    return f"""rp AS ({' UNION ALL '.join(parts)}),
kk AS (SELECT batch_no FROM b WHERE domain = 'source' INTERSECT SELECT batch_no FROM b WHERE domain = 'target'),
pr AS (SELECT p.batch_no, p.rep, p.domain AS pd, q.domain AS qd, p.sample_id AS pi, q.sample_id AS qi, list_sum([(u[1] - u[2]) * (u[1] - u[2]) FOR u IN list_zip(p.x, q.x)]) AS d FROM rp p JOIN rp q USING (batch_no, rep) JOIN kk USING (batch_no)),
bw AS (SELECT batch_no, rep, sum(d) / greatest(1, count(*) - sqrt(count(*))) / 4 AS w FROM pr GROUP BY ALL),
kn AS (SELECT batch_no, pd, qd, pi, qi, product(exp(-d / (w + 1e-12)) + exp(-d / (2 * w + 1e-12)) + exp(-d / (4 * w + 1e-12)) + exp(-d / (8 * w + 1e-12)) + exp(-d / (16 * w + 1e-12))) AS k FROM pr JOIN bw USING (batch_no, rep) GROUP BY ALL),
mm AS (SELECT batch_no, pd, qd, avg(k) AS k FROM kn GROUP BY ALL)"""


for _joint in (False, True):

    @query("m16_joint_mmd" if _joint else "m15_mmd_batches", features_sql("SELECT batch_no, round(sum(CASE WHEN pd = qd THEN k ELSE -k END), 6) AS mmd FROM mm GROUP BY batch_no", _mmd_sql(_joint)))
    def m15(spark, d, joint=_joint):
        rows = X.batches(X.with_probs(X.samples(spark, d)) if joint else X.samples(spark, d))
        return r6(align.batch_mmd(rows.filter("domain = 'source'"), rows.filter("domain = 'target'"), ["feat", "probs"] if joint else ["feat"]))


WHOLE = _mmd_sql(False).replace("FROM b ", "FROM bb ").replace("FROM b)", "FROM bb)")


@query("m15_mmd_whole", features_sql("SELECT round(sum(CASE WHEN pd = qd THEN k ELSE -k END), 6) AS mmd FROM mm", "bb AS (SELECT s.*, 0 AS batch_no FROM s), " + WHOLE))
def m15w(spark, d):
    rows = X.samples(spark, d)
    return r6(align.whole_mmd(rows.filter("domain = 'source'"), rows.filter("domain = 'target'"), ["feat"], cell_rows=800, tile=150).select("mmd"))


@query("w6_ema_moments", features_sql("SELECT label AS constraint_id, round(0.5 * (0.5 * e0 + 0.5 * e1) + 0.5 * e2, 6) AS moment FROM (SELECT label, avg(feat[1]) FILTER (sample_id % 3 = 0) AS e0, avg(feat[1]) FILTER (sample_id % 3 = 1) AS e1, avg(feat[1]) FILTER (sample_id % 3 = 2) AS e2 FROM s GROUP BY label)"))
def w6(spark, d):
    by = X.samples(spark, d).groupBy(F.col("label").alias("constraint_id"), (F.col("sample_id") % 3).alias("epoch")).agg(F.avg(F.get("feat", 0)).alias("x"))
    return r6(iis.ema_moments(by, 0.5))


@query("m11_override_moments", features_sql("SELECT layer, component, class, round(pg, 6) AS moment, false AS off FROM pg UNION ALL SELECT layer, component, class, round(2 * pg, 6), true FROM pg"))
def m11(spark, d):
    """The target's own moments put in place of themselves, and twice of them, whose mass is off."""
    _, target = X.source_target(spark, d)
    c = X.CONSTRAINTS
    pg, out = iis.target_moments(target, c), []
    for times in (1, 2):
        moments, off = iis.override_moments(pg, times * pg, c)
        out += [(*c.decode(i), round(float(m), 6), bool(off)) for i, m in enumerate(moments)]
    return spark.createDataFrame(out, "layer string, component int, class int, moment double, off boolean")


@query("u2_latent_backend", features_sql("SELECT layer, component, round(avg(g), 6) AS g FROM gamma WHERE domain = 'target' GROUP BY ALL"))
def u2(spark, d):
    """A backend of the user: the first rows are the prototypes."""

    def first_rows(df: DataFrame, feature: str, k: int, **options) -> latent.SphereModel:
        return latent.SphereModel(np.array([r[feature] for r in df.orderBy("sample_id").limit(k).collect()]), options["kappa"])

    latent.BACKENDS["first_rows"] = first_rows
    try:
        rows = X.with_probs(X.samples(spark, d)).filter("domain = 'target'")
        models = latent.fit_target_structure(rows, X.CONSTRAINTS.layers, "first_rows", kappa=X.KAPPA)
    finally:
        del latent.BACKENDS["first_rows"]
    parts = [latent.responsibilities(rows, m, name, "g").select(F.lit(name).alias("layer"), F.posexplode("g").alias("component", "g")) for name, m in models.items()]
    return r6(parts[0].unionByName(parts[1]).groupBy("layer", "component").agg(F.avg("g").alias("g")))


@query("u3_prediction_fn", features_sql("SELECT pred, count(*) AS n FROM (SELECT sample_id, arg_min(class, p) AS pred FROM probs GROUP BY sample_id) GROUP BY pred"))
def u3(spark, d):
    """Labels by a function of the user: the least likely class."""
    least = lambda c: F.array_position(c, F.array_min(c)).cast("int") - 1
    return scoring.predict(X.with_probs(X.samples(spark, d)), least, "probs").groupBy("pred").agg(F.count("*").alias("n"))


@query("t1_few_distinct_scores", features_sql("SELECT sample_id FROM s WHERE domain = 'target' ORDER BY label, sample_id LIMIT (SELECT ceil(count(*) * 0.3)::BIGINT FROM s WHERE domain = 'target')"))
def t1f(spark, d):
    """Ten distinct scores, cut by ranges down to 20 rows: the cut lies inside a heavy value."""
    rows = X.samples(spark, d).filter("domain = 'target'").select("sample_id", F.col("label").cast("double").alias("entropy"))
    return select.low_entropy_keep(rows, 0.3, small=20).select("sample_id")


@query("t2_few_distinct_scores", features_sql("SELECT n, label AS tau FROM (SELECT label::DOUBLE AS label, row_number() OVER (ORDER BY label DESC) AS n FROM s) WHERE n IN (1, 50, 170, 300)"))
def t2f(spark, d):
    scores = X.samples(spark, d).select(F.col("label").cast("double").alias("score"))
    return spark.createDataFrame([(n, select.relaxed_threshold(scores, "maxprob", n, small=10)) for n in (1, 50, 170, 300)], "n bigint, tau double")


@query("j1_bucketed_weights", features_sql("SELECT sample_id, label, round((sample_id % 7 + 1) / 100::DOUBLE, 6) AS w FROM s WHERE domain = 'source'"))
def j1b(spark, d):
    """Features and weights stored in buckets of the id and joined without an exchange."""
    rows, name = X.samples(spark, d).filter("domain = 'source'"), uuid.uuid4().hex
    weights.write_bucketed(rows.select("sample_id", "label", "feat"), f"features_{name}", shared_folder(spark), 8)
    weights.write_bucketed(_id_weights(rows), f"weights_{name}", shared_folder(spark), 8)
    return r6(weights.attach_bucketed(spark, f"features_{name}", f"weights_{name}").select("sample_id", "label", "w"))


@query("m10_solve_labelled", features_sql("SELECT sample_id, round(w, 9) AS w FROM w3", iis_sql(3)))
def m10l(spark, d):
    """Source classes as labels, of which no one-hot rows are made; broken off after two rounds and resumed."""
    rows = X.scored(spark, d)
    source, kept = rows.filter("domain = 'source'").select("sample_id", "label", *X.CONSTRAINTS.layers), []
    pg = iis.target_moments(rows.filter("domain = 'target'"), X.CONSTRAINTS)
    iis.solve_iis(source, X.CONSTRAINTS, pg, 2, label="label", save=lambda state: kept.append(state.to_json()))
    out = iis.solve_iis(source, X.CONSTRAINTS, pg, 3, label="label", state=iis.SolverState.from_json(kept[-1]))[0]
    return out.select("sample_id", F.round("w", 9).alias("w"))


#: Prototypes and moments of confident target rows only.
CONFIDENT = features_sql("SELECT sample_id, round(0.8 * w + 0.2 / (count(*) OVER ()), 9) AS w FROM w3", iis_sql(3)).replace("tr AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS k FROM s WHERE domain = 'target')", "tr AS (SELECT s.*, row_number() OVER (ORDER BY sample_id) - 1 AS k FROM s JOIN pl USING (sample_id) WHERE s.domain = 'target' AND conf >= 0.5)").replace("WHERE gamma.domain = 'target' GROUP BY ALL", "WHERE gamma.domain = 'target' AND sample_id IN (SELECT sample_id FROM pl WHERE conf >= 0.5) GROUP BY ALL")


def _first_rows(df: DataFrame, feature: str, k: int, **options) -> latent.SphereModel:
    """A backend of the user: the first rows are the prototypes."""
    return latent.SphereModel(np.array([r[feature] for r in df.orderBy("sample_id").limit(k).collect()]), options["kappa"])


@query("m13_weight_updates", CONFIDENT)
def m13s(spark, d):
    """Two epochs of updates with smoothed moments, broken off in the second one and called again; weights of the last."""
    rows = X.with_probs(X.samples(spark, d))
    source, target = rows.filter("domain = 'source'"), rows.filter("domain = 'target'").drop("label")
    latent.BACKENDS["first_rows"] = _first_rows
    cfg = jobs.WeightConfig(X.CONSTRAINTS.layers, X.CLASSES, backend="first_rows", backend_options={"kappa": X.KAPPA}, max_iter=3, tau=0.5, ema_alpha=0.5, fit_rows=1 << 30)
    folder = shared_folder(spark)

    class Stopped(Exception):
        pass

    class Log(jobs.UpdateLog):
        def save(self, state):
            super().save(state)
            if self.epoch == 1 and state.rounds == 2:
                raise Stopped

    plain = jobs.UpdateLog
    try:
        jobs.UpdateLog = Log
        jobs.weight_updates(source, lambda epoch: target, cfg, 2, folder)
    except Stopped:
        pass
    finally:
        jobs.UpdateLog = plain
    try:
        records = jobs.weight_updates(source, lambda epoch: target, cfg, 2, folder)
    finally:
        del latent.BACKENDS["first_rows"]
    return spark.read.parquet(records[-1].weights).select("sample_id", F.round("w", 9).alias("w"))


#: Fixed mixtures with covariance matrices over three dimensions; inverses and determinants go into the SQL as numbers.
MATRICES = {
    "full": latent.MixtureModel(np.array([0.3, 0.7]), np.array([[0.1, 0.0, -0.1], [-0.2, 0.1, 0.2]]), np.array([[[0.5, 0.1, 0.0], [0.1, 0.4, 0.05], [0.0, 0.05, 0.6]], [[0.7, -0.2, 0.1], [-0.2, 0.9, 0.0], [0.1, 0.0, 0.8]]]), "full"),
    "tied": latent.MixtureModel(np.array([0.3, 0.7]), np.array([[0.1, 0.0, -0.1], [-0.2, 0.1, 0.2]]), np.array([[0.5, 0.1, 0.0], [0.1, 0.4, 0.05], [0.0, 0.05, 0.6]]), "tied"),
}


def _em_sql(m: latent.MixtureModel) -> str:
    """One EM step over positions 1 to 3: every entry of the new covariances."""
    def score(j: int) -> str:
        v = m.variances[j] if m.covariance_type == "full" else m.variances
        inv, det = np.linalg.inv(v), float(np.log(np.linalg.det(v)))
        quad = " + ".join(f"({inv[a, b]!r}::DOUBLE) * (x[{a + 1}] - ({m.means[j, a]!r}::DOUBLE)) * (x[{b + 1}] - ({m.means[j, b]!r}::DOUBLE))".replace("np.float64(", "(") for a in range(3) for b in range(3))
        return f"ln({m.weights[j]}::DOUBLE) - 0.5 * ({quad} + ({det!r}::DOUBLE))"

    ctes = f"""mx AS (SELECT feat[1:3] AS x FROM s WHERE domain = 'target'), mz AS (SELECT x, {score(0)} AS a, {score(1)} AS b FROM mx),
mr AS (SELECT x, 0 AS j, 1 / (1 + exp(b - a)) AS r FROM mz UNION ALL SELECT x, 1, 1 / (1 + exp(a - b)) FROM mz),
mm AS (SELECT j, sum(r) AS n, sum(r * x[1]) / sum(r) AS m1, sum(r * x[2]) / sum(r) AS m2, sum(r * x[3]) / sum(r) AS m3 FROM mr GROUP BY j),
mc AS (SELECT j, p, q, sum(r * (x[p] - [m1, m2, m3][p]) * (x[q] - [m1, m2, m3][q])) AS c, any_value(n) AS n FROM mr JOIN mm USING (j), (SELECT unnest([1, 2, 3]) AS p), (SELECT unnest([1, 2, 3]) AS q) GROUP BY j, p, q)"""
    value = "j, p, q, c / n + CASE WHEN p = q THEN 1e-6 ELSE 0 END AS v FROM mc" if m.covariance_type == "full" else "0 AS j, p, q, sum(c) / sum(n) + CASE WHEN p = q THEN 1e-6 ELSE 0 END AS v FROM mc GROUP BY p, q"
    return features_sql(f"SELECT j::INTEGER AS component, (p - 1)::INTEGER AS row, (q - 1)::INTEGER AS col, round(v, 6) AS value FROM (SELECT {value})", ctes)


for _kind, _model in MATRICES.items():

    @query(f"m1_em_step_{_kind}", _em_sql(_model))
    def m1m(spark, d, model=_model):
        rows = X.samples(spark, d).filter("domain = 'target'").select(F.slice("feat", 1, 3).alias("x"))
        v = latent.em_step(rows, "x", model).variances
        v = v if v.ndim == 3 else v[None]
        return r6(spark.createDataFrame([(j, a, b, float(v[j, a, b])) for j in range(len(v)) for a in range(3) for b in range(3)], "component int, row int, col int, value double"))


@query("m15_fourier_mmd")
def m15f(spark, d):
    """MMD of the whole samples by random Fourier features; a linear estimate of ``m15_mmd_whole``."""
    rows = X.samples(spark, d)
    return align.fourier_mmd(rows.filter("domain = 'source'"), rows.filter("domain = 'target'"), ["feat"])


@query("w6_ema_skipped_epochs", features_sql("SELECT label AS constraint_id, round(coalesce(0.5 * e0 + 0.5 * e2, e2, e0), 6) AS moment FROM (SELECT label, avg(feat[1]) FILTER (sample_id % 3 = 0 AND label <> 4) AS e0, avg(feat[1]) FILTER (sample_id % 3 = 2) AS e2 FROM s GROUP BY label)"))
def w6s(spark, d):
    """The second epoch was skipped (null or NaN) for all labels, the first one for one of them."""
    x = F.avg(F.get("feat", 0))
    skipped = F.when(F.col("constraint_id") % 2 == 0, F.lit(None)).otherwise(F.lit(float("nan")))
    by = X.samples(spark, d).groupBy(F.col("label").alias("constraint_id"), (F.col("sample_id") % 3).alias("epoch")).agg(x.alias("x"))
    by = by.withColumn("x", F.when(F.col("epoch") == 1, skipped).when((F.col("epoch") == 0) & (F.col("constraint_id") == 4), F.lit(None)).otherwise(F.col("x")))
    return r6(iis.ema_moments(by, 0.5))


@query("m7_validate_raw_joint", features_sql("""
SELECT round(min(least(e1, e2)), 6) AS min_entry, round(max(greatest(abs(m1 - 1), abs(m2 - 1))), 6) AS max_layer_error, round(max(abs(m1 + m2 - 2)), 6) AS max_total_error, false AS valid
FROM (SELECT list_min([list_min([g * p FOR p IN feat[9:12]]) FOR g IN feat[1:4]]) AS e1, list_min([list_min([g * p FOR p IN feat[9:12]]) FOR g IN feat[5:8]]) AS e2,
 list_sum(feat[1:4]) * list_sum(feat[9:12]) AS m1, list_sum(feat[5:8]) * list_sum(feat[9:12]) AS m2 FROM s)"""))
def m7r(spark, d):
    """Vectors that are no probabilities: negative entries and masses far from one are measured."""
    rows = X.samples(spark, d).select(F.slice("feat", 1, 4).alias("a"), F.slice("feat", 5, 4).alias("b"), F.slice("feat", 9, 4).alias("probs"))
    return r6(iis.validate_joint(rows, ["a", "b"]))
