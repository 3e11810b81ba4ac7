"""Latent models, selection, alignment and heads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftweight.operators import align, heads, latent, scoring, select
from shiftweight.plans import jobs


def points(spark, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "sample_id int, x array<double>")


def clusters(centers, n, seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.05, (n, len(c))) for c in centers])


def test_vmf_softmax(spark):
    g = np.array([r.g for r in latent.responsibilities(points(spark, np.eye(2)), latent.SphereModel(np.eye(2), 2.5), "x", "g").collect()])
    e = np.exp(2.5)
    assert np.allclose(g, [[e / (e + 1), 1 / (e + 1)], [1 / (e + 1), e / (e + 1)]])


def test_gmm_separates_and_likelihood_grows(spark):
    df = points(spark, clusters([(0, 0), (4, 4)], 30)).repartition(3)
    m = latent.fit_gmm(df, "x", 2, max_iter=20)
    assert sorted(np.round(m.means[:, 0])) == [0, 4] and np.allclose(m.weights, 0.5, atol=0.01)
    start = latent.MixtureModel(np.array([0.5, 0.5]), np.array([[1.0, 1.0], [2.0, 3.0]]), np.ones((2, 2)))
    ll = []
    for _ in range(4):
        start = latent.em_step(df, "x", start)
        ll.append(start.log_likelihood)
    assert all(b >= a - 1e-9 for a, b in zip(ll, ll[1:]))


def test_bic_and_vmf_fit(spark):
    df = points(spark, clusters([(0, 0), (4, 4), (0, 4)], 20))
    assert 1 < latent.select_gmm_bic(df, "x", 2, 4, max_iter=15).n_components < 4
    m = latent.fit_vmf(points(spark, clusters([(1, 0), (0, 1)], 15)), "x", 2, n_init=2)
    assert np.allclose(np.linalg.norm(m.centroids, axis=1), 1)


def test_fit_errors(spark):
    with pytest.raises(ValueError):
        latent.fit_gmm(points(spark, []), "x", 2)
    with pytest.raises(ValueError):
        latent.backend("nope")


def test_target_structure_and_update(spark):
    rng = np.random.default_rng(1)
    x = clusters([(1, 0), (0, 1)], 20)
    p = np.where(np.arange(40)[:, None] < 20, [[0.95, 0.05]], [[0.1, 0.9]])
    data = [(i, int(i >= 20), list(map(float, v)), list(map(float, q))) for i, (v, q) in enumerate(zip(x, p))]
    rows = spark.createDataFrame(data, "sample_id int, label int, l array<double>, probs array<double>")
    models = latent.fit_target_structure(rows, {"l": 2}, "vmf", clean_ratio=0.5, n_init=1)
    assert models["l"].n_components == 2
    cfg = jobs.WeightConfig({"l": 2}, 2, backend_options={"n_init": 1}, tau=0.9, max_iter=5, mix_alpha=1.0)
    target = rows.filter("sample_id < 30").drop("label")  # labels are never read: they are not there
    w, record = jobs.update_importance_weights(rows, target, cfg)
    got = {r.sample_id: r.w for r in w.collect()}
    assert record.status == "updated" and record.target_selected == 30 and np.isclose(sum(got.values()), 1)
    assert sum(v for k, v in got.items() if k < 20) > 0.6
    none, skipped = jobs.update_importance_weights(rows, target, jobs.WeightConfig({"l": 2}, 2, tau=0.99, min_count=5, policy="skip_update"), record)
    assert none is None and skipped.status == "skipped_low_confidence" and np.array_equal(skipped.moments, record.moments)
    del rng


def test_one_shot_job(spark):
    x = clusters([(1, 0), (0, 1)], 10)
    side = lambda keep: spark.createDataFrame([(i, list(map(float, v)), [4.0, 0.0] if i < 10 else [0.0, 4.0]) for i, v in enumerate(x) if keep(i)], "sample_id int, l array<double>, logits array<double>")
    out, history, summary = jobs.one_shot_weights(side(lambda i: True), side(lambda i: i < 15), jobs.WeightConfig({"l": 2}, 2, backend_options={"n_init": 1}, mix_alpha=1.0, max_iter=4))
    assert np.isclose(summary.first()["sum"], 1) and history.count() == 4
    assert out.filter("sample_id < 10").agg(F.sum("w")).first()[0] > 0.6


def test_confidence_filter(spark):
    from shiftweight.functions.vectors import softmax

    logits = [(0, [10.0, 0.0]), (1, [0.0, 10.0]), (2, [0.2, 0.0]), (3, [0.0, 0.2])]
    df = spark.createDataFrame(logits, "sample_id int, logits array<double>").withColumn("probs", softmax(F.col("logits")))
    kept, tau, status = select.select_confident(df, "maxprob", 0.9, 1)
    assert {r.sample_id for r in kept.collect()} == {0, 1} and status == "selected"
    kept, tau, status = select.select_confident(df, "maxprob", 0.9, 3)
    assert status == "relaxed" and kept.count() >= 3 and tau < 0.9


def test_exact_lowest_of_nulls_and_ties(spark, monkeypatch):
    """Null and NaN scores come last, huge ties are cut by id, and the cut is narrowed in several rounds."""
    from shiftweight.operators import ranges

    monkeypatch.setattr(ranges, "SMALL", 10)
    nan = float("nan")
    rows = [(i, 0.5 if i % 3 == 0 else i / 1000.0) for i in range(900)] + [(1000, None), (1001, nan), (-1, 0.5), (-2, None)]
    df = spark.createDataFrame(rows, "sample_id int, s double").repartition(5)
    known = [r for r in rows if r[1] is not None and r[1] == r[1]]
    for down in (False, True):
        order = [i for i, _ in sorted(known, key=lambda r: (-r[1] if down else r[1], r[0]))]
        for n in (0, 1, 7, 250, 480, 560, 899, 901):
            assert sorted(r.sample_id for r in select.exact_lowest(df, "s", n, descending=down).collect()) == sorted(order[:n]), (down, n)
        assert select.exact_lowest(df, "s", 903, descending=down).count() == 903 and select.exact_lowest(df, "s", 2000, descending=down).count() == 904
    few = spark.createDataFrame([(1, None), (2, 0.1), (3, 0.5), (4, 0.9)], "sample_id int, entropy double")
    assert sorted(r.sample_id for r in select.low_entropy_keep(few, 0.5).collect()) == [2, 3]
    best = sorted((s for _, s in known), reverse=True)
    assert select.relaxed_threshold(df, "maxprob", 300, "s") == best[299] and select.relaxed_threshold(df, "entropy", 450, "s") == best[::-1][449]
    assert select.relaxed_threshold(df, "entropy", 5000, "s") == best[0] and select.relaxed_threshold(df.limit(0), "entropy", 5, "s") is None


def test_block_mmd_is_the_mean_of_blocks(spark):
    rng = np.random.default_rng(1)
    frame = lambda m: spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(m)], "sample_id int, x array<double>")
    a, b = rng.normal(size=(300, 3)), rng.normal(size=(260, 3)) + 1
    near, far = (align.block_mmd(frame(a), frame(m), ["x"], block_rows=100).first() for m in (a[::-1], b))
    assert far.blocks == 2 and far.mmd > 3 * near.mmd
    assert np.isclose(align.block_mmd(frame(a), frame(b), ["x"]).first().mmd, align.mmd_matrix([a], [b]))


def test_exact_lowest_and_pseudo(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(500), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "sample_id int, entropy double")
    want = set(sorted(range(500), key=lambda i: (s[i], i))[:150])
    assert {r.sample_id for r in select.low_entropy_keep(df, 0.3).collect()} == want
    p = spark.createDataFrame([(i, [0.9, 0.1]) for i in range(10)], "sample_id int, probs array<double>")
    assert {r.sample_id for r in select.select_pseudo_labels(p, 0.9, 0.4, 10).collect()} == {0, 1, 2, 3}
    assert select.select_pseudo_labels(p, 0.9, 0.0, 10).count() == 0 and select.select_pseudo_labels(p, 0.9, -1, 10).count() == 10


def test_mmd(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (16, 8)), rng.normal(2, 1, (16, 8))
    assert align.mmd_matrix([a], [b]) > 1e-4 and abs(align.mmd_matrix([a], [a])) < 1e-12
    frame = lambda m: spark.createDataFrame([(i, 0, list(map(float, v))) for i, v in enumerate(m)], "sample_id int, batch_no int, x array<double>")
    whole = align.whole_mmd(frame(a), frame(b), ["x"], cell_rows=10, tile=5).first().mmd
    assert np.isclose(whole, align.mmd_matrix([a], [b])) and np.isclose(align.batch_mmd(frame(a), frame(b), ["x"]).first().mmd, whole)


def test_heads_and_scoring(spark):
    x = clusters([(0, 0), (3, 3)], 20)
    s = spark.createDataFrame([(i, list(map(float, v)), int(i >= 20), 1.0) for i, v in enumerate(x)], "sample_id int, feat array<double>, label int, w double")
    out = heads.head_predictions(s, heads.fit_weighted_head(s, max_iter=20))
    assert out.filter("pred = label").count() == 40
    assert heads.domain_separability(s.filter("label = 0"), s.filter("label = 1")).first()[0] == 1.0
    scored = scoring.predict(scoring.score(s, scoring.LinearScorer(np.array([[-1.0, -1.0], [1.0, 1.0]]), np.array([1.5, -1.5])), "feat"))
    assert scored.filter("pred = label").count() == 40


def test_fit_sample_is_the_lowest_hashes(spark):
    df = spark.range(5000).withColumnRenamed("id", "sample_id")
    want = [r[0] for r in df.orderBy(F.xxhash64("sample_id", F.lit(1)), "sample_id").limit(50).collect()]
    assert [r[0] for r in select.fit_sample(df, 50, 1).collect()] == want


def test_layers_are_scored_in_one_python_pass(spark, data):
    from shiftweight.plans import fixtures

    plan = fixtures.scored(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one for each layer and one for the classes: three Python workers a task


def test_restarts_run_side_by_side(spark, monkeypatch):
    import threading

    seen = threading.Barrier(3, timeout=60)
    fit = latent.KMeans.fit

    def together(self, part):
        seen.wait()  # breaks if fits run one after another
        return fit(self, part)

    monkeypatch.setattr(latent.KMeans, "fit", together)
    df = points(spark, clusters([(1, 0), (0, 1)], 15))
    assert latent.kmeans_centers(df, "x", 2, seed=0, n_init=3).shape == (2, 2)
