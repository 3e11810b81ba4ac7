"""Forms for large tables against the plain ones: bucketed joins, grids, random features, matrices, restarts, changed files."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftweight.operators import align, latent, weights
from shiftweight.sources import files
from shiftweight.sources.incremental import RunFiles


def vectors(spark, x, **columns):
    rows = [(i, v.tolist(), *(c[i] for c in columns.values())) for i, v in enumerate(np.asarray(x, float))]
    return spark.createDataFrame(rows, "sample_id int, x array<double>" + "".join(f", {c} array<double>" for c in columns)).repartition(5)


def test_bucketed_tables_join_without_exchange(spark):
    name = uuid.uuid4().hex
    rows = spark.range(2000).select(F.col("id").alias("sample_id"), F.array(F.rand(1), F.rand(2)).alias("x"))
    w = spark.range(2000).select(F.col("id").alias("sample_id"), (F.col("id") % 7 / 10.0).alias("w"))
    weights.write_bucketed(rows, f"f_{name}", files.shared_folder(spark), 4)
    weights.write_bucketed(w, f"w_{name}", files.shared_folder(spark), 4)
    out = weights.attach_bucketed(spark, f"f_{name}", f"w_{name}")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
    assert out.count() == 2000 and out.filter("abs(w - sample_id % 7 / 10.0) > 1e-12").isEmpty()
    weights.write_bucketed(w.withColumn("w", F.lit(-1.0)), f"b_{name}", files.shared_folder(spark), 4)
    with pytest.raises(Exception, match="bad weight"):
        weights.attach_bucketed(spark, f"f_{name}", f"b_{name}").collect()


def test_grid_mmd_is_exact_and_copies_little(spark):
    rng = np.random.default_rng(3)
    x, y, p, q = rng.normal(size=(130, 5)), rng.normal(size=(90, 5)) + 0.4, rng.dirichlet([1] * 3, 130), rng.dirichlet([2] * 3, 90)
    s, t = vectors(spark, x, p=p.tolist()), vectors(spark, y, p=q.tolist())
    for options in ({"tasks": 1}, {"tasks": 10}, {"tasks": 4, "cell_rows": 40, "tile": 7}):
        r = align.whole_mmd(s, t, ["x", "p"], **options).first()
        assert np.isclose(r.mmd, align.mmd_matrix([x, p], [y, q]), rtol=1e-9)
        assert r.copies == align.grid_size(220, options["tasks"], options.get("cell_rows", 40_000))
    # A thousand tasks over a million rows: each row goes to 50 of them; with blocks of 2,000 rows it would be 500.
    assert align.grid_size(1_000_000, 1_000, 50_000) == 44 and align.grid_size(10_000, 1, 40_000) == 1 and align.grid_size(10, 8, 40_000) == 3


def test_fourier_mmd_is_within_its_error(spark):
    rng = np.random.default_rng(4)
    for shift in (0.0, 0.8):
        x, y, p, q = rng.normal(size=(300, 4)), rng.normal(size=(260, 4)) + shift, rng.normal(size=(300, 2)), rng.normal(size=(260, 2)) - shift
        s, t = vectors(spark, x, p=p.tolist()), vectors(spark, y, p=q.tolist())
        for names, xs, ys in ((["x"], [x], [y]), (["x", "p"], [x, p], [y, q])):
            r = align.fourier_mmd(s, t, names, count=4096).first()
            exact = align.mmd_matrix(xs, ys)
            assert abs(r.mmd - exact) <= min(5 * r.std_error + 1e-3, r.bound)
    with pytest.raises(ValueError):
        align.fourier_mmd(s, t.limit(0), ["x"])


def direct_em(x, m, reg):
    """EM step by loops over components, with inverses."""
    cov = m.variances if m.covariance_type == "full" else [m.variances] * m.n_components
    z = np.stack([np.log(w) - 0.5 * (np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(v), x - mu) + np.log(np.linalg.det(2 * np.pi * v))) for w, mu, v in zip(m.weights, m.means, cov, strict=True)], axis=1)
    ll = np.log(np.exp(z).sum(axis=1))
    r = np.exp(z - ll[:, None])
    means = [np.average(x, axis=0, weights=w) for w in r.T]
    covs = [np.cov(x.T, aweights=w, ddof=0) + reg * np.eye(x.shape[1]) for w in r.T]
    tied = sum(w.sum() * (c - reg * np.eye(x.shape[1])) for w, c in zip(r.T, covs, strict=True)) / len(x) + reg * np.eye(x.shape[1])
    return r.mean(axis=0), np.array(means), np.array(covs) if m.covariance_type == "full" else tied, ll.sum()


@pytest.mark.parametrize("kind", ["full", "tied"])
def test_em_step_with_matrices(spark, kind):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.multivariate_normal([1000, 0], [[1, 0.8], [0.8, 1]], 150), rng.multivariate_normal([1004, 3], [[1, 0.8], [0.8, 1]], 90)])
    cov = np.array([[2.0, 0.3], [0.3, 1.5]])
    m = latent.MixtureModel(np.array([0.4, 0.6]), np.array([[1001.0, 0], [1003.0, 2]]), np.stack([cov, cov + 0.1]) if kind == "full" else cov, kind)
    got = latent.em_step(vectors(spark, x), "x", m)
    w, means, covs, ll = direct_em(x, m, 1e-6)
    assert np.allclose(got.weights, w) and np.allclose(got.means, means) and np.allclose(got.variances, covs, atol=1e-8) and np.isclose(got.log_likelihood, ll)
    fitted = latent.fit_gmm(vectors(spark, x), "x", 2, kind)
    near = fitted.means[np.argsort(fitted.means[:, 0])]
    assert np.abs(near - [[1000, 0], [1004, 3]]).max() < 0.6 and fitted.log_likelihood > ll
    assert fitted.parameters() == (11 if kind == "full" else 8) and fitted.bic(240) < latent.fit_gmm(vectors(spark, x), "x", 2, "spherical").bic(240)
    g = latent.responsibilities(vectors(spark, x), fitted, "x", "g").filter("abs(g[0] + g[1] - 1) > 1e-9")
    assert g.isEmpty()


def test_restarts_on_a_sample_cost_as_little(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(400, 3)) * 0.3 + c for c in rng.normal(size=(6, 3)) * 2])
    df = vectors(spark, x).persist()
    cost = lambda c: float(((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
    whole = latent.kmeans_centers(df, "x", 6, seed=0, n_init=10, sample=10_000)
    rounds = []
    lloyd = latent.lloyd
    monkeypatch.setattr(latent, "lloyd", lambda *a, **o: rounds.append(1) or lloyd(*a, **o))
    thin = latent.kmeans_centers(df, "x", 6, seed=0, n_init=10, sample=300)
    assert cost(thin) <= 1.01 * cost(whole) and len(rounds) == 1
    centers, value = lloyd(df, "x", whole, max_iter=1)
    assert np.isclose(value, cost(whole)) and cost(centers) <= cost(whole) + 1e-9
    far = lloyd(df, "x", np.vstack([whole, [[1e6] * 3]]))[0]
    assert (far[6] == 1e6).all()  # a center without rows stays
    df.unpersist()


def run_file(root, run, rows, name="metrics.csv"):
    folder = root / "d" / "a2b" / "m" / run
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text("dataset,src,tgt,method,run_id,seed,source_acc,target_acc\n" + "".join(f"d,a,b,m,{run},0,1.0,{v}\n" for v in rows))


def test_unchanged_run_files_are_not_opened(spark, tmp_path):
    root, asked = tmp_path / "runs", []
    for run in ("r1", "r2", "r3"):
        run_file(root, run, [1.0, 2.0])

    def read(paths):
        asked.append(sorted(p.split("/")[-2] for p in paths))
        return files.read_metrics_csv(spark, str(root), "last", paths)

    store = RunFiles(spark, str(root), "metrics.csv", str(tmp_path / "store"), read, 4)
    assert store.table() is None and store.refresh() == 3 and store.refresh() == 0 and len(asked) == 1
    run_file(root, "r2", [1.0, 2.0, 33.0])
    run_file(root, "r4", [4.0])
    os.remove(root / "d/a2b/m/r3/metrics.csv")
    again = RunFiles(spark, str(root), "metrics.csv", str(tmp_path / "store"), read)
    assert again.refresh() == 2 and asked[-1] == ["r2", "r4"]
    assert {r.run_id: r.target_acc for r in again.table().collect()} == {"r1": 2.0, "r2": 33.0, "r4": 4.0}
    run_file(root, "r4", [])
    assert again.refresh() == 1 and {r.run_id for r in again.table().collect()} == {"r1", "r2"}


def test_first_and_last_row_of_a_file_read_in_blocks(spark, tmp_path):
    run_file(tmp_path / "runs", "r1", range(3000))
    with_blocks = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k) for k in with_blocks}
    try:
        for k, v in with_blocks.items():
            spark.conf.set(k, v)
        assert spark.read.csv(str(tmp_path / "runs/*/*/*/*/*.csv")).rdd.getNumPartitions() > 3
        got = [files.read_metrics_csv(spark, str(tmp_path / "runs"), pick).first() for pick in ("first", "last")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.target_acc for r in got] == [0.0, 2999.0] and got[0].dir_run_id == "r1"


def test_cells_of_the_mmd_move_alike_however_many_rows(spark):
    # Copies hang on the tasks alone; with cells of 800 rows they were 1,500 of each of 600,000 rows.
    assert align.grid_size(600_000, 24, 800) == align.grid_size(6_000, 24, 800) == 6
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(90, 4)), rng.normal(size=(70, 4)) + 0.3
    r = align.whole_mmd(vectors(spark, x), vectors(spark, y), ["x"], tasks=3, cell_rows=20, tile=3).first()
    assert np.isclose(r.mmd, align.mmd_matrix([x], [y]), rtol=1e-9) and r.copies == 2
    d = rng.random((5, 6)) * 9
    for width, mul, num in ((2.0, 2.0, 5), (2.0, 3.0, 4), (1e-9, 2.0, 5)):
        assert np.allclose(align._mixture(d.copy(), width, mul, num), align._kernel(d, width, mul, num), rtol=1e-9, atol=1e-12)
