"""Label-indexed kernel, resumed solves and updates, stored upserts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftweight.functions.vectors import one_hot
from shiftweight.operators import iis, latent
from shiftweight.plans import jobs
from shiftweight.sources.files import shared_folder
from shiftweight.sources.snapshots import Folder, SnapshotTable, VersionExists


def labelled(spark, rows=300, classes=6, odd=True):
    rng = np.random.default_rng(5)
    g = rng.dirichlet([1, 1, 1], rows)
    h = rng.dirichlet([2, 1], rows)
    y = rng.integers(0, classes, rows).tolist()
    if odd:
        y[3], y[4], y[5] = None, -1, classes
    return spark.createDataFrame([(i, a.tolist(), b.tolist(), k) for i, (a, b, k) in enumerate(zip(g, h, y, strict=True))], "sample_id int, a array<double>, b array<double>, label int").repartition(5)


def target_moments(rng, c):
    return rng.dirichlet(np.ones(c.size // 1), 1)[0] * len(c.layers)


@pytest.mark.parametrize("damping", [0.0, 0.3])
def test_label_kernel_equals_the_dense_one(spark, damping):
    c = iis.Constraints({"a": 3, "b": 2}, 6)
    source, pg = labelled(spark), target_moments(np.random.default_rng(1), c)
    dense, lam, history = iis.solve_iis(source.withColumn("probs", one_hot(F.col("label"), 6)), c, pg, 5, damping=damping)
    thin, lam2, history2 = iis.solve_iis(source, c, pg, 5, damping=damping, label="label")
    assert np.allclose(lam, lam2, rtol=0, atol=1e-12) and "probs" not in thin.columns
    assert np.allclose([list(vars(h).values()) for h in history], [list(vars(h).values()) for h in history2], rtol=1e-12, atol=1e-12)
    w = [np.array([r.w for r in x.orderBy("sample_id").collect()]) for x in (dense, thin)]
    assert np.allclose(*w, rtol=0, atol=1e-15) and np.isclose(w[1].sum(), 1)
    assert iis.unachievable_constraints(source.filter("label <> 2"), pg, c, label="label") == [(n, j, 2) for n, k in c.layers.items() for j in range(k)]
    assert np.allclose(iis.model_moments(thin, c, label="label"), iis.model_moments(dense, c))


def test_label_kernel_of_many_classes(spark):
    """A thousand classes: what reaches Python is one number a row, not a thousand."""
    c = iis.Constraints({"a": 3}, 1000)
    source = labelled(spark, 200, 1000, odd=False)
    pg = np.zeros(c.size)
    seen = sorted({r.label for r in source.collect()})
    for j in range(3):
        pg[[c.encode("a", j, y) for y in seen]] = np.random.default_rng(j).random(len(seen))
    pg /= pg.sum()
    thin, lam, history = iis.solve_iis(source, c, pg, 3, label="label")
    _, lam2, _ = iis.solve_iis(source.withColumn("probs", one_hot(F.col("label"), 1000)), c, pg, 3)
    assert np.allclose(lam, lam2, rtol=0, atol=1e-12) and history[-1].max_error < history[0].max_error
    plan = thin._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "transform" not in plan


def test_solve_goes_on_behind_a_saved_state(spark):
    c = iis.Constraints({"a": 3, "b": 2}, 6)
    source, pg = labelled(spark), target_moments(np.random.default_rng(2), c)
    whole, lam, history = iis.solve_iis(source, c, pg, 15, damping=0.2, label="label")
    kept = []

    class Killed(Exception):
        pass

    def save(state):
        kept.append(state.to_json())
        if state.rounds == 7:
            raise Killed

    with pytest.raises(Killed):
        iis.solve_iis(source, c, pg, 15, damping=0.2, label="label", save=save)
    rest, lam2, history2 = iis.solve_iis(source, c, pg, 15, damping=0.2, label="label", state=iis.SolverState.from_json(kept[-1]))
    assert len(history2) == 15 and [h.iteration for h in history2] == list(range(15))
    assert np.allclose(lam, lam2, rtol=0, atol=1e-12) and np.isclose(history[-1].kl, history2[-1].kl)
    done = iis.SolverState.from_json(kept[-1])
    assert iis.solve_iis(source, c, pg, 7, damping=0.2, label="label", state=done)[2] == done.history
    with pytest.raises(ValueError):
        iis.solve_iis(source, iis.Constraints({"a": 3}, 6), pg, 15, label="label", state=done)


def series(spark, monkeypatch, tmp_path, name, killed_at=None):
    rng = np.random.default_rng(0)
    make = lambda n, shift: [(i, (rng.normal(size=4) + shift).tolist(), int(i % 3), rng.dirichlet([0.3] * 3).tolist()) for i in range(n)]
    schema = "sample_id int, x array<double>, label int, probs array<double>"
    source, targets = spark.createDataFrame(make(200, 0), schema), [spark.createDataFrame(make(120, s), schema).drop("label") for s in (0.2, 0.5, 0.8)]
    cfg = jobs.WeightConfig({"x": 3}, 3, backend="vmf", max_iter=5, tau=0.5, min_count=5, ema_alpha=0.4)
    folder, asked = str(tmp_path / name), []

    def target_of(epoch):
        asked.append(epoch)
        return targets[epoch].limit(0) if epoch == 1 else targets[epoch]

    if killed_at:
        save = jobs.UpdateLog.save

        def broken(self, state):
            save(self, state)
            if (self.epoch, state.rounds) == killed_at:
                raise KeyboardInterrupt

        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(jobs.UpdateLog, "save", broken)
            jobs.weight_updates(source, target_of, cfg, 3, folder)
    records = jobs.weight_updates(source, target_of, cfg, 3, folder)
    return records, [spark.read.parquet(r.weights).orderBy("sample_id").toPandas() for r in records if r.weights], asked, folder


def test_updates_over_epochs_resume(spark, monkeypatch, tmp_path):
    plain, w, asked, _ = series(spark, monkeypatch, tmp_path, "plain")
    assert [r.status for r in plain] == ["updated", "skipped_empty_target", "updated"] and asked == [0, 1, 2]
    assert np.allclose(plain[1].moments, plain[0].moments)  # a skipped epoch leaves the moments
    again, w2, asked2, folder = series(spark, monkeypatch, tmp_path, "killed", (2, 3))
    assert asked2 == [0, 1, 2, 2] and [r.status for r in again] == [r.status for r in plain]
    for a, b in zip(w, w2, strict=True):
        assert np.allclose(a.w, b.w, rtol=0, atol=1e-12) and np.isclose(a.w.sum(), 1)
    assert len(again[2].history) == 5 and again[2].epoch == 2
    names = Folder(spark, folder).names()
    assert sum(n.startswith("epoch-000002-round") for n in names) == 5 and "epoch-000002.json" in names


def runs_table(spark, rows):
    return spark.createDataFrame(rows, "run_id string, score double, row_no bigint")


def test_stored_upsert(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), buckets=8)
    assert table.read() is None and table.version() == 0
    assert table.upsert(runs_table(spark, [(f"r{i}", float(i), i) for i in range(40)] + [("r3", 33.0, 99)])) == 1
    before = table.read()
    assert table.upsert(runs_table(spark, [("r5", 55.0, 1), (" r6", 66.0, 1), ("new", 1.0, 1)]).withColumn("note", F.lit("x"))) == 2
    got = {r.run_id.strip(): (r.score, r.note) for r in table.read().collect()}
    assert len(got) == 41 and got["r5"] == (55.0, "x") and got["r6"] == (66.0, "x") and got["r3"] == (33.0, None) and got["new"] == (1.0, "x")
    assert before.columns == ["run_id", "score", "row_no"] and {r.run_id: r.score for r in before.collect()}["r5"] == 5.0  # readers keep theirs
    assert table.read(1).count() == 40 and table.upsert(runs_table(spark, [])) == 2
    with pytest.raises(Exception, match="without key"):
        table.upsert(runs_table(spark, [("  ", 1.0, 1)])).bit_length()
    assert table.version() == 2 and SnapshotTable(spark, str(tmp_path / "t"), buckets=3).buckets == 8


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), buckets=16)
    table.upsert(runs_table(spark, [(f"r{i}", 0.0, i) for i in range(200)]))
    table.upsert(runs_table(spark, [("r7", 1.0, 0)]))
    first, second = (set(table._manifest(v)["folders"].values()) for v in (1, 2))
    assert len(first) == 1 and len(second) == 2 and len(list((tmp_path / "t/data" / (second - first).pop()).glob("bucket_=*"))) == 1
    assert table.expire(keep=1) == [1] and table.read().count() == 200 and table.read().filter("run_id = 'r7'").first().score == 1.0


def test_failed_and_late_upserts_change_nothing(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"), buckets=4)
    table.upsert(runs_table(spark, [("a", 1.0, 1), ("b", 2.0, 2)]))
    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost driver")))
        with pytest.raises(RuntimeError):
            table.upsert(runs_table(spark, [("a", 9.0, 1)]))
    assert table.version() == 1 and {r.run_id: r.score for r in table.read().collect()} == {"a": 1.0, "b": 2.0}
    late = SnapshotTable(spark, str(tmp_path / "t"))
    publish = SnapshotTable._publish

    def slow(self, version, known):
        if self is late:
            table.upsert(runs_table(spark, [("b", 7.0, 1)]))
        publish(self, version, known)

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_publish", slow)
        with pytest.raises(VersionExists):
            late.upsert(runs_table(spark, [("a", 8.0, 1)]))
    assert table.version() == 2 and {r.run_id: r.score for r in table.read().collect()} == {"a": 1.0, "b": 7.0}
    assert late.upsert(runs_table(spark, [("a", 8.0, 1)])) == 3 and table.read().count() == 2


def test_folder_of_small_files(spark):
    folder = Folder(spark, shared_folder(spark))
    assert folder.names() == []
    folder.put("b.json", "é\n")
    folder.put("a.json", "")
    with pytest.raises(VersionExists):
        folder.put("a.json", "other")
    assert folder.names() == ["a.json", "b.json"] and folder.get("b.json") == "é\n" and folder.get("a.json") == ""


def test_update_job_never_makes_one_hot_rows(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist(), i % 2, [0.9, 0.1]) for i in range(60)], "sample_id int, x array<double>, label int, probs array<double>")
    cfg = jobs.WeightConfig({"x": 2}, 2, tau=0.5, max_iter=2)
    out, record = jobs.update_importance_weights(rows, rows.drop("label"), cfg)
    assert record.status == "updated" and out.columns == ["sample_id", "w"] and np.isclose(out.agg(F.sum("w")).first()[0], 1)
    assert isinstance(latent.backend("vmf")(rows, "x", 2), latent.SphereModel)
