"""Closed-form cases of moments, solver and weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftweight.operators import iis, weights

C1 = iis.Constraints({"g": 2}, 1)


def rows(spark, gammas, probs=None, w=None):
    data = [(i, list(map(float, g)), list(map(float, probs[i] if probs else [1.0])), float(w[i] if w else 0)) for i, g in enumerate(gammas)]
    return spark.createDataFrame(data, "sample_id int, g array<double>, probs array<double>, w double")


def solved(spark, source, target, c=C1, **options):
    pg = iis.target_moments(target, c)
    out, _, history = iis.solve_iis(source.drop("w"), c, pg, **options)
    return np.array([r.w for r in out.orderBy("sample_id").collect()]), history


def one_hot_cells(layers, classes):
    """Every (component, class) cell as one row of hard responsibilities and labels."""
    return [(np.eye(layers)[j].tolist(), np.eye(classes)[k].tolist()) for j in range(layers) for k in range(classes)]


def direct_iis(f, pg, layers, rounds, step=1.0, damping=0.0):
    """Weights by plain loops over a dense feature matrix: what the distributed solver must reproduce."""
    w, before = np.full(len(f), 1 / len(f)), None
    for _ in range(rounds):
        d = step * np.log(np.maximum(pg, 1e-12) / np.maximum(w @ f, 1e-12)) / layers
        d = d if before is None else (1 - damping) * d + damping * before
        before = d
        w = w * np.exp(f @ d)
        w /= w.sum()
    return w


@pytest.mark.parametrize("counts", [[3, 9], [2, 5, 13], [7, 1, 1, 1]])
def test_hard_components_get_the_target_shares(spark, counts):
    """With one-hot rows each weight is the target's share of its component, whatever the source shares are."""
    k = len(counts)
    c = iis.Constraints({"g": k}, 1)
    source = np.eye(k)[np.repeat(np.arange(k), np.arange(1, k + 1))]
    w, h = solved(spark, rows(spark, source.tolist()), rows(spark, np.eye(k)[np.repeat(np.arange(k), counts)].tolist()), c, max_iter=4)
    assert np.allclose(w @ source, np.array(counts) / sum(counts)) and h[-1].max_error < 1e-8


def test_hard_cells_of_components_and_classes(spark):
    """The same for cells of three components and two classes, with counts drawn at random."""
    counts = np.random.default_rng(11).integers(1, 9, 6)
    cells = one_hot_cells(3, 2)
    target = [cells[i] for i, n in enumerate(counts) for _ in range(n)]
    w, h = solved(spark, rows(spark, [x for x, _ in cells], [p for _, p in cells]), rows(spark, [x for x, _ in target], [p for _, p in target]), iis.Constraints({"g": 3}, 2), max_iter=3)
    assert np.allclose(w, counts / counts.sum(), atol=1e-8)
    assert all(b.objective >= a.objective - 1e-10 for a, b in zip(h, h[1:]))


@pytest.mark.parametrize("step,damping", [(1.0, 0.0), (0.7, 0.0), (1.0, 0.25)])
def test_soft_rows_equal_the_dense_form(spark, step, damping):
    rng = np.random.default_rng(5)
    c = iis.Constraints({"g": 3}, 2)
    (gs, ps), (gt, pt) = ((rng.dirichlet([1, 2, 3], n), rng.dirichlet([2, 1], n)) for n in (23, 17))
    dense = lambda g, p: np.einsum("nj,nc->njc", g, p).reshape(len(g), -1)
    w, h = solved(spark, rows(spark, gs.tolist(), ps.tolist()), rows(spark, gt.tolist(), pt.tolist()), c, max_iter=6, step=step, damping=damping)
    assert np.allclose(w, direct_iis(dense(gs, ps), dense(gt, pt).mean(axis=0), 1, 6, step, damping), atol=1e-10)
    if step == 1 and not damping:
        assert all(b.max_error <= a.max_error + 1e-12 for a, b in zip(h, h[1:]))


def test_equal_sides_stay_uniform(spark):
    x = np.random.default_rng(2).dirichlet([3, 1], 7).tolist()
    w, _ = solved(spark, rows(spark, x), rows(spark, x), max_iter=4)
    assert np.allclose(w, 1 / 7, atol=1e-12)


def test_unreachable_constraint(spark):
    """The third component has target mass that no source row can give."""
    c = iis.Constraints({"g": 3}, 1)
    source, target = rows(spark, [[1, 0, 0], [0, 1, 0], [0.5, 0.5, 0]]), rows(spark, [[0, 0.25, 0.75], [1, 0, 0]])
    pg = iis.target_moments(target, c)
    assert iis.unachievable_constraints(source, pg, c) == [("g", 2, 0)]
    w, _ = solved(spark, source, target, c, max_iter=3)
    assert np.isclose(w.sum(), 1)


def test_moments(spark):
    rng = np.random.default_rng(3)
    c = iis.Constraints({"g": 2}, 3)
    gam, p, w = rng.dirichlet([1, 1], 9), rng.dirichlet([1, 1, 1], 9), rng.dirichlet(np.ones(9))
    plain = lambda weight: [sum(weight[n] * gam[n, j] * p[n, k] for n in range(9)) for j in range(2) for k in range(3)]
    assert np.allclose(iis.target_moments(rows(spark, gam.tolist(), p.tolist()), c), plain(np.full(9, 1 / 9)), atol=1e-12)
    assert np.allclose(iis.model_moments(rows(spark, gam.tolist(), p.tolist(), w.tolist()), c), plain(w), atol=1e-12)
    assert np.allclose(iis.iis_delta(np.array([0.6, 0.0]), np.array([0.2, 0.0]), 3), [np.log(3) / 3, 0])


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(0)
    source = rows(spark, rng.dirichlet([1, 1], 40).tolist())
    target = rows(spark, rng.dirichlet([2, 1], 30).tolist())
    a, b = (solved(spark, source.repartition(n), target.repartition(n), max_iter=4, damping=0.3)[0] for n in (1, 8))
    assert np.allclose(a, b, atol=1e-12)


def test_tolerance_ends_the_rounds(spark):
    """Five source rows of one group and two of the other against a target of equal groups."""
    source = [[1, 0]] * 5 + [[0, 1]] * 2
    w, h = solved(spark, rows(spark, source), rows(spark, [[0, 1], [1, 0]]), max_iter=9, tol=1e-9)
    assert np.allclose(w, [0.1] * 5 + [0.25] * 2) and len(h) == 1


def test_constraint_index():
    c = iis.Constraints({"layer3": 2, "layer4": 1}, 3)
    assert [c.decode(i) for i in (0, 5, 8)] == [("layer3", 0, 0), ("layer3", 1, 2), ("layer4", 0, 2)]
    assert all(c.encode(*c.decode(i)) == i for i in range(c.size))
    with pytest.raises(ValueError):
        c.decode(9)


def test_override_moments():
    pg = np.array([0.5, 0.5])
    assert iis.override_moments(pg, None, C1) == (pg, False)
    assert iis.override_moments(pg, np.array([0.7, 0.4]), C1)[1] and not iis.override_moments(pg, np.array([0.35, 0.65]), C1)[1]
    for bad in (np.ones(1), np.array([1.25, -0.25]), np.array([np.nan, 1.0])):
        with pytest.raises(ValueError):
            iis.override_moments(pg, bad, C1)


@pytest.mark.parametrize("mode", ["update", "oneshot"])
def test_pathological_weights(spark, mode):
    df = spark.createDataFrame([(0, 0.0), (1, -3.5), (2, 1e6), (3, 1e-9), (4, -0.0)], "sample_id int, w double")
    w = [r.w for r in weights.postprocess_weights(df, 0.4, 0.3, mode).collect()]
    assert min(w) >= 0 and np.isclose(sum(w), 1)


def test_objective_and_ema(spark):
    h = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, 0.6)], "iteration int, objective double")
    assert [r.decreased for r in iis.objective_decreased(h).orderBy("iteration").collect()] == [False, True, False]
    e = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "constraint_id int, epoch int, x double")
    assert iis.ema_moments(e, 0.0).first().moment == 3.0 and iis.ema_moments(e, 0.5).first().moment == 2.0


def test_weights_join_rejects_bad(spark):
    s = spark.createDataFrame([(1,)], "sample_id int")
    with pytest.raises(Exception, match="bad weight"):
        weights.attach_weights(s, spark.createDataFrame([(1, -0.5)], "sample_id int, w double")).select(F.sum("w")).collect()


def test_negative_entries_of_joints_are_seen(spark):
    """A negative responsibility meets a one-hot row, whose smallest class has probability 0."""
    bad = rows(spark, [(1.1, -0.1), (0.5, 0.5)], [[1.0, 0.0], [0.0, 1.0]])
    got = iis.validate_joint(bad, ["g"]).first()
    assert not got.valid and np.isclose(got.min_entry, -0.1) and np.isclose(got.max_layer_error, 0)
    assert iis.validate_joint(rows(spark, [(0.9, 0.1)], [[1.0, 0.0]]), ["g"]).first().valid
