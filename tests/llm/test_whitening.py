"""Whitening against numpy in exact and in double arithmetic."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftweight.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, k string, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "v", "k", "n", "c") for i, v in rows], SCHEMA)


def vectors(seed, n=300, d=12):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ np.diag(np.linspace(2, 0.2, d)) @ np.linalg.qr(r.normal(size=(d, d)))[0] + 0.3).astype(np.float32)


def check(rows, got, components=8):
    """By definition, from whole numbers: deviations exact, the rest in doubles."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    y = np.array([[float(Fraction(int(a) * n - int(b), n)) for a, b in zip(v, s, strict=True)] for v in x])
    values, vecs = np.linalg.eigh(y.T @ y / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows) * components
    k = range(1, components + 1)
    w = np.array([[by[i][c].whitened for c in k] for i, _ in rows])
    want = y @ vecs[:, :components] / np.sqrt(values[:components])
    assert np.abs(w - want * np.sign((w * want).sum(axis=0))).max() < 1e-9
    for (i, _), v in zip(rows, x, strict=True):
        assert by[i][1].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)) and by[i][2].n == n
    for c in k:
        assert np.isclose(by[rows[0][0]][c].explained, values[c - 1] / values.sum(), rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9


def test_whitening(spark):
    good = list(enumerate(vectors(1).tolist()))
    bad = [(900, None), (901, []), (902, [1.0] * 11), (903, [float("nan"), *[0.0] * 11]), (904, [float("inf")] * 12), (905, [None, *[1.0] * 11]), (906, [3e38] * 12)]
    out = W.whitened_components(frame(spark, [*bad[:3], *good, *bad[3:]]).repartition(5))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(good, out.collect())


def test_partitions_do_not_matter(spark):
    rows = list(enumerate(vectors(2, 200, 9).tolist()))
    a, b = (sorted(map(tuple, W.whitened_components(frame(spark, rows).repartition(p)).collect())) for p in (1, 7))
    assert [x[:4] for x in a] == [x[:4] for x in b] and np.allclose([x[4] for x in a], [x[4] for x in b], rtol=0, atol=1e-13)
    assert {x[5] for x in a} == {x[5] for x in b}  # sums are exact, so eigenvalues agree to the last bit


def test_large_offset_and_heavy_vector(spark):
    """Far from the origin with small spread, a third of all rows one vector, and clustered eigenvalues."""
    v = (np.random.default_rng(3).normal(size=(240, 10)) * 0.01).astype(np.float32) + np.float32(500)
    v[::3] = v[0]
    check(list(enumerate(v.tolist())), W.whitened_components(frame(spark, list(enumerate(v.tolist())))).collect())


def test_repeated_rows_ties_and_nothing(spark):
    v = vectors(4, 40, 3).tolist()
    rows = [(1, v[0]), (1, v[0]), (None, v[1]), *((i + 10, x) for i, x in enumerate(v[2:]))]
    out = W.whitened_components(frame(spark, rows))
    assert out.count() == 3 * 41 and out.filter("vec_id = 1").count() == 6 and out.filter("vec_id IS NULL").count() == 3
    assert W.whitened_components(frame(spark, rows).limit(0)).count() == 0
    assert W.whitened_components(frame(spark, [(1, None), (2, [])])).count() == 0
    assert W.whitened_components(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0  # no variance
    flat = W.whitened_components(frame(spark, [(i, [float(i), 5.0, 2.0 * i]) for i in range(9)]))
    assert flat.select("component").distinct().collect() == [(1,)] and flat.agg(F.max("identity_error")).first()[0] < 1e-9
    assert flat.agg(F.max("explained")).first()[0] == pytest.approx(1.0)


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [float((i % 2) * 2.0**37), float(i)]) for i in range(300)]
    got = W.whitened_components(frame(spark, rows)).filter("component = 1").collect()
    assert all(r.deviation is None for r in got) and len(got) == 300
    model = W.fit(frame(spark, rows))
    x = [[int(1024 * v[0]) + 100_000, int(1024 * v[1]) + 100_000] for _, v in rows]
    exact = [sum((300 * a - s) ** 2 for a, s in zip(v, model.sums, strict=True)) for v in x]
    assert model.deviation(np.array(x)) == exact and W.whiten(frame(spark, rows), model).orderBy("vec_id").first().deviation == exact[0]


@pytest.mark.parametrize("kind", ["spread", "clusters", "equal", "low rank", "tiny gaps"])
def test_refined_eigenvectors(kind):
    r = np.random.default_rng(5)
    values = {
        "spread": np.linspace(1, 50, 40), "clusters": np.r_[np.full(8, 9.0) + 1e-10 * np.arange(8), np.full(8, 3.0) + 1e-5 * np.arange(8), np.linspace(0.1, 1, 24)],
        "equal": np.r_[np.full(20, 2.0), np.full(20, 1.0)], "low rank": np.r_[np.zeros(35), 1, 2, 3, 4, 4 + 1e-8], "tiny gaps": 1 + 1e-13 * np.arange(40),
    }[kind]
    q = np.linalg.qr(r.normal(size=(40, 40)))[0].astype(W.HIGH)
    for _ in range(3):
        q = q + q @ (np.eye(40) - q.T @ q) / 2
    a = (q * values.astype(W.HIGH)) @ q.T
    e, x = W.eigenvectors((a + a.T) / 2)
    assert np.abs(np.sort(e) - np.sort(values)).max() < 1e-15 * values.max() * 40
    assert np.abs(a @ x - x * e).max() < 1e-15 * values.max() * 4 and np.abs(x.T @ x - np.eye(40)).max() < 1e-15
    # Plain double precision is not as good where eigenvalues lie close.
    assert (np.diff(e) <= 1e-12).all()


def test_exact_covariance():
    r = np.random.default_rng(6)
    x = r.integers(99_000, 101_000, (500, 6))
    m = np.array([round(Fraction(int(c), 500)) for c in x.sum(axis=0)], np.int64)
    v = W.covariance(500, [int(c) for c in x.sum(axis=0)], list(W._products(x - m)), m)
    exact = [[Fraction(int((500 * x[:, i] - x[:, i].sum()) @ (500 * x[:, j] - x[:, j].sum())), 500**3) for j in range(6)] for i in range(6)]
    assert all(abs(Fraction(float(v[i, j])) - exact[i][j]) <= abs(exact[i][j]) / 10**15 for i in range(6) for j in range(6))
    big = np.array([[1 << 40, 3], [-(1 << 39), 5]])
    assert W._products(big).tolist() == [int(a) * int(b) + int(c) * int(d) for a, c in big.T.tolist() for b, d in big.T.tolist()]
