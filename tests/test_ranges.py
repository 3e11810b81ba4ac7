"""Exact selection, numbering and percentiles on few distinct, heavy and missing values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftweight.operators import iis, prep, ranges, runs, select, weights


def scores(spark, distinct, rows=20_000, parts=7):
    """Ids in an order of their own; value k / distinct of each."""
    return spark.range(rows).repartition(parts).select(F.col("id").alias("sample_id"), (F.pmod(F.xxhash64("id"), F.lit(distinct)) / float(distinct)).alias("h"))


@pytest.mark.parametrize("distinct", [1, 2, 7, 50])
def test_lowest_of_few_distinct_scores(spark, monkeypatch, distinct):
    monkeypatch.setattr(ranges, "SMALL", 300)
    df = scores(spark, distinct).persist()
    rows = sorted((r.h, r.sample_id) for r in df.collect())
    for n in (1, 9_999, 10_000, 19_999, 20_000, 30_000):
        got = sorted((r.h, r.sample_id) for r in select.exact_lowest(df, "h", n).collect())
        assert got == rows[:n]
    best = sorted(((-h, i) for h, i in rows))[:777]
    assert sorted((-r.h, r.sample_id) for r in select.exact_lowest(df, "h", 777, descending=True).collect()) == best
    for k in (1, 5_000, 20_000, 50_000):
        assert select.relaxed_threshold(df, "entropy", k, "h") == rows[min(k, len(rows)) - 1][0]
        assert select.relaxed_threshold(df, "maxprob", k, "h") == rows[-min(k, len(rows))][0]
    df.unpersist()


def test_lowest_of_one_heavy_value_among_many(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SMALL", 50)
    df = spark.range(9000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 997 == 1, float("nan")).when(F.col("id") % 991 == 1, None).otherwise(F.rand(3)).alias("h")).persist()
    key = lambda r: (r.h is None or math.isnan(r.h), 0 if r.h is None or math.isnan(r.h) else r.h, r.sample_id)
    rows = sorted(df.collect(), key=key)
    for n in (10, 4000, 6000, 8985, 9000):
        assert {r.sample_id for r in select.exact_lowest(df, "h", n).collect()} == {r.sample_id for r in rows[:n]}
    df.unpersist()


def test_edges_isolate_heavy_values(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "m").otherwise(F.concat(F.lit("k"), (F.col("id") % 1700).cast("string"))).alias("v"))
    number, parts = ranges.ranged(df, "v", 20)
    heavy = [p for p in parts if p.lowest == "m"]
    assert len(heavy) == 1 and heavy[0].single and heavy[0].rows == 2500
    assert max(p.rows for p in parts if p is not heavy[0]) < 500 and sum(p.rows for p in parts) == 5000
    values = df.select("v", number.alias("n")).distinct().collect()
    assert [r.v for r in sorted(values, key=lambda r: r.v)] == [r.v for r in sorted(values, key=lambda r: (r.n, r.v))]


@pytest.mark.parametrize("kind", ["spread", "few", "one", "two heavy"])
def test_percentiles_without_sorting_all(spark, monkeypatch, kind):
    monkeypatch.setattr(ranges, "SMALL", 100)
    w = {"spread": F.rand(1), "few": F.col("id") % 5 / 7.0, "one": F.lit(0.25), "two heavy": F.when(F.col("id") % 3 == 0, 0.1).when(F.col("id") % 3 == 1, 0.9).otherwise(F.rand(2))}[kind]
    df = spark.range(6001).select(w.cast("double").alias("w")).persist()
    x = np.array([r.w for r in df.collect()])
    ps = (0.0, 0.01, 0.5, 0.9, 0.99, 1.0)
    assert np.allclose(weights.exact_percentiles(df, ps), np.quantile(x, ps), rtol=0, atol=1e-15)
    out = weights.weights_summary(df, (0.01, 0.5), exact=True)
    assert "percentile" not in out._jdf.queryExecution().toString() and np.isclose(out.first().p50, np.quantile(x, 0.5))
    df.unpersist()


def test_percentiles_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,), (4.0,)], "w double")
    assert weights.exact_percentiles(df, (0.0, 0.5, 1.0)) == [2.0, 3.0, 4.0]
    assert weights.exact_percentiles(df.limit(0), (0.5,)) == [None]
    with pytest.raises(ValueError):
        weights.exact_percentiles(df, (1.5,))


@pytest.mark.parametrize("extra", [True, False])
def test_index_of_one_value(spark, extra):
    """One path in all rows: numbered without gaps by many tasks, also if rows are equal in all columns."""
    rows = 30_000
    df = spark.range(rows).select(F.lit("p").alias("path"), *([F.col("id").alias("k")] if extra else []))
    out = prep.sample_index(df, range_rows=500)
    sizes = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert out.agg(F.countDistinct("sample_id"), F.min("sample_id"), F.max("sample_id")).first() == (rows, 0, rows - 1)
    assert out.columns == [*df.columns, "sample_id"] and len(sizes) >= 3
    assert not extra or out.select("k").distinct().count() == rows


def test_index_follows_the_order(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 600).alias("v"), "id")
    out = sorted(prep.sample_index(df, "v", "n", range_rows=200).collect(), key=lambda r: r.n)
    assert [r.n for r in out] == list(range(5000))
    seen = [-1 if r.v is None else r.v for r in out]
    assert seen == sorted(seen)


def test_missing_scores_are_never_best(spark):
    nan = float("nan")
    log = spark.createDataFrame([("a", 0, 0.4), ("a", 1, nan), ("a", 2, 0.6), ("a", 3, None), ("a", 4, 0.5), ("b", 0, nan), ("b", 1, 0.1), ("c", 0, nan)], "algorithm string, epoch int, val_acc double")
    best = {r.algorithm: (r.best_epoch, r.best_score, r.stop_epoch) for r in runs.best_epoch_early_stop(log, 2).collect()}
    assert best == {"a": (2, 0.6, 4), "b": (1, 0.1, None)}
    table = log.withColumnsRenamed({"algorithm": "method", "epoch": "row_no"})
    assert {r.method: r.val_acc for r in runs.best_by_val(table).collect()} == {"a": 0.6, "b": 0.1}
    top = select.top_weights(spark.createDataFrame([(1, nan), (2, None), (3, 0.5), (4, 0.5), (5, 0.7)], "sample_id int, w double"), 3)
    assert [r.sample_id for r in top.collect()] == [5, 3, 4]


def test_skipped_epochs_leave_the_moments(spark):
    rows = [("k", 0, 10.0), ("k", 1, None), ("k", 2, 20.0), ("n", 0, None), ("n", 1, 4.0), ("m", 0, 3.0), ("m", 1, float("nan"))]
    out = {r.constraint_id: r.moment for r in iis.ema_moments(spark.createDataFrame(rows, "constraint_id string, epoch int, x double"), 0.5).collect()}
    assert out == {"k": 15.0, "n": 4.0, "m": 3.0}
