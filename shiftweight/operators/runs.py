"""Tables of experiment runs: collection, pairing, statistics, best runs, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import run_status, transfer_label
from ..sources.files import METRICS_SCHEMA
from .evaluate import PRIMARY

RUN_KEY = ["dataset", "src", "tgt", "method", "run_id"]
# The columns that comparable runs must share.
FAIRNESS = ["backbone", "pretrained", "augment", "color_jitter", "imagenet_normalize", "epochs", "batch_size", "grad_accum_steps"]
DONE = ["done", "trained", "resumed", "skipped"]


def valid_results(runs: DataFrame, score: str = "target_acc") -> DataFrame:
    return runs.filter(F.col(score).isNotNull() & ~F.isnan(score))


def transfer_pairs(domains: DataFrame, name: str = "domain") -> DataFrame:
    """(src, tgt) for all ordered pairs of different domains."""
    d = domains.select(name).distinct()
    return d.select(F.col(name).alias("src")).join(d.select(F.col(name).alias("tgt")), F.col("src") != F.col("tgt"))


#: Values of one axis of a grid; more are an error.
AXIS_VALUES = 10_000


def param_grid(axes: list[DataFrame]) -> DataFrame:
    """Product of one-column frames. Each axis is broadcast, so one with more than ``AXIS_VALUES`` rows is an error."""
    out = axes[0]
    for axis in axes[1:]:
        if axis.limit(AXIS_VALUES + 1).count() > AXIS_VALUES:
            raise ValueError(f"the axis {axis.columns} has more than {AXIS_VALUES} values")
        out = out.crossJoin(F.broadcast(axis))
    return out


def collect_expected_runs(expected: DataFrame, artifacts: DataFrame, key: list[str] = RUN_KEY) -> DataFrame:
    """Expected configurations with what was found for exactly their key, and a status. Stale runs do not appear."""
    found = expected.join(artifacts, key, "left")
    return found.withColumn("run_status", run_status(*[F.col(c) for c in ("has_metrics", "completed", "has_state", "dir_exists", "stderr_tail")]))


def baseline_vs_adapted(runs: DataFrame, baseline: str = "source_only") -> DataFrame:
    """(dataset, src, tgt, seed, method, baseline_target_acc, adapted_target_acc), the baseline against itself too."""
    key = ["dataset", "src", "tgt", "seed"]
    base = runs.filter(F.col("method") == baseline).select(*key, F.col("target_acc").alias("baseline_target_acc"))
    return runs.select(*key, "method", F.col("target_acc").alias("adapted_target_acc")).join(base, key)


def derive_source_config(configs: DataFrame, baseline: str = "source_only", shared: tuple[str, ...] = ("amp",)) -> DataFrame:
    """The baseline configuration that each configuration builds on.

    ``method`` becomes the baseline, ``epochs_adapt`` 0, and of the map ``method_params`` only the ``shared`` settings stay.
    """
    params = F.map_filter(F.coalesce("method_params", F.expr("map()").cast("map<string,string>")), lambda k, v: k.isin(*shared))
    return configs.withColumns({"method": F.lit(baseline), "epochs_adapt": F.lit(0), "method_params": params})


def link_source_run(runs: DataFrame, key: list[str], baseline: str = "source_only", id_col: str = "run_id") -> DataFrame:
    """(run, source_run): the baseline run whose configuration is the one that a run derives; null where it is missing.

    ``key`` are the settings that both share beside ``method``, ``epochs_adapt`` and ``method_params``, whose rules are
    those of ``derive_source_config``; a baseline run with other adaptation settings is not linked.
    """
    settings = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params"))))
    one = lambda df: df.withColumn("params", F.coalesce("method_params", F.expr("map()").cast("map<string,string>"))).select(id_col, *key, F.col("epochs_adapt").cast("long").alias("ea"), settings.alias("mp"))
    base = one(runs.filter(F.col("method") == baseline)).groupBy(*key, "ea", "mp").agg(F.min(id_col).alias("source_run"))
    wanted = one(derive_source_config(runs.filter(F.col("method") != baseline)))
    return wanted.join(base, [*key, "ea", "mp"], "left").select(id_col, "source_run")


def plan_runs(configs: DataFrame, existing: DataFrame, key: str = "run_id") -> DataFrame:
    """Action per configuration: run, skipped, resume, or conflict (completed under another fingerprint)."""
    old = existing.select(key, F.col("fingerprint").alias("old_fingerprint"), "completed")
    both = configs.join(old, key, "left")
    same = F.col("fingerprint").eqNullSafe(F.col("old_fingerprint"))
    action = (
        F.when(F.coalesce(F.col("force_rerun"), F.lit(False)), "run").when(F.col("completed").isNull(), "run")
        .when(F.col("completed") & same, "skipped").when(F.col("completed"), "conflict").otherwise("resume")
    )
    return both.select(key, action.alias("action"))


def transfer_stats(runs: DataFrame, overall: bool = True) -> DataFrame:
    """(method, transfer, mean, std, n), and per method over all rows as transfer ``<method> Avg``. One row: std null."""
    rows = valid_results(runs).withColumn("transfer", transfer_label(F.col("src"), F.col("tgt")))
    stats = [F.avg("target_acc").alias("mean"), F.stddev_samp("target_acc").alias("std"), F.count("*").alias("n")]
    if not overall:
        return rows.groupBy("method", "transfer").agg(*stats)
    sets = rows.groupingSets([["method", "transfer"], ["method"]], "method", "transfer").agg(*stats, F.grouping("transfer").alias("g"))
    return sets.withColumn("transfer", F.when(F.col("g") == 1, F.concat("method", F.lit(" Avg"))).otherwise(F.col("transfer"))).drop("g")


def pivot_results(stats: DataFrame, methods: list[str], baseline: str = "source_only") -> DataFrame:
    """One row per transfer, a column of means per method, and the gain of each over the baseline."""
    wide = stats.groupBy("transfer").pivot("method", methods).agg(F.first("mean"))
    return wide.withColumns({f"{m}_gain": F.col(m) - F.col(baseline) for m in methods if m != baseline})


def status_counts(runs: DataFrame, status: str = "status") -> DataFrame:
    return runs.groupBy(F.col(status).alias("status")).count()


def status_summary(runs: DataFrame, status: str = "status") -> DataFrame:
    s = F.lower(status)
    return runs.agg(F.count("*").alias("total"), F.count_if(s.isin(*DONE)).alias("succeeded"), F.count_if(s.startswith("fail")).alias("failed"))


def fairness_check(configs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """([by,] n_settings, unfair): more than one combination of settings, unless a run matches the paper on purpose."""
    n = F.countDistinct(F.struct(*FAIRNESS))
    return configs.groupBy(*(by or [])).agg(n.alias("n_settings"), ((n > 1) & ~F.coalesce(F.bool_or("paper_match"), F.lit(False))).alias("unfair"))


def flag_invalid_comparisons(runs: DataFrame, by: tuple[str, ...] = ("dataset", "src", "tgt", "seed", "fingerprint")) -> DataFrame:
    """Mark runs of different methods with one fingerprint: they did the same work. Blank fingerprints are left out.

    Rows with a blank fingerprint never enter the grouping (they would be one hot key); methods are few per group,
    so the sets are pre-aggregated and joined back.
    """
    blank = F.trim(F.coalesce(F.col("fingerprint"), F.lit(""))) == ""
    groups = runs.filter(~blank).groupBy(*by).agg(F.array_sort(F.collect_set("method")).alias("m")).filter(F.size("m") > 1)
    out = runs.join(groups, list(by), "left")
    invalid = F.col("m").isNotNull()
    return out.withColumns({
        "invalid_comparison": invalid, "invalid_methods": F.array_join("m", ","),
        "status": F.when(invalid & (F.col("status") == "OK"), "INVALID_COMPARISON").otherwise(F.col("status")),
    }).drop("m")


def best_epoch_early_stop(log: DataFrame, patience: int, by: str = "algorithm", epoch: str = "epoch", score: str = "val_acc") -> DataFrame:
    """(algorithm, best_epoch, best_score, stop_epoch): best is the last strict rise of the running maximum until the stop.

    Training stops at the first epoch that is ``patience`` after the last rise; patience of 0 or less never stops.
    A null or NaN score is no rise and does not count towards the maximum.
    """
    known = F.when(~F.isnan(score), F.col(score))
    past = Window.partitionBy(by).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(by).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("rise", F.coalesce(known > F.coalesce(F.max(known).over(past), F.lit(float("-inf"))), F.lit(False)))
    rows = rows.withColumn("last_rise", F.max(F.when(F.col("rise"), F.col(epoch))).over(upto))
    if patience > 0:
        rows = rows.withColumn("stop", F.min(F.when(F.col(epoch) - F.col("last_rise") >= patience, F.col(epoch))).over(Window.partitionBy(by)))
    else:
        rows = rows.withColumn("stop", F.lit(None).cast("int"))
    seen = rows.filter(F.col("stop").isNull() | (F.col(epoch) <= F.col("stop"))).filter("rise")
    return seen.groupBy(by).agg(F.max_by(epoch, epoch).alias("best_epoch"), F.max_by(score, epoch).alias("best_score"), F.max("stop").alias("stop_epoch"))


def best_by_val(runs: DataFrame, order: str = "row_no", score: str = "val_acc", algorithm: str = "method") -> DataFrame:
    """The run with the highest validation score per algorithm (case does not matter); the first one on ties.

    Runs whose score is null or NaN are never the best; an algorithm with no other runs is missing.
    """
    w = Window.partitionBy(F.upper(algorithm)).orderBy(F.col(score).desc(), F.col(order))
    return valid_results(runs, score).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def selection_score(metrics: Column) -> Column:
    """(score, key) of a map of metrics: the first of the keys ``evaluate.PRIMARY`` whose value is a number; null without one."""
    tries = [(metrics[k].try_cast("double"), F.lit(k)) for k in PRIMARY]
    return F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("score"), k.alias("key"))) for v, k in tries])


def best_selected(runs: DataFrame, split: str = "val", order: str = "row_no", algorithm: str = "method", metrics: str = "metrics") -> DataFrame:
    """``best_by_val`` of runs whose ``metrics`` map splits to maps of metrics: with val_score, val_metric_key and test_score.

    Runs without a score on ``split`` are skipped; the test score may be missing.
    """
    chosen, test = selection_score(F.col(metrics)[split]), selection_score(F.col(metrics)["test"])
    scored = runs.withColumns({"val_score": chosen["score"], "val_metric_key": chosen["key"], "test_score": test["score"]})
    return best_by_val(scored, order, "val_score", algorithm)


def updates_long(results: DataFrame, by: str = "run_id", updates: str = "weight_updates") -> DataFrame:
    return results.select(by, F.posexplode(updates).alias("no", "u")).select(by, "no", "u.*")


def latest_update(results: DataFrame, by: str = "run_id") -> DataFrame:
    """The last update record with status ``updated`` and an objective."""
    rows = updates_long(results, by).filter((F.col("status") == "updated") & (F.size("iis_objective") > 0))
    return rows.groupBy(by).agg(F.max_by(F.struct("no", "epoch", "ess"), "no").alias("u")).select(by, "u.*")


def ess_series(results: DataFrame, by: str = "run_id") -> DataFrame:
    """(run, step, epoch, ess) of successful updates that have an effective sample size, numbered from 0."""
    rows = updates_long(results, by).filter((F.col("status") == "updated") & F.col("ess").isNotNull())
    return rows.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("no")) - 1).alias("step"), "epoch", "ess")


def content_key(df: DataFrame, columns: list[str]) -> Column:
    """First ten hex digits of the SHA-1 of a row as JSON: texts, sorted names, no spaces, nulls as empty texts."""
    row = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns) if c in df.columns]))
    return F.left(F.sha1(row.cast("binary")), F.lit(10))


def bare_key(key: Column) -> Column:
    """A key as keys are compared: as text, without the space around it, null as the empty text."""
    return F.regexp_replace(F.coalesce(key.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def upsert_rows(existing: DataFrame, new: DataFrame, key: str = "run_id", order: str = "row_no") -> DataFrame:
    """At most one row per key: the last existing one, replaced by a new one.

    Keys are compared without the space around them and stay as they stand. Existing rows without key, or all if there is
    no such column, get a hash of their content (``content_key``). New rows must have a key. Columns are those of the
    new side (the key first where it lacks), then the others; ``order`` says which row is last, new rows come behind.
    """
    content = [c for c in existing.columns if c != order]
    made = content_key(existing, content)
    old = existing.withColumn(key, F.when(bare_key(F.col(key)) == "", made).otherwise(F.col(key)) if key in existing.columns else made)
    if key not in new.columns:
        raise ValueError(f"new rows have no column {key}")
    fresh = new.withColumn(key, F.when(bare_key(F.col(key)) == "", F.raise_error(F.lit("new row without key")).cast("string")).otherwise(F.col(key)))
    both = old.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(bare_key(F.col(key))).orderBy(F.col("_new").desc(), F.col(order).desc())
    kept = both.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return kept.select(*new.columns, *[c for c in old.columns if c not in new.columns])


def metrics_row(run: DataFrame) -> DataFrame:
    """The metrics columns of runs, accuracies rounded to six digits, missing settings as null."""
    fields = [f.strip().split(" ")[0] for f in METRICS_SCHEMA.split(",")]
    pick = lambda c: F.round(F.col(c), 6).alias(c) if c.endswith("_acc") and c in run.columns else F.col(c) if c in run.columns else F.lit(None).cast("string").alias(c)
    return run.select(*[pick(c) for c in fields])
