"""Registered queries over the run-table fixture (events) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as S
from ..operators import iis, losses, prep, runs as R
from ..sources.files import shared_folder
from ..sources.snapshots import SnapshotTable
from . import fixtures as X, jobs
from .fixtures import runs_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("p10_valid_results", runs_sql("SELECT method, count(*) AS n FROM runs WHERE target_acc IS NOT NULL GROUP BY method"))
def p10(spark, d):
    return R.valid_results(X.runs(spark, d)).groupBy("method").agg(F.count("*").alias("n"))


STATS = "SELECT method, {t} AS transfer, round(avg(target_acc), 6) AS mean, round(stddev_samp(target_acc), 6) AS std, count(*) AS n FROM runs WHERE target_acc IS NOT NULL GROUP BY 1, 2"


@query("a12_transfer_stats", runs_sql(STATS.format(t="src || '->' || tgt")))
def a12(spark, d):
    return r6(R.transfer_stats(X.runs(spark, d), overall=False))


@query("a13_overall_stats", runs_sql(STATS.format(t="src || '->' || tgt") + " UNION ALL " + STATS.format(t="method || ' Avg'")))
def a13(spark, d):
    return r6(R.transfer_stats(X.runs(spark, d)))


METHODS = ["source_only", "click", "error", "purchase", "view"]


@query("a14_pivot_results", runs_sql("SELECT src || '->' || tgt AS transfer, " + ", ".join(f"round(avg(target_acc) FILTER (method = '{m}'), 6) AS {m}" for m in METHODS) + ", " + ", ".join(f"round(avg(target_acc) FILTER (method = '{m}') - avg(target_acc) FILTER (method = 'source_only'), 6) AS {m}_gain" for m in METHODS[1:]) + " FROM runs WHERE target_acc IS NOT NULL GROUP BY 1"))
def a14(spark, d):
    return r6(R.pivot_results(R.transfer_stats(X.runs(spark, d), overall=False), METHODS))


@query("a15_status_counts", runs_sql("SELECT status, count(*) AS count FROM runs GROUP BY status"))
def a15(spark, d):
    return R.status_counts(X.runs(spark, d))


@query("a15_status_summary", runs_sql("SELECT count(*) AS total, count(*) FILTER (lower(status) IN ('done', 'trained', 'resumed', 'skipped')) AS succeeded, count(*) FILTER (lower(status) LIKE 'fail%') AS failed FROM runs"))
def a15s(spark, d):
    return R.status_summary(X.runs(spark, d))


@query("j4_collect_expected_runs", runs_sql("""SELECT run_id, method, src, tgt, CASE WHEN m IS NULL THEN 'NOT RUN' WHEN m THEN 'OK' WHEN e <> '' THEN 'FAILED' WHEN c THEN 'MISSING_METRICS' WHEN st OR di THEN 'INCOMPLETE' ELSE 'NOT RUN' END AS run_status FROM ex LEFT JOIN art USING (dataset, src, tgt, method, run_id)""", """ex AS (SELECT DISTINCT dataset, src, tgt, method, run_id FROM runs),
art AS (SELECT dataset, src, tgt, method, run_id, bool_or(row_no % 5 = 0) AS m, bool_or(row_no % 3 = 0) AS st, bool_or(row_no % 11 = 0) AS c, bool_or(row_no % 2 = 0) AS di, max(CASE WHEN row_no % 13 = 0 THEN 'boom' ELSE '' END) AS e FROM runs WHERE row_no % 4 <> 1 GROUP BY ALL)"""))
def j4(spark, d):
    rows = X.runs(spark, d)
    bit = lambda k: F.bool_or(F.col("row_no") % k == 0)
    art = rows.filter("row_no % 4 <> 1").groupBy(*R.RUN_KEY).agg(bit(5).alias("has_metrics"), bit(3).alias("has_state"), bit(11).alias("completed"), bit(2).alias("dir_exists"), F.max(F.when(F.col("row_no") % 13 == 0, "boom").otherwise("")).alias("stderr_tail"))
    return R.collect_expected_runs(rows.select(*R.RUN_KEY).distinct(), art).select("run_id", "method", "src", "tgt", "run_status")


J5 = "one AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY dataset, src, tgt, seed, method ORDER BY row_no) = 1)"


@query("j5_baseline_vs_adapted", runs_sql("SELECT a.dataset, a.src, a.tgt, a.seed, a.method, a.target_acc AS adapted_target_acc, b.target_acc AS baseline_target_acc FROM one a JOIN one b USING (dataset, src, tgt, seed) WHERE b.method = 'source_only'", J5))
def j5(spark, d):
    first = X.runs(spark, d).groupBy("dataset", "src", "tgt", "seed", "method").agg(F.min_by("target_acc", "row_no").alias("target_acc"))
    return R.baseline_vs_adapted(first)


J6 = "c AS (SELECT row_no, method, src, tgt, seed, fingerprint, CASE WHEN method <> 'source_only' THEN 10 WHEN row_no % 11 = 0 THEN 10 ELSE 0 END AS ea, row_no % 2 AS amp, method <> 'source_only' OR row_no % 13 = 0 AS more FROM runs)"


@query("j6_link_source_run", runs_sql("SELECT CAST(row_no AS VARCHAR) AS run_id, s AS source_run FROM c LEFT JOIN (SELECT src, tgt, seed, fingerprint, amp, min(CAST(row_no AS VARCHAR)) AS s FROM c WHERE method = 'source_only' AND ea = 0 AND NOT more GROUP BY ALL) b USING (src, tgt, seed, fingerprint, amp) WHERE method <> 'source_only'", J6))
def j6(spark, d):
    """Baseline runs that adapted, or have settings beside amp, are linked by none."""
    i, base = F.col("row_no"), F.col("method") == "source_only"
    amp = F.create_map(F.lit("amp"), (i % 2).cast("string"))
    rows = X.runs(spark, d).withColumns({
        "run_id": i.cast("string"), "epochs_adapt": F.when(base & (i % 11 != 0), 0).otherwise(10),
        "method_params": F.when(base & (i % 13 != 0), amp).otherwise(F.map_concat(amp, F.create_map(F.lit("tau"), F.lit("0.9")))),
    })
    return R.link_source_run(rows, ["src", "tgt", "seed", "fingerprint"])


@query("j7_transfer_pairs", runs_sql("SELECT a.src, b.src AS tgt FROM (SELECT DISTINCT src FROM runs) a, (SELECT DISTINCT src FROM runs) b WHERE a.src <> b.src"))
def j7(spark, d):
    return R.transfer_pairs(X.runs(spark, d).select(F.col("src").alias("domain")))


@query("j8_param_grid", runs_sql("SELECT * FROM (SELECT DISTINCT method FROM runs), (SELECT DISTINCT seed FROM runs), (SELECT DISTINCT src FROM runs)"))
def j8(spark, d):
    rows = X.runs(spark, d)
    return R.param_grid([rows.select(c).distinct() for c in ("method", "seed", "src")])


J10 = "lo AS (SELECT run_id, min(fingerprint) AS fingerprint, bool_or(row_no % 97 = 0) AS force_rerun FROM runs GROUP BY run_id), xi AS (SELECT run_id, max(fingerprint) AS fp, bool_and(row_no % 3 <> 0) AS completed FROM runs WHERE row_no % 5 <> 2 GROUP BY run_id)"


@query("j10_plan_runs", runs_sql("SELECT run_id, CASE WHEN force_rerun THEN 'run' WHEN completed IS NULL THEN 'run' WHEN completed AND fingerprint = fp THEN 'skipped' WHEN completed THEN 'conflict' ELSE 'resume' END AS action FROM lo LEFT JOIN xi USING (run_id)", J10))
def j10(spark, d):
    rows = X.runs(spark, d)
    configs = rows.groupBy("run_id").agg(F.min("fingerprint").alias("fingerprint"), F.bool_or(F.col("row_no") % 97 == 0).alias("force_rerun"))
    existing = rows.filter("row_no % 5 <> 2").groupBy("run_id").agg(F.max("fingerprint").alias("fingerprint"), F.bool_and(F.col("row_no") % 3 != 0).alias("completed"))
    return R.plan_runs(configs, existing)


@query("w3_flag_invalid_comparisons", runs_sql("SELECT row_no, m IS NOT NULL AS invalid_comparison, m AS invalid_methods, CASE WHEN m IS NOT NULL AND status = 'OK' THEN 'INVALID_COMPARISON' ELSE status END AS status FROM runs LEFT JOIN g USING (dataset, src, tgt, seed, fingerprint)", "g AS (SELECT dataset, src, tgt, seed, fingerprint, string_agg(DISTINCT method, ',' ORDER BY method) AS m FROM runs WHERE trim(fingerprint) <> '' GROUP BY ALL HAVING count(DISTINCT method) > 1)"))
def w3(spark, d):
    return R.flag_invalid_comparisons(X.runs(spark, d)).select("row_no", "invalid_comparison", "invalid_methods", "status")


def _val_log(spark, d) -> DataFrame:
    return X.table(spark, d, "events").groupBy(F.col("event_type").alias("algorithm"), F.dayofyear("ts").alias("epoch")).agg(F.avg("value").alias("val_acc"))


for _p in (3, 0):

    @query(f"w4_best_epoch_patience_{_p}", f"""WITH v AS (SELECT event_type AS algorithm, dayofyear(ts)::INTEGER AS epoch, avg(value) AS val_acc FROM events GROUP BY ALL),
a AS (SELECT *, val_acc > coalesce(max(val_acc) OVER (PARTITION BY algorithm ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS rise FROM v),
b AS (SELECT *, max(CASE WHEN rise THEN epoch END) OVER (PARTITION BY algorithm ORDER BY epoch) AS last FROM a),
c AS (SELECT *, min(CASE WHEN {_p} > 0 AND epoch - last >= {_p} THEN epoch END) OVER (PARTITION BY algorithm) AS stop FROM b)
SELECT algorithm, max(epoch) AS best_epoch, round(arg_max(val_acc, epoch), 6) AS best_score, max(stop) AS stop_epoch FROM c WHERE rise AND (stop IS NULL OR epoch <= stop) GROUP BY algorithm""")
    def w4(spark, d, p=_p):
        return r6(R.best_epoch_early_stop(_val_log(spark, d), p))


@query("w7_best_by_val", runs_sql("SELECT method, row_no, round(val_acc, 6) AS val_acc, target_acc FROM runs QUALIFY row_number() OVER (PARTITION BY upper(method) ORDER BY val_acc DESC, row_no) = 1"))
def w7(spark, d):
    return r6(R.best_by_val(X.runs(spark, d)).select("method", "row_no", "val_acc", "target_acc"))


UPDATES = "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS no, (event_id % 10)::INTEGER AS epoch, CASE WHEN event_id % 3 = 0 THEN 'skipped_low_confidence' ELSE 'updated' END AS status, CASE WHEN event_id % 7 <> 0 THEN value END AS ess, event_id % 4 <> 0 AS has FROM events"


def _updates(spark, d) -> DataFrame:
    e, i = X.table(spark, d, "events"), F.col("event_id")
    record = F.struct(
        "ts", "event_id", (i % 10).cast("int").alias("epoch"), F.when(i % 3 == 0, "skipped_low_confidence").otherwise("updated").alias("status"), F.when(i % 7 != 0, F.col("value")).alias("ess"),
        F.when(i % 4 != 0, F.array(F.col("value"))).otherwise(F.expr("cast(array() as array<double>)")).alias("iis_objective"),
    )
    return e.groupBy(F.col("user_id").alias("run_id")).agg(F.array_sort(F.collect_list(record)).alias("weight_updates"))


@query("w8_latest_update", f"SELECT user_id AS run_id, max(no) AS no, arg_max(epoch, no) AS epoch, arg_max(coalesce(ess, -1), no) AS ess FROM ({UPDATES}) WHERE status = 'updated' AND has GROUP BY user_id")
def w8(spark, d):
    return R.latest_update(_updates(spark, d)).withColumn("ess", F.coalesce("ess", F.lit(-1.0)))


@query("w9_ess_series", f"SELECT user_id AS run_id, (row_number() OVER (PARTITION BY user_id ORDER BY no) - 1)::INTEGER AS step, epoch, ess FROM ({UPDATES}) WHERE status = 'updated' AND ess IS NOT NULL")
def w9(spark, d):
    return R.ess_series(_updates(spark, d))


X3 = """o AS (SELECT row_no, CASE row_no % 5 WHEN 0 THEN ' ' || run_id WHEN 1 THEN '' ELSE run_id END AS run_id, 0 AS n FROM runs),
k AS (SELECT *, CASE WHEN trim(run_id) = '' THEN substr(sha1('{"n":"0","run_id":"' || run_id || '"}'), 1, 10) ELSE run_id END AS key FROM o UNION ALL SELECT max(row_no), run_id, 1, run_id FROM runs WHERE row_no % 10 = 3 GROUP BY run_id)"""


@query("x3_upsert_rows", runs_sql("SELECT arg_max(key, (n, row_no)) AS run_id, max(n) AS n, arg_max(row_no, (n, row_no)) AS row_no FROM k GROUP BY trim(key)", X3))
def x3(spark, d):
    """Keys with space before them, and rows without key, which are one row as their content is the same."""
    i = F.col("row_no") % 5
    rows = X.runs(spark, d).select(F.when(i == 0, F.concat(F.lit(" "), "run_id")).when(i == 1, "").otherwise(F.col("run_id")).alias("run_id"), "row_no", F.lit(0).alias("n"))
    new = X.runs(spark, d).filter("row_no % 10 = 3").groupBy("run_id").agg(F.max("row_no").alias("row_no"), F.lit(1).alias("n"))
    return R.upsert_rows(rows, new)


@query("x3_upsert_rows_without_key", "SELECT substr(sha1('{\"score\":\"' || CAST(user_id % 50 AS VARCHAR) || '\",\"type\":\"' || event_type || '\"}'), 1, 10) AS run_id, CAST(user_id % 50 AS VARCHAR) AS score, event_type AS type, max(event_id) AS row_no FROM events GROUP BY ALL UNION ALL SELECT 'new', '7', 'é', 0")
def x3k(spark, d):
    """A table without key column: equal rows become one, under a hash of their content."""
    rows = X.table(spark, d, "events").select((F.col("user_id") % 50).cast("string").alias("score"), F.col("event_type").alias("type"), F.col("event_id").alias("row_no"))
    return R.upsert_rows(rows, spark.createDataFrame([("new", "7", "é", 0)], "run_id string, score string, type string, row_no bigint"))


@query("a5_epoch_averages", "SELECT event_type AS method, (event_id % 10)::INTEGER AS epoch, round(sum(value * (1 + event_id % 32)) / sum(1 + event_id % 32), 6) AS loss, round(sum((event_id % 100) * (1 + event_id % 32)) FILTER (event_id % 8 <> 0) / sum(1 + event_id % 32) FILTER (event_id % 8 <> 0), 6) AS acc FROM events GROUP BY ALL")
def a5(spark, d):
    i = F.col("event_id")
    log = X.table(spark, d, "events").select(F.col("event_type").alias("method"), (i % 10).cast("int").alias("epoch"), F.col("value").alias("loss"), (i % 100).cast("double").alias("acc"), (1 + i % 32).alias("batch_size"), (i % 8 == 0).alias("pseudo"))
    return r6(losses.epoch_averages(log, ["method", "epoch"], F.col("pseudo")))


@query("a17_fairness_check", "SELECT event_type AS method, count(DISTINCT (event_id % 2, k)) AS n_settings, count(DISTINCT (event_id % 2, k)) > 1 AND NOT bool_or(event_id % 500 = 3 AND event_type <> 'click') AS unfair FROM (SELECT *, CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 3 END AS k FROM events) GROUP BY event_type")
def a17(spark, d):
    i, kind = F.col("event_id"), F.col("event_type")
    fixed = {c: F.lit(1) for c in R.FAIRNESS}
    e = X.table(spark, d, "events").withColumns({**fixed, "epochs": i % 2, "grad_accum_steps": F.when(kind == "view", 0).otherwise(i % 3), "paper_match": (i % 500 == 3) & (kind != "click")})
    return R.fairness_check(e.withColumn("method", kind), ["method"])


@query("p6_validate_protocol", """WITH c AS (SELECT event_id, coalesce(['uda_target', 'align_val', 'other', NULL][event_id % 4 + 1], 'uda_target') AS m, coalesce([NULL, 'val_unlabeled', 'test_unlabeled', 'train_unlabeled', 'Test_unlabeled'][event_id % 5 + 1], 'test_unlabeled') AS a, coalesce(['val', 'test', 'id_val', NULL, 'train', 'VAL', 'test'][event_id % 7 + 1], 'test') AS e FROM events)
SELECT event_id, CASE WHEN m NOT IN ('uda_target', 'align_val') THEN 'unknown split_mode' WHEN e NOT IN ('val', 'test') THEN 'unknown eval_split' WHEN a NOT IN ('val_unlabeled', 'test_unlabeled') THEN 'unknown adapt_split'
WHEN m = 'align_val' THEN CASE WHEN a = 'test_unlabeled' THEN 'align_val adapts on val_unlabeled' WHEN e = 'test' THEN 'align_val evaluates on val' END WHEN a = 'val_unlabeled' THEN 'uda_target adapts on test_unlabeled' END AS violation FROM c""")
def p6(spark, d):
    """All of 140 combinations; null settings have defaults."""
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names)).cast("int"))
    c = X.table(spark, d, "events").select(
        "event_id", pick("uda_target", "align_val", "other", None).alias("split_mode"), pick(None, "val_unlabeled", "test_unlabeled", "train_unlabeled", "Test_unlabeled").alias("adapt_split"),
        pick("val", "test", "id_val", None, "train", "VAL", "test").alias("eval_split"),
    )
    return c.select("event_id", prep.protocol_violation().alias("violation"))


@query("p2_dataset_tag", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'office-home' WHEN 1 THEN 'office-31' WHEN 2 THEN 'office-home' ELSE event_type END AS tag FROM events")
def p2(spark, d):
    i = F.col("event_id") % 4
    raw = F.when(i == 0, "Office_Home").when(i == 1, "office 31").when(i == 2, "OFFICE-HOME").otherwise(F.upper("event_type"))
    return X.table(spark, d, "events").select("event_id", S.dataset_tag(raw).alias("tag"))


@query("p1_normalize_domain_code", "SELECT event_id, ['Ar', NULL, 'Ar', 'Rw', 'Rw', 'Rw', 'Cl', 'Pr', NULL, NULL, NULL][event_id % 11 + 1] AS code, CASE event_id % 11 WHEN 10 THEN 'A' END AS code_31 FROM events")
def p1(spark, d):
    """Codes only as they stand; hyphens matter, case, spaces and underscores of names do not."""
    raw = F.get(F.array(*map(F.lit, ["Ar", "ar", "art", "Real World", "real_world", "REAL", "CLIPART", "Product", "a-rt", "Sketch", "A"])), (F.col("event_id") % 11).cast("int"))
    codes = S.normalize_domain_code(raw, strict=False), S.normalize_domain_code(raw, S.OFFICE_31, strict=False)
    return X.table(spark, d, "events").select("event_id", codes[0].alias("code"), codes[1].alias("code_31"))


@query("f15_decode_run_id", "SELECT event_id, event_type AS algorithm, CAST(event_id % 3 AS VARCHAR) AS seed, 'uda' AS split_mode, 'test' AS eval_split, '1' AS step, 'a=b' AS other FROM events")
def f15(spark, d):
    m = S.decode_run_id(F.concat(F.lit("split=uda__eval=test__alg="), F.col("event_type"), F.lit("__seed="), (F.col("event_id") % 3).cast("string"), F.lit("__iis=1__junk__xx=a=b")))
    names = {"algorithm": "algorithm", "seed": "seed", "split_mode": "split_mode", "eval_split": "eval_split", "meiis_step": "step", "xx": "other"}
    return X.table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", *[F.col("m")[k].alias(v) for k, v in names.items()])


@query("f16_make_ckpt_name", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'me_iis' ELSE event_type END || '__office-home__Ar2Cl__seed' || CAST(event_id % 3 AS VARCHAR) || '__Esrc50__Ead10__bs32' || CASE WHEN event_id % 2 = 0 THEN '__layersl3-l4__gmm2-' || CASE WHEN event_id % 5 = 0 THEN '8' ELSE CAST(event_id % 5 AS VARCHAR) END || '__iis15-0.001' ELSE '' END || '.pt' AS name FROM events")
def f16m(spark, d):
    i = F.col("event_id")
    adapted = {"layers": F.lit("l3, l4,"), "gmm_max": F.when(i % 5 != 0, i % 5)}
    return X.table(spark, d, "events").select("event_id", S.make_ckpt_name(F.when(i % 2 == 0, "me_iis").otherwise(F.col("event_type")), F.lit("office-home"), F.lit("Ar"), F.lit("Cl"), i % 3, F.lit(50), F.lit(10), F.lit(32), adapted).alias("name"))


@query("f16_decode_ckpt_name", """SELECT event_id, CASE WHEN k IN (1, 2) THEN event_type END AS method, CASE WHEN k IN (1, 2) THEN (event_id % 3)::INTEGER END AS seed, CASE WHEN k IN (1, 2) THEN 'Cl2' END AS tgt, CASE WHEN k IN (1, 2) THEN '10' END AS epochs_adapt, CASE WHEN k IN (1, 2) THEN 'l3-l4' END AS layers, CASE k WHEN 1 THEN 2 END AS gmm_min,
CASE WHEN k IN (1, 2) THEN 8 END AS gmm_max, CASE WHEN k IN (1, 2) THEN 15 END AS iis_iters, CASE WHEN k IN (1, 2) THEN 0.001::DOUBLE END AS iis_tol, CASE WHEN k <> 1 THEN 'unable to decode' END AS error FROM (SELECT *, event_id % 5 AS k FROM events)""")
def f16(spark, d):
    """A whole name, a number of components that is none, no pair, no seed, and another file."""
    i, k = F.col("event_id"), F.col("event_id") % 5
    seed = F.when(k == 4, "x").otherwise((i % 3).cast("string"))
    name = F.concat(F.lit("runs/"), F.col("event_type"), F.lit("__office-home__"), F.when(k == 3, "ArCl").otherwise("Ar2Cl2"), F.lit("__seed"), seed, F.lit("__Esrc50__Ead10__bs32__layersl3-l4__gmm"), F.when(k == 2, "x").otherwise("2"), F.lit("-8__iis15-0.001.pt"))
    rows = X.table(spark, d, "events").select("event_id", S.decode_ckpt_name(F.when(k == 0, "model.bin").otherwise(name)).alias("c"))
    return rows.select("event_id", *[f"c.{c}" for c in ("method", "seed", "tgt", "epochs_adapt", "layers", "gmm_min", "gmm_max", "iis_iters", "iis_tol", "error")])


@query("f17_components_map", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 7 END::INTEGER AS l3, CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 5 ELSE 8 END::INTEGER AS l4 FROM events")
def f17(spark, d):
    over = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "l3:10").otherwise("7, 8")
    m = S.components_map(S.parse_layers(F.lit("l3, l4,")), 5, over)
    return X.table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["l3"].alias("l3"), F.col("m")["l4"].alias("l4"))


@query("f18_transfer_label", runs_sql("SELECT row_no, coalesce(CASE WHEN row_no % 9 <> 0 THEN src END, '?') || '->' || tgt AS label FROM runs"))
def f18(spark, d):
    return X.runs(spark, d).select("row_no", S.transfer_label(F.when(F.col("row_no") % 9 != 0, F.col("src")), F.col("tgt")).alias("label"))


@query("f20_metrics_row", runs_sql("SELECT run_id, method, seed, round(target_acc / 3, 6) AS target_acc, CAST(NULL AS VARCHAR) AS git_sha FROM runs"))
def f20(spark, d):
    return R.metrics_row(X.runs(spark, d).withColumn("target_acc", F.col("target_acc") / 3)).select("run_id", "method", "seed", "target_acc", "git_sha")


@query("f13_run_hash", """SELECT event_id, substr(sha1('{"k":' || regexp_extract(props, '[0-9]+') || '}'), 1, 10) AS hash FROM events""")
def f13(spark, d):
    return X.table(spark, d, "events").select("event_id", S.run_hash(F.col("props")).alias("hash"))


F14 = """WITH c AS (SELECT event_id, event_type, event_id % 3 AS seed, value, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS pt, CASE WHEN value >= 1 AND value = floor(value) THEN CAST(value::BIGINT AS VARCHAR) || '.0' ELSE CAST(value AS VARCHAR) END AS lr FROM events)
SELECT event_id, 'ds=office-home__split=uda_target__eval=test__alg=' || event_type || '-v-2__seed=' || seed || '__pt=' || CASE pt WHEN 'true' THEN 1 ELSE 0 END || '__lr=' || printf('%.6g', value) || '__wd=0__K=5__h='
 || substr(sha1('{"algorithm":" ' || event_type || ' (v) 2 ","dataset":"office-home","eval_split":"test","lr":' || lr || ',"meiis_K":5,"pretrained":' || pt || ',"seed":' || seed || ',"split_mode":"uda_target","weight_decay":0.0}'), 1, 8) AS run_id FROM c"""


@query("f14_encode_run_id", F14)
def f14(spark, d):
    i = F.col("event_id")
    parts = {"dataset": F.lit("office-home"), "algorithm": F.concat(F.lit(" "), "event_type", F.lit(" (v) 2 ")), "seed": i % 3, "lr": F.col("value"), "weight_decay": F.lit(0.0), "pretrained": i % 2 == 0, "eval_split": F.lit("test"), "split_mode": F.lit("uda_target"), "meiis_K": F.lit(5)}
    doc = F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]))
    return X.table(spark, d, "events").select("event_id", S.encode_run_id(doc).alias("run_id"))


@query("experiment_tables", runs_sql("""SELECT 'status' AS name, status AS key, count(*)::DOUBLE AS x FROM ex GROUP BY status UNION ALL SELECT 'stats', method || ' ' || src || '->' || tgt, round(avg(target_acc), 6) FROM ex WHERE target_acc IS NOT NULL GROUP BY method, src, tgt
UNION ALL SELECT 'stats', method || ' ' || method || ' Avg', round(avg(target_acc), 6) FROM ex WHERE target_acc IS NOT NULL GROUP BY method UNION ALL SELECT 'best', method, max(val_acc) FROM ex WHERE val_acc IS NOT NULL GROUP BY method""", """e0 AS (SELECT dataset, src, tgt, method, run_id, min(seed) AS seed, max(fingerprint) AS fingerprint, max(round(target_acc, 3)) AS ta, max(round(val_acc, 3)) AS va FROM runs GROUP BY ALL),
e1 AS (SELECT *, CASE WHEN hash_no THEN ta END AS target_acc, CASE WHEN hash_no THEN va END AS val_acc, CASE WHEN hash_no THEN 'OK' ELSE 'NOT RUN' END AS run_status FROM (SELECT *, CAST(run_id AS INTEGER) % 3 <> 0 AS hash_no FROM e0)),
g AS (SELECT dataset, src, tgt, seed, fingerprint FROM e1 WHERE trim(fingerprint) <> '' GROUP BY ALL HAVING count(DISTINCT method) > 1),
ex AS (SELECT e1.*, CASE WHEN g.src IS NOT NULL AND run_status = 'OK' THEN 'INVALID_COMPARISON' ELSE run_status END AS status FROM e1 LEFT JOIN g USING (dataset, src, tgt, seed, fingerprint))"""))
def experiment_tables(spark, d):
    """Counts by status, means and best scores of the experiment tables; two thirds of the expected runs have metrics."""
    rows = X.runs(spark, d).groupBy(*R.RUN_KEY).agg(F.min("seed").alias("seed"), F.max("fingerprint").alias("fingerprint"), F.max(F.round("target_acc", 3)).alias("target_acc"), F.max(F.round("val_acc", 3)).alias("val_acc"))
    found = rows.filter(F.col("run_id").cast("int") % 3 != 0).select(*R.RUN_KEY, "target_acc", "val_acc", *[F.lit(v).alias(c) for c, v in (("has_metrics", True), ("completed", True), ("has_state", True), ("dir_exists", True), ("stderr_tail", ""))])
    t = jobs.experiment_tables(rows.select(*R.RUN_KEY, "seed", "fingerprint"), found, METHODS)
    row = lambda df, name, key, x: df.select(F.lit(name).alias("name"), key.alias("key"), F.round(x.cast("double"), 6).alias("x"))
    return row(t["status"], "status", F.col("status"), F.col("count")).unionByName(row(t["stats"], "stats", F.concat_ws(" ", "method", "transfer"), F.col("mean"))).unionByName(row(t["best"], "best", F.col("method"), F.col("val_acc")))


@query("x3_snapshot_upsert", runs_sql("SELECT arg_max(key, (n, row_no)) AS run_id, max(n) AS n, arg_max(row_no, (n, row_no)) AS row_no FROM k GROUP BY trim(key)", "k AS (SELECT CASE WHEN row_no % 5 = 0 THEN ' ' || run_id ELSE run_id END AS key, row_no, 0 AS n FROM runs UNION ALL SELECT run_id, max(row_no), 1 FROM runs WHERE row_no % 10 = 3 GROUP BY run_id)"))
def x3s(spark, d):
    """A stored table: all runs are put in, then new results of some; the second upsert writes the buckets of these."""
    table = SnapshotTable(spark, shared_folder(spark), buckets=16)
    key = F.when(F.col("row_no") % 5 == 0, F.concat(F.lit(" "), "run_id")).otherwise(F.col("run_id"))
    table.upsert(X.runs(spark, d).select(key.alias("run_id"), "row_no", F.lit(0).alias("n")))
    table.upsert(X.runs(spark, d).filter("row_no % 10 = 3").groupBy("run_id").agg(F.max("row_no").alias("row_no"), F.lit(1).alias("n")))
    return table.read()


#: Days without a score, and days on which it is NaN.
GAPS = "lg AS (SELECT algorithm, epoch, CASE WHEN epoch NOT IN (2, 11) THEN v END AS v FROM (SELECT event_type AS algorithm, (event_id % 30)::INTEGER AS epoch, avg(value) AS v FROM events GROUP BY ALL))"


@query("w4_best_epoch_missing_scores", f"WITH {GAPS}, m AS (SELECT *, v > coalesce(max(v) OVER (PARTITION BY algorithm ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) AS rise FROM lg) SELECT algorithm, max(epoch) AS best_epoch, round(arg_max(v, epoch), 6) AS best_score, NULL::INTEGER AS stop_epoch FROM m WHERE rise GROUP BY algorithm")
def w4m(spark, d):
    """A NaN score (epoch 2) and a missing one (epoch 11) are never the best."""
    e = X.table(spark, d, "events").groupBy(F.col("event_type").alias("algorithm"), (F.col("event_id") % 30).cast("int").alias("epoch")).agg(F.avg("value").alias("val_acc"))
    gaps = e.withColumn("val_acc", F.when(F.col("epoch") == 2, F.lit(float("nan"))).when(F.col("epoch") == 11, F.lit(None)).otherwise(F.col("val_acc")))
    return r6(R.best_epoch_early_stop(gaps, 0))


@query("w7_best_by_val_missing_scores", runs_sql("SELECT method, run_id, row_no, round(val_acc, 6) AS val_acc FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY val_acc DESC, row_no) AS r FROM runs WHERE row_no % 3 = 0) WHERE r = 1"))
def w7m(spark, d):
    rows = X.runs(spark, d).select("method", "run_id", "row_no", F.when(F.col("row_no") % 3 == 1, F.lit(float("nan"))).when(F.col("row_no") % 3 == 0, F.col("val_acc")).alias("val_acc"))
    return r6(R.best_by_val(rows))


@query("w5_objective_decreased_series", "WITH h AS (SELECT event_type AS method, (event_id % 40)::INTEGER AS iteration, avg(value) AS o FROM events GROUP BY ALL) SELECT method, iteration, coalesce(o + 1e-8 < coalesce(lag(o) OVER (PARTITION BY method ORDER BY iteration), -ln(1000)), false) AS decreased FROM h")
def w5s(spark, d):
    """A history for each method that rises and falls; the first value is compared with -ln 1000."""
    h = X.table(spark, d, "events").groupBy(F.col("event_type").alias("method"), (F.col("event_id") % 40).cast("int").alias("iteration")).agg(F.avg("value").alias("objective"))
    return iis.objective_decreased(h, n_source=1000, by=["method"]).select("method", "iteration", "decreased")
