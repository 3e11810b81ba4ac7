"""Registered queries that write files made of the given tables, read them back with the library's sources, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as R
from ..sources import files as S
from ..sources.incremental import RunFiles
from . import fixtures as X
from .fixtures import features_sql, manifest_sql, runs_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def write_files(df: DataFrame, root: str) -> str:
    """A file for each row (path, content) below ``root``, which is returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs.create_dir(f"{base}/{path.rpartition('/')[0]}", recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    df.select("path", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    return root


@query("s1_read_image_manifest", manifest_sql("SELECT domain, class_name, count(DISTINCT doc_id % 20) AS n, sum(1) AS length FROM manifest WHERE doc_id % 4 <> 0 GROUP BY ALL"))
def s1(spark, d):
    """Files domain/class/number.jpg, one byte for each document, and others that are no images."""
    k = F.col("doc_id") % 20
    name = F.concat_ws("/", "domain", "class_name", F.concat(k.cast("string"), F.when(k % 4 == 0, ".txt").when(k % 4 == 1, ".JPG").when(k % 4 == 2, ".jpeg").otherwise(".png")))
    made = X.manifest(spark, d).groupBy(name.alias("path")).agg(F.repeat(F.lit("x"), F.count("*").cast("int")).alias("content"))
    return S.read_image_manifest(spark, write_files(made, S.shared_folder(spark))).groupBy("domain", "class_name").agg(F.count("*").alias("n"), F.sum("length").alias("length"))


@query("s2_features", features_sql("SELECT domain, count(*) AS n, sum(label) AS labels, round(sum(feat[1]), 6) AS first FROM s GROUP BY domain"))
def s2(spark, d):
    path = S.shared_folder(spark)
    S.write_features(X.samples(spark, d), path)
    return S.read_features(spark, path).groupBy("domain").agg(F.count("*").alias("n"), F.sum("label").alias("labels"), F.round(F.sum(F.get("feat", 0)), 6).alias("first"))


def _run_files(spark: SparkSession, d: str, name: str, content: Column, keep: Column | None = None) -> str:
    """One file for each (src, tgt, method, seed) of the runs; returns the folder of all runs."""
    rows = X.runs(spark, d) if keep is None else X.runs(spark, d).filter(keep)
    path = F.concat_ws("/", F.lit("office-home"), F.concat("src", F.lit("2"), "tgt"), "method", F.concat(F.lit("r"), "seed"), F.lit(name))
    return write_files(rows.groupBy("src", "tgt", "method", "seed").agg(content.alias("content"), F.first(path).alias("path")), S.shared_folder(spark))


@query("s3_read_metrics_csv", runs_sql("SELECT method AS dir_method, src || '2' || tgt AS dir_transfer, 'r' || seed AS dir_run_id, arg_min(coalesce(target_acc, -1), row_no) AS first_acc, arg_max(coalesce(target_acc, -1), row_no) AS last_acc FROM runs GROUP BY src, tgt, method, seed"))
def s3(spark, d):
    """One line per run of the file's group; these files are test data and are made whole in one cell each."""
    line = F.concat_ws(",", F.lit("office-home"), "src", "tgt", "method", "run_id", "seed", F.lit("1.5"), F.coalesce(F.col("target_acc").cast("string"), F.lit("-1")))
    lines = F.array_sort(F.collect_list(F.struct("row_no", line.alias("line"))))
    content = F.concat(F.lit("dataset,src,tgt,method,run_id,seed,source_acc,target_acc\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n"))
    root = _run_files(spark, d, "metrics.csv", content)
    key = ["dir_method", "dir_transfer", "dir_run_id"]
    first, last = (S.read_metrics_csv(spark, root, pick).select(*key, F.col("target_acc").alias(f"{pick}_acc")) for pick in ("first", "last"))
    return first.join(last, key)


@query("s4_read_run_json", runs_sql("SELECT method AS dir_method, src || '2' || tgt AS dir_transfer, 'r' || seed AS run_id, bool_or(row_no % 50 = 0) AS completed, (count(*))::INTEGER AS last_completed_epoch FROM runs GROUP BY src, tgt, method, seed HAVING seed <> 2"))
def s4(spark, d):
    """Files of one seed are broken and absent from the result."""
    state = F.to_json(F.struct(F.bool_or(F.col("row_no") % 50 == 0).alias("completed"), F.concat(F.lit("r"), F.first("seed")).alias("run_id"), F.count("*").alias("last_completed_epoch")))
    root = _run_files(spark, d, "state.json", F.when(F.first("seed") == 2, "{broken").otherwise(state))
    return S.read_run_json(spark, root).select("dir_method", "dir_transfer", "run_id", "completed", "last_completed_epoch")


@query("s5_read_log_tail", runs_sql("SELECT right(repeat(method || seed || chr(10), 90 * (1 + seed)), 800) AS tail, count(*) AS n FROM (SELECT DISTINCT src, tgt, method, seed FROM runs) GROUP BY ALL"))
def s5(spark, d):
    root = _run_files(spark, d, "stderr.txt", F.repeat(F.concat(F.first("method"), F.first("seed"), F.lit("\n")), (90 * (1 + F.first("seed"))).cast("int")))
    return S.read_log_tail(spark, f"{root}/*/*/*/*/stderr.txt").groupBy("tail").agg(F.count("*").alias("n"))


@query("s6_write_summary", runs_sql("SELECT method, count(target_acc) AS n, round(avg(target_acc), 6) AS mean, kind FROM runs, (SELECT unnest(['csv', 'json', 'parquet']) AS kind) GROUP BY method, kind"))
def s6(spark, d):
    """The same summary in three formats, read back."""
    table, out = R.valid_results(X.runs(spark, d)).groupBy("method").agg(F.count("*").alias("n"), F.avg("target_acc").alias("mean")), []
    for kind in ("csv", "json", "parquet"):
        path = S.shared_folder(spark)
        S.write_summary(table, path, kind)
        reader = spark.read.schema("method string, n bigint, mean double")
        back = reader.csv(path, header=True) if kind == "csv" else reader.json(path) if kind == "json" else spark.read.parquet(path)
        out.append(back.select("method", "n", F.round("mean", 6).alias("mean"), F.lit(kind).alias("kind")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("s6_write_best_by_val", runs_sql("SELECT upper(method) AS algorithm, run_id, round(val_acc, 6) AS val_acc FROM runs QUALIFY row_number() OVER (PARTITION BY upper(method) ORDER BY val_acc DESC, row_no) = 1"))
def s6b(spark, d):
    """The best run of each algorithm as one JSON object, read back."""
    path = S.shared_folder(spark)
    S.write_best_by_val(R.best_by_val(X.runs(spark, d)).select("method", "run_id", "val_acc", "status"), path)
    back = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<run_id: string, val_acc: double>>")).alias("algorithm", "best"))
    return back.select("algorithm", "best.run_id", F.round("best.val_acc", 6).alias("val_acc"))


@query("s7_write_weights", features_sql("SELECT 'weights' AS name, count(*) AS n, sum(sample_id)::DOUBLE AS x FROM s WHERE domain = 'source' UNION ALL SELECT 'iis_history', 3, 3"))
def s7(spark, d):
    weights = X.samples(spark, d).filter("domain = 'source'").select("sample_id", (F.col("sample_id") * 1.0).alias("w"))
    path = S.shared_folder(spark)
    S.write_weights(weights, spark.range(3).select(F.col("id").alias("iteration"), F.lit(1.0).alias("objective")), path)
    w, h = S.read_weights(spark, path)
    sums = lambda df, name, c: df.agg(F.count("*").alias("n"), F.sum(c).alias("x")).select(F.lit(name).alias("name"), "n", "x")
    return sums(w, "weights", "w").unionByName(sums(h, "iis_history", "objective"))


@query("s3_refresh_run_files", runs_sql("SELECT method AS dir_method, src || '2' || tgt AS dir_transfer, 'r' || seed AS dir_run_id, max(row_no)::DOUBLE + CASE WHEN seed = 1 THEN 1 ELSE 0 END AS target_acc, 0 AS reopened FROM runs GROUP BY src, tgt, method, seed"))
def s3r(spark, d):
    """Files are read, those of one seed are then written anew with another length, and only these are read again; a third look opens none."""
    line = lambda more: F.concat(F.lit("dataset,src,tgt,method,run_id,seed,source_acc,target_acc\noffice-home,a,b,m,r,0,1.5,"), (F.max("row_no") + more).cast("double").cast("string"), F.lit("\n" * (1 + more)))
    root = _run_files(spark, d, "metrics.csv", line(0))
    runs = RunFiles(spark, root, "metrics.csv", S.shared_folder(spark), lambda paths: S.read_metrics_csv(spark, root, paths=paths), 8)
    first = runs.refresh()
    rows = X.runs(spark, d).filter("seed = 1")
    path = F.concat_ws("/", F.lit("office-home"), F.concat("src", F.lit("2"), "tgt"), "method", F.concat(F.lit("r"), "seed"), F.lit("metrics.csv"))
    write_files(rows.groupBy("src", "tgt", "method", "seed").agg(line(1).alias("content"), F.first(path).alias("path")), root)
    second = runs.refresh()
    if not 0 < second < first:
        raise ValueError(f"opened {first}, then {second} files")
    return runs.table().select("dir_method", "dir_transfer", "dir_run_id", "target_acc", F.lit(runs.refresh()).alias("reopened"))


#: Metrics of a run under different keys: the first of acc_wg, acc_avg, accuracy, acc that is a number counts.
PICKED = """p AS (SELECT *, CASE row_no % 4 WHEN 0 THEN val_acc WHEN 1 THEN val_acc / 2 WHEN 2 THEN val_acc / 3 END AS val_score, CASE row_no % 4 WHEN 0 THEN 'acc_wg' WHEN 1 THEN 'acc_avg' WHEN 2 THEN 'acc' END AS val_metric_key, CASE WHEN row_no % 3 = 0 THEN val_acc * 2 END AS test_score FROM runs)"""


@query("s6_write_best_selected", runs_sql("SELECT upper(method) AS algorithm, run_id, round(val_score, 6) AS val_score, val_metric_key, round(test_score, 6) AS test_score FROM p WHERE val_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY upper(method) ORDER BY val_score DESC, row_no) = 1", PICKED))
def s6s(spark, d):
    """Best runs by whichever metric a run has, with its key and the test score, written as one JSON object and read back."""
    i, v = F.col("row_no") % 4, F.col("val_acc")
    text = lambda c: c.cast("string")
    val = F.when(i == 0, F.create_map(F.lit("acc"), F.lit("0"), F.lit("acc_wg"), text(v))).when(i == 1, F.create_map(F.lit("acc_wg"), F.lit("none"), F.lit("acc_avg"), text(v / 2))).when(i == 2, F.create_map(F.lit("loss"), F.lit("9"), F.lit("acc"), text(v / 3))).otherwise(F.create_map(F.lit("loss"), F.lit("9")))
    test = F.when(F.col("row_no") % 3 == 0, F.create_map(F.lit("accuracy"), text(v * 2)))
    rows = X.runs(spark, d).withColumn("metrics", F.create_map(F.lit("val"), val, F.lit("test"), test))
    path = S.shared_folder(spark)
    S.write_best_by_val(R.best_selected(rows).select("method", "run_id", "val_score", "val_metric_key", "test_score"), path)
    kind = "map<string, struct<run_id: string, val_score: double, val_metric_key: string, test_score: double>>"
    back = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("algorithm", "best"))
    return back.select("algorithm", "best.run_id", F.round("best.val_score", 6).alias("val_score"), "best.val_metric_key", F.round("best.test_score", 6).alias("test_score"))
