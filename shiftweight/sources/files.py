"""Readers and writers: image manifests, feature tables, run artifacts, weights and summaries."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json

IMAGE_FILES = r"(?i)\.(jpe?g|png|bmp|gif|tiff?|webp)$"
# The columns of a metrics file, in their order, and those of state and signature files.
METRICS_SCHEMA = (
    "dataset string, src string, tgt string, method string, run_id string, seed int, source_acc double, target_acc double, epochs_source int, epochs_adapt int, backbone string, batch_size int, lr double, timestamp string, "
    "git_sha string, lr_backbone double, lr_classifier double, classifier_lr double, backbone_lr_scale double, weight_decay double, deterministic string, transforms_id string, method_params_json string"
)
STATE_SCHEMA = "completed boolean, stage string, method string, run_id string, last_completed_epoch int, total_epochs int, final_checkpoint string, last_checkpoint string"
SIGNATURE_SCHEMA = "method_name string, source_checkpoint string, model_state_hash string, comparison_fingerprint string"
# Directories of a run below the runs folder, outermost first.
RUN_DIRS = ["dataset", "transfer", "method", "run_id"]


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; without it, a temporary one in a local session and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    # "local" and "local[n]" have one machine; "local-cluster[...]" stands for a cluster.
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or tempfile.gettempdir() + "/spark-shared").rstrip("/") + "/" + uuid.uuid4().hex


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that what made it is not run again and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_image_manifest(spark: SparkSession, root: str, domains: list[str] | None = None) -> DataFrame:
    """(path, domain, class_name, length) of images below root/domain/class/; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length").filter(F.col("path").rlike(IMAGE_FILES))
    parts = F.split("path", "/")
    found = files.select("path", F.element_at(parts, -3).alias("domain"), F.element_at(parts, -2).alias("class_name"), "length")
    return found if domains is None else found.filter(F.col("domain").isin(domains))


def write_features(df: DataFrame, path: str, by: str | None = "domain") -> None:
    """Feature table as Parquet, partitioned by split or domain; no rows are an error."""
    if df.isEmpty():
        raise ValueError("no features to write")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _run_key(path: Column) -> list[Column]:
    """Run directories from a file path runs_root/dataset/src2tgt/method/run_id/..., counted from the file."""
    parts = F.split(path, "/")
    return [F.element_at(parts, -len(RUN_DIRS) - 1 + i).alias(f"dir_{name}") for i, name in enumerate(RUN_DIRS)]


def read_metrics_csv(spark: SparkSession, runs_root: str, pick: str = "first", paths: list[str] | None = None) -> DataFrame:
    """One row per metrics.csv with the directories it stands in: the ``first`` row of each file, or the ``last``, by its place in the file.

    ``paths`` names the files to read; without it, all below ``runs_root``.
    """
    found = paths if paths is not None else f"{runs_root}/*/*/*/*/metrics.csv"
    # A large file is read in blocks by several tasks: the place is the block's first byte, then the order within the block.
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = spark.read.schema(METRICS_SCHEMA).csv(found, header=True).select("*", F.col("_metadata.file_path").alias("file"), place.alias("_at"))
    chosen = F.min_by if pick == "first" else F.max_by
    one = rows.groupBy("file").agg(chosen(F.struct(*[c for c in rows.columns if c not in ("file", "_at")]), F.col("_at")).alias("r"))
    return one.select("r.*", "file").select("*", *_run_key(F.col("file")))


def read_run_json(spark: SparkSession, runs_root: str, name: str = "state.json", schema: str = STATE_SCHEMA, paths: list[str] | None = None) -> DataFrame:
    """One row per JSON file of that name (or of those in ``paths``); unreadable files are absent, not errors."""
    found = paths if paths is not None else f"{runs_root}/*/*/*/*/{name}"
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(found)
    return rows.select("*", F.col("_metadata.file_path").alias("file")).filter(F.col("_corrupt").isNull()).select("*", *_run_key(F.col("file"))).drop("_corrupt")


def read_log_tail(spark: SparkSession, path: str, chars: int = 800) -> DataFrame:
    """(file, tail): the last characters of each text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.right("value", F.lit(chars)).alias("tail"))


def write_summary(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Small result tables as one file of CSV or JSON lines, others as Parquet."""
    writer = (df if kind == "parquet" else df.coalesce(1)).write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()


def write_best_by_val(best: DataFrame, path: str, algorithm: str = "method") -> None:
    """One JSON object: for each algorithm (upper case, sorted) the other columns of its best run. ``best`` has a row per algorithm."""
    fields = F.struct(*sorted(c for c in best.columns if c != algorithm))
    entries = F.array_sort(F.collect_list(F.struct(F.upper(algorithm).alias("key"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))))
    lines = F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(": "), e["value"]))
    # A name as JSON text is what stands between the brackets of a list of one name.
    named = F.transform(lines, lambda s: F.regexp_replace(s, r'^\["(.*?)"\]: ', '"$1": '))
    best.agg(F.concat(F.lit("{"), F.array_join(named, ", "), F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_weights(weights: DataFrame, history: DataFrame, path: str) -> None:
    """Tables ``weights`` and ``iis_history`` below ``path``."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    history.write.mode("overwrite").parquet(f"{path}/iis_history")


def read_weights(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/iis_history")


def config_json(config: dict) -> str:
    """Canonical JSON text of a configuration (see :func:`canonical_json`)."""
    return canonical_json(json.loads(json.dumps(config)))
