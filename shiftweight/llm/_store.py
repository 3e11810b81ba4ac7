"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: No task of a spread join gets more than one of so many parts of its rows by one key.
PARTS = 1024


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where that is unset, a local session, which has one machine only, takes a temporary folder; on a cluster it is an
    error, since no folder of the driver's own will do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir() + "/spark-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later stages survive lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join rows with ``groups`` (keys, n = number of their rows, ...; a written table), n not kept.

    Rows of a key with more than one of PARTS parts of all rows are dealt by ``spread`` over as many copies of its
    group as that takes. At most PARTS keys are so frequent, so they can be broadcast.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    copies = F.ceil(F.col("n") * PARTS / F.lit(float(max(total, 1)))).cast("int")
    frequent = groups.filter(copies > 1).select(*keys, copies.alias("copies"))
    dealt = rows.join(F.broadcast(frequent), keys, "left").withColumn("copy", F.coalesce(F.pmod(spread, F.col("copies")), F.lit(0)).cast("int")).drop("copies")
    return dealt.join(groups.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("n"), [*keys, "copy"], how).drop("copy")
