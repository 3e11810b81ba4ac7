"""Sharding by jump consistent hashing.

A key and the number of shards decide the shard; no ring table exists anywhere. Going from n to n + 1 shards
moves a key only into the new shard, with probability 1 / (n + 1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers at a time; more rows make more buckets, not larger ones.
BUCKET_ROWS = 50_000
#: Equal rows that one row of counts is dealt out to at a time.
COPIES = 10_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. The expected number of steps is ln(shards), for all keys at once."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    active, following = np.arange(len(key)), np.zeros(len(key), np.int64)
    while len(active):
        shard[active] = following
        k = key[active] * np.uint64(2862933555777941757) + np.uint64(1)
        key[active] = k
        step = float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0)
        following = ((shard[active] + 1) * step).astype(np.int64)
        more = following < shards
        active, following = active[more], following[more]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of :func:`jump_hash` over a 64-bit integer key."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return run(key)


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard and number the rows of each shard 0, 1, 2, ... without gaps.

    Law ``key``: the shard depends on doc_id and ``shards`` alone, so rows with one doc_id stay together and
    ``grown_shard`` (with one shard more) is either ``shard`` or the new one. Slots follow (bucket, doc_id,
    size, checksum), where a bucket is a hash class of these three. Returns (doc_id, size, text_crc32, law,
    shard, slot, grown_shard), one row per input row. A null text has size 1 and checksum 0; a null doc_id is
    a key like any other. Repeated rows get a slot each. Other columns are ignored.

    Scale: only ids, sizes and checksums move. Equal rows are counted before they are dealt out, so a
    row that repeats without end costs one row and is dealt out again in parts of 10,000; a doc_id with texts without
    end is in many buckets. Numbering runs per bucket, and only bucket totals (rows / 50,000 of them) are summed
    over a shard.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    key = F.xxhash64("doc_id")
    # Enough buckets that each stays near BUCKET_ROWS rows.
    buckets = max(1, -(-docs.count() // (shards * BUCKET_ROWS)))
    placed = counted.select("*", jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"), F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(1)), F.lit(buckets)).alias("bucket"))
    totals = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(offsets, ["shard", "bucket"])
    # Row by row in two steps, so that copies without end are dealt over tasks.
    begin, end = F.col("offset") + F.col("first"), F.col("offset") + F.col("first") + F.col("copies") - 1
    parts = numbered.select("doc_id", "size", "text_crc32", "shard", "grown_shard", end.alias("end"), F.explode(F.sequence(begin, end, F.lit(COPIES).cast("long"))).alias("begin")).repartition("begin", "doc_id")
    slots = F.explode(F.sequence("begin", F.least(F.col("begin") + COPIES - 1, F.col("end"))))
    return parts.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slots.alias("slot"), "grown_shard")
