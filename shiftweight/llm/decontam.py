"""Benchmark decontamination by winnowing.

Both sides are reduced to fingerprints: of the k-gram hashes in every window of w consecutive k-grams the
smallest is kept. With k + w - 1 = t, two texts that share t consecutive words share a fingerprint there.
Distinct fingerprints are joined, and each joined place is extended to the windows of t words around it, which are
looked up among the distinct windows of the benchmark; a window that is found marks its words as hit, and windows that
follow one another make longer spans. Which items have a window is joined once for each document and window. So
a place costs a row however many items share its words. Items shorter than the window are one window of
their own length t; each length that occurs gets its own (k, w).

Scale: one pass over the corpus, no text is shuffled. A bit map of fixed size over the benchmark's
fingerprints is broadcast and drops corpus fingerprints that cannot join, so what moves is one narrow row per
document plus the rows that (almost surely) match. A saturated map only lets more rows through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._store import written

#: Slots of the broadcast bit map (1 MB); its size does not depend on the data.
FILTER_BITS = 23


def gram_size(t: int) -> int:
    """k for spans of t words; the window is then t - k + 1 k-grams wide."""
    return (t + 1) // 2


def winnow(g: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the minimum of some window of w consecutive k-grams of one row.

    Ties are all kept, so equal windows select equal offsets on both sides.
    """
    n = len(g)
    if n < w:
        return np.zeros(0, np.int64)
    low = g[: n - w + 1].copy()
    for j in range(1, w):
        np.minimum(low, g[j : j + n - w + 1], out=low)
    whole = (row[: n - w + 1] >= 0) & (row[: n - w + 1] == row[w - 1 :])
    keep = np.zeros(n, bool)
    for j in range(w):
        keep[j : j + n - w + 1] |= whole & (g[j : j + n - w + 1] == low)
    return np.flatnonzero(keep)


def _fingerprints(w: _text.Words, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = gram_size(t)
    g, row = _text.grams(w.hashes, k), _text.gram_rows(w, k)
    at = winnow(g, row, t - k + 1)
    return at, g[at], row[at]


def _windows(w: _text.Words, at: np.ndarray, row: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``at``, first word) of each window of t words of the row that holds the k-gram at that place."""
    first = at[:, None] + np.arange(gram_size(t) - t, 1)[None, :]
    inside = (first >= w.ptr[row][:, None]) & (first + t <= w.ptr[row + 1][:, None])
    return np.nonzero(inside)[0], first[inside]


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _item_rows(window: int):
    """Per item: its window length t, all its fingerprints (h) and all its windows (g); of the two one is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = _text.buffers(batch.column("text"))
            for lo, hi in _text.chunks(off):
                w = _text.words(data, off[lo : hi + 1], _text.WORD_ALNUM)
                length = np.minimum(w.counts, window)
                for t in np.unique(length[length > 0]):
                    t = int(t)
                    at, h, row = _fingerprints(w, t)
                    own = length[row] == t
                    g, of = _text.grams(w.hashes, t), _text.gram_rows(w, t)
                    whole = np.flatnonzero((of >= 0) & (length[np.maximum(of, 0)] == t))
                    for rows, values, empty in ((row[own], h[own], False), (of[whole], g[whole], True)):
                        ids = batch.column("item_id").take(pa.array(rows + lo))
                        values, none = pa.array(values.view(np.int64)), pa.nulls(len(values), pa.int64())
                        yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(rows), t, np.int32)), none if empty else values, values if empty else none], ["item_id", "t", "h", "g"])

    return run


def _document_rows(lengths: list[int], bitmap):
    """Per document one row with t = 0, and one for each window around a fingerprint that the benchmark may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bitmap.value).view(bool) if lengths else None
        for batch in batches:
            data, off = _text.buffers(batch.column("text"))
            th = np.asarray(batch.column("key").field("th")).view(np.uint64)
            for lo, hi in _text.chunks(off):
                w = _text.words(data, off[lo : hi + 1], _text.WORD_ALNUM)
                n = hi - lo
                # Rows with t = 0 join with nothing; a number of their own keeps them from meeting in one task.
                spread = _text.mix(np.arange(lo, hi).astype(np.uint64) + th[lo:hi]).view(np.int64)
                parts = [(np.arange(n), 0, spread, np.zeros(n, np.int64), spread)]
                for t in lengths:
                    at, h, row = _fingerprints(w, t)
                    keep = known[_slots(h)]
                    at, h, row = at[keep], h[keep], row[keep]
                    place, first = _windows(w, at, row, t)
                    g = _text.grams(w.hashes, t)
                    parts.append((row[place], t, h[place].view(np.int64), first - w.ptr[row[place]], g[first].view(np.int64)))
                for row, t, h, start, g in parts:
                    take = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(take), pa.array(w.counts[row].astype(np.int64)), pa.array(np.full(len(row), t, np.int32)), pa.array(h), pa.array(start.astype(np.int64)), pa.array(g)],
                        ["key", "n_words", "t", "h", "start", "g"],
                    )

    return run


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items that occur in each document, and the document's words inside such occurrences.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of characters outside ASCII. A window is
    ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

    Returns (doc_id, th, n_words, n_hit, item_ids, spans): ``spans`` are [start, end) word ranges, merged and
    in order; ``item_ids`` are distinct strings, sorted. Null and empty texts have no words and no hits. Rows
    equal in doc_id and text count as one document and give one row; a doc_id with two texts gives two
    (``th`` tells them apart). Items with null or empty text never occur; equal item_ids count once; null
    item_ids count as the string 'null'. An empty benchmark leaves every document clean. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    benchmark = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    made = written(benchmark.mapInArrow(_item_rows(window), "item_id string, t int, h bigint, g bigint").distinct())
    prints, windows = made.filter("h IS NOT NULL").select("t", "h").distinct(), made.filter("g IS NOT NULL").select("t", "g", "item_id")
    lengths = sorted(r.t for r in prints.select("t").distinct().collect())  # at most ``window`` values
    slots = prints.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int").alias("s")).distinct().toPandas()["s"].to_numpy()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[slots.astype(np.int64)] = True
    bitmap = spark.sparkContext.broadcast(np.packbits(bits))
    text_ = F.col(text).cast("string")
    source = docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text_).alias("th")).alias("key"), text_.alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("h", "start", "g")]
    rows = source.mapInArrow(_document_rows(lengths, bitmap), T.StructType([source.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("t", T.IntegerType()), *longs]))
    # Fingerprints that both sides have, then windows that both have; t = 0 are the documents themselves.
    joined = rows.join(prints.withColumn("known", F.lit(True)), ["t", "h"], "left").filter("t = 0 OR known").drop("known", "h")
    joined = joined.join(windows.select("t", "g").distinct().withColumn("known", F.lit(True)), ["t", "g"], "left").filter("t = 0 OR known").drop("known")
    found = written(joined)
    named = found.filter("t > 0").select("key", "t", "g").distinct().join(windows, ["t", "g"])
    span = F.when(F.col("t") > 0, F.struct("start", (F.col("start") + F.col("t")).alias("end")))
    parts = found.select("key", "n_words", span.alias("span"), F.lit(None).cast("string").alias("item_id")).unionByName(
        named.select("key", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("span"), "item_id")
    )
    hits = parts.groupBy("key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.array_sort(F.collect_set("span")).alias("found"))
    merged = F.expr(
        "aggregate(found, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) -> "
        "CASE WHEN size(a) > 0 AND element_at(a, -1).end >= s.start "
        "THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))) "
        "ELSE concat(a, array(s)) END)"
    )
    hits = hits.withColumn("spans", merged)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits.select("key.doc_id", "key.th", "n_words", n_hit.alias("n_hit"), "item_ids", "spans")
