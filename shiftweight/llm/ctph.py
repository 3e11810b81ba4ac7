"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes is read at every position; where it ends in at least L zero bits a piece ends
(block size 2**L), so pieces depend on content and an edit changes the pieces around it only. A piece is
hashed to one of 64 characters. The level L is the smallest one that gives at most 64 pieces; the fingerprint
``L:signature at L:at L + 1:at L + 2`` can be compared with one whose level differs by up to two. Likeness is
one minus the edit distance over the longer signature, the best over the levels that both have; it is zero if
the signatures share no run of four characters (of a third of the shorter one, if that is less).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LONGEST = 64  # characters of a signature; one machine word in the edit distance
ROLL = 7  # bytes that the rolling hash sees
LEVELS = 3  # consecutive block sizes in a fingerprint
COMMON = 4  # characters that two signatures must share in a row
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_WEIGHTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5], np.uint32)


def _levels(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of trailing zero bits of the rolling hash at each byte; bytes before the row count as zero."""
    roll = np.zeros(len(data), np.uint32)
    wide = data.astype(np.uint32) + np.uint32(1)
    within = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    for j in range(min(ROLL, len(data))):
        roll[j:] += np.where(within[j:] >= j, wide[: len(data) - j] * _WEIGHTS[j], np.uint32(0))
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x2C1B3C6D)
    roll ^= roll >> np.uint32(13)
    roll |= np.uint32(1 << 31)
    low = roll & (~roll + np.uint32(1))
    return np.log2(low.astype(np.float64)).astype(np.int8)


def _signatures(prefix: np.ndarray, cuts: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Signatures of all rows from piece ends ``cuts`` (sorted, with the row of each)."""
    n = len(bounds) - 1
    filled = np.flatnonzero(np.diff(bounds) > 0)
    ends = np.concatenate([cuts, bounds[filled + 1]])  # the rest behind the last cut is a piece too
    rows = np.concatenate([row, filled])
    order = np.lexsort((ends, rows))
    ends, rows = ends[order], rows[order]
    again = np.zeros(len(ends), bool)
    again[1:] = (ends[1:] == ends[:-1]) & (rows[1:] == rows[:-1])
    ends, rows = ends[~again], rows[~again]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:] != rows[:-1]
    starts[new] = bounds[rows[new]]
    text = _LETTERS[(_text.span_hashes(prefix, starts, ends) & np.uint64(63)).astype(np.int64)].tobytes().decode()
    ptr = np.searchsorted(rows, np.arange(n + 1))
    return [text[ptr[i] : ptr[i + 1]] for i in range(n)]


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each whole text. The empty text has the fingerprint ``0:::``."""
    data, off = _text.buffers(pa.array(texts, pa.large_string()))
    out: list[str] = []
    for lo, hi in _text.chunks(off):
        part, bounds = data[off[lo] : off[hi]], (off[lo : hi + 1] - off[lo]).astype(np.int64)
        n = hi - lo
        level, row = _levels(part, bounds), np.repeat(np.arange(n), np.diff(bounds))
        counts = np.bincount(row * 32 + level, minlength=n * 32).reshape(n, 32)[:, ::-1].cumsum(axis=1)[:, ::-1]  # cuts at level >= L
        own = np.argmax(counts < LONGEST, axis=1)
        prefix = _text.prefix_hashes(part)
        both = []
        for more in range(LEVELS):
            cuts = np.flatnonzero(level >= (own + more)[row])
            both.append(_signatures(prefix, cuts + 1, row[cuts], bounds))
        out += [":".join((str(lv), *s)) for lv, *s in zip(own.tolist(), *both, strict=True)]
    return out


def _codes(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(s) for s in signatures], np.int64)
    codes = np.full((len(signatures), LONGEST), 255, np.uint8)
    codes[np.arange(LONGEST)[None, :] < length[:, None]] = np.frombuffer("".join(signatures).encode(), np.uint8)
    return codes, length


def edit_distance(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of many pairs of signatures at once: one bit-parallel step per character of ``b``."""
    (ca, la), (cb, lb) = _codes(a), _codes(b)
    one = np.uint64(1)
    masks = np.zeros((len(a), 256), np.uint64)
    rows = np.arange(len(a))
    for i in range(LONGEST):
        at = rows[i < la]
        masks[at, ca[at, i]] |= one << np.uint64(i)
    up, down, score = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64), la.copy()
    last = one << np.maximum(la - 1, 0).astype(np.uint64)
    for j in range(int(lb.max(initial=0))):
        live = (j < lb) & (la > 0)
        eq = masks[rows, cb[:, j]]
        across = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(across | up), up & across
        score += np.where(live & ((plus & last) > 0), 1, 0) - np.where(live & ((minus & last) > 0), 1, 0)
        plus, minus = (plus << one) | one, minus << one
        up, down = np.where(live, minus | ~((eq | down) | plus), up), np.where(live, plus & (eq | down), down)
    return np.where(la == 0, lb, score)


def _share_run(a: str, b: str) -> bool:
    n = min(COMMON, max(1, min(len(a), len(b)) // 3))
    have = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in have for i in range(len(b) - n + 1))


def likeness(a: list[str], b: list[str]) -> list[float]:
    """Likeness (0 to 1) of fingerprint pairs: 1 for equal ones, 0 for levels too far apart."""
    out = [0.0] * len(a)
    pairs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[i] = 1.0
            continue
        (lx, *xs), (ly, *ys) = x.split(":"), y.split(":")
        sx, sy = ({int(level) + k: s for k, s in enumerate(sigs)} for level, sigs in ((lx, xs), (ly, ys)))
        options = [(sx[k], sy[k]) for k in sx.keys() & sy.keys()]
        pairs += [(i, s, t) for s, t in options if min(len(s), len(t)) > 1 and _share_run(s, t)]
    for lo in range(0, len(pairs), 4096):
        part = pairs[lo : lo + 4096]
        d = edit_distance([p[1] for p in part], [p[2] for p in part])
        for (i, s, t), x in zip(part, d.tolist(), strict=True):
            out[i] = max(out[i], 1.0 - x / max(len(s), len(t)))
    return out


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a null text counts as empty.

    Other columns are ignored, whatever their names; repeated rows give a row each. A map over partitions.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(texts), pa.string())], ["doc_id", "fingerprint"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("fingerprint", T.StringType())]))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket in descending doc_id; the row after the bucket's own rows is only looked at."""
    ids: list = []
    texts: list[str] = []
    own: list[bool] = []
    bucket: list[int] = []

    def flush(rest: int) -> Iterator[pa.RecordBatch]:
        n = len(texts) - rest
        at = [i for i in range(n) if own[i]]
        edited = []
        for i in at:
            t, half = texts[i], len(texts[i]) // 2
            edited.append(t[: len(t) - half] + (texts[i + 1] if i + 1 < len(texts) and bucket[i + 1] == bucket[i] else t)[:half])
        if at:
            prints = fingerprints(texts)
            of_edited = fingerprints(edited)
            mine = [prints[i] for i in at]
            following = [prints[i + 1] if i + 1 < len(texts) and bucket[i + 1] == bucket[i] else prints[i] for i in at]
            yield pa.RecordBatch.from_pydict({
                "doc_id": [ids[i] for i in at], "n_chars": [len(texts[i]) for i in at], "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": mine, "edited_fingerprint": of_edited, "near_edited": likeness(mine, of_edited), "near_next": likeness(mine, following),
            }, schema=out_schema)
        del ids[:n], texts[:n], own[:n], bucket[:n]

    out_schema = None
    for batch in batches:
        if out_schema is None:
            out_schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        _, off = _text.buffers(batch.column("text"))
        for lo, hi in _text.chunks(off, 4 * _text.CHUNK_BYTES):
            part = batch.slice(lo, hi - lo)
            ids += part.column("doc_id").to_pylist()
            texts += ["" if t is None else t for t in part.column("text").to_pylist()]
            own += part.column("own").to_pylist()
            bucket += part.column("bucket").to_pylist()
            yield from flush(1)  # the last row waits for its neighbour
    if out_schema is not None:
        yield from flush(0)


#: Ranges of doc_ids at most: 3 MB for the driver and for each task.
BUCKETS = 1 << 16


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = 2000) -> DataFrame:
    """Fingerprint of every text and of the text with its second half replaced by its neighbour's beginning.

    The neighbour is the next document in descending (numeric) doc_id, ties by hash of the text, null doc_ids
    last; after the last comes the first; a doc_id that is no number is an error; a single document is its own neighbour. The last floor(n_chars / 2)
    code points give way to as many from the neighbour's beginning, or all it has. Returns (doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per input row; null
    texts are empty. Repeated rows are neighbours of each other. Other columns are ignored.

    Scale: buckets are doc_id ranges between approximate quantiles, one for each ``bucket_rows`` rows up to ``BUCKETS`` of
    them, so neighbours meet after one shuffle of the texts and a task, which has eight buckets at most, reads its rows
    as a stream. Each bucket also gets a copy of the next bucket's first row (one text per bucket, no more). The driver
    sees two narrow rows per bucket.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = source.select("doc_id", "th")
    if not isinstance(source.schema["doc_id"].dataType, T.NumericType):
        raise ValueError("doc_id must be a number: documents are neighbours by its order")
    wanted = max(1, min(BUCKETS, -(-narrow.count() // bucket_rows)))
    # Quantiles may be off by a hundredth of a bucket, by a tenth where there are very many.
    cuts = narrow.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], max(10 * wanted, min(100 * wanted, 1 << 18))).alias("c")).first().c if wanted > 1 else None
    edges = np.array(sorted(set(cuts or [])))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        """0 for the largest ids, one more behind each cut; nulls come last."""
        at = len(edges) - np.searchsorted(edges, ids.to_numpy(np.float64, na_value=0), "left")
        return pd.Series(np.where(ids.isna(), len(edges) + 1, at).astype(np.int32))

    first = F.max(F.struct("doc_id", "th"))
    heads = {r.bucket: r.head for r in narrow.withColumn("bucket", bucket_of("doc_id")).groupBy("bucket").agg(first.alias("head")).collect()}
    filled = sorted(heads)
    head_type = T.StructType([source.schema["doc_id"], T.StructField("th", T.LongType())])
    shown = spark.createDataFrame([(b, heads[b], filled[i - 1]) for i, b in enumerate(filled)], T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("head", head_type), T.StructField("before", T.IntegerType())]))
    # ``shown`` has at most BUCKETS + 1 rows, without texts.
    rows = source.withColumn("bucket", bucket_of("doc_id")).join(F.broadcast(shown), "bucket", "left")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("own"))
    there = F.struct(F.col("before").alias("bucket"), F.lit(False).alias("own"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("th").eqNullSafe(F.col("head.th"))
    dealt = rows.select("doc_id", "text", "th", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))).alias("to")).select("doc_id", "text", "th", "to.*")
    lined = dealt.repartition(max(1, min(len(filled), tasks), len(filled) // 8), "bucket").sortWithinPartitions(F.col("bucket"), F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("th").desc())
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    return lined.select("doc_id", "text", "bucket", "own").mapInArrow(_edits, schema)
