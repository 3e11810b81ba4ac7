"""Jaccard self-join on word shingles with token-combination prefixes.

Tokens are shingle hashes in one global order: tokens that many documents have come last, all others by hash.
A set of n shingles that links at p percent can miss at most n - ceil(p n / 100) of them, so a prefix of one
more must share a token. Rare tokens are indexed singly. Frequent tokens are split into m classes by hash and
indexed as pairs within a class: a class with s prefix tokens must lose s - 1 of them before no pair is
shared, so the prefix is extended until rare tokens plus the sums of s - 1 reach that number. m grows with
the size of the set (m = 2**(floor(log2 n) - 4)), which keeps the pairs linear in it; a set near a power of
two is indexed for both values, so partners always have one in common.

Equal sets are joined first and count once. In each bucket of an index key members are verified against
a leader; when links have merged most of them, what is left in different components is verified in full. Pairs that
bit maps of the sets already rule out are dropped before texts are fetched.
The result is exact (up to 64-bit hashes): no bucket is cut and no candidate dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import _text
from ._graph import components
from ._store import written

#: A token is frequent if more prefixes than this hold it; at most the MOST_FREQUENT such tokens are broadcast
#: (8 MB). Both only steer which tokens are indexed as pairs, never which links are found.
FREQUENT = 4
MOST_FREQUENT = 1 << 20
#: Rounds against leaders, and leaders per member and round, before the rest is verified in full.
STAR_ROUNDS = 2
TRIES = 3
#: Longs of the small bit map (128 bytes).
SMALL = 16


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer words is one shingle, without words none."""
    w = _text.words(data, off, _text.WORD_NOT_SPACE)
    g = _text.grams(w.hashes, shingle)
    out = []
    for lo, hi in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True):
        out.append(np.unique(g[lo : hi - shingle + 1]) if hi - lo >= shingle else _text.grams(w.hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def spare(n: int, percent: int) -> int:
    """How many of n shingles a linked set may lack."""
    return n - -(-percent * n // 100)


def _is_in(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, tokens)
    return known[np.minimum(at, len(known) - 1)] == tokens if len(known) else np.zeros(len(tokens), bool)


def index_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of one sorted set."""
    n = len(tokens)
    need = spare(n, percent) + 1
    often = _is_in(tokens, frequent)
    rare = tokens[~often][:need]
    if len(rare) >= need:
        return rare
    rest, keys = tokens[often], [rare]
    sizes = {max(n * percent // 100, 1).bit_length(), n.bit_length(), (n * 100 // percent).bit_length()}
    for bits in sorted(sizes):
        m = 1 << max(0, bits - 5)
        cls = (_text.mix(rest) % np.uint64(m)).astype(np.int64)
        again = np.ones(len(rest), bool)
        again[np.unique(cls, return_index=True)[1]] = False
        enough = int(np.searchsorted(np.cumsum(again), need - len(rare))) + 1
        part, cls = rest[:enough], cls[:enough]
        order = np.argsort(cls, kind="stable")
        part, cls = part[order], cls[order]
        # Partner j places further on in the same class (within a class tokens stay in hash order).
        for j in range(1, len(part)):
            same = cls[:-j] == cls[j:]
            if not same.any():
                break
            keys.append(_text.mix(part[:-j][same] * np.uint64(0x9E3779B97F4A7C15) + part[j:][same] + np.uint64(bits)))
    return np.unique(np.concatenate(keys))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)).view(np.int64)))


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, off = _text.buffers(batch.column("text"))
    for lo, hi in _text.chunks(off):
        yield lo, shingle_sets(data, off[lo : hi + 1], shingle)


def _set_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in _sets(batch, shingle):
                sums = [np.array([_text.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (1, 2)]
                ids = [batch.column(c).slice(lo, len(sets)) for c in ("doc_id", "th")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums)], ["doc_id", "th", "n", "s1", "s2"])

    return run


def _prefix_tokens(shingle: int, percent: int):
    """Tokens of all plain prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch, shingle):
                yield pa.RecordBatch.from_arrays([_lists([s[: spare(len(s), percent) + 1] for s in sets]).flatten()], ["token"])

    return run


def _key_rows(shingle: int, percent: int, frequent):
    """Index keys of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in _sets(batch, shingle):
                part = batch.slice(lo, len(sets))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), _lists([index_keys(s, frequent.value, percent) for s in sets])], ["doc_id", "th", "keys"])

    return run


def _with_bits(shingle: int):
    """Add two bit maps of each set: bit (hash mod m) for every shingle, with m the power of two from 4 n on, and
    one of 64 * SMALL bits as an array of longs, which a join condition can compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in _sets(batch, shingle):
                bits, small = [], []
                for s in sets:
                    few = np.zeros(64 * SMALL, bool)
                    few[((s >> np.uint64(20)) & np.uint64(64 * SMALL - 1)).astype(np.int64)] = True
                    small.append(np.packbits(few).view(np.uint64))
                    m = np.zeros(1 << max(6, (4 * len(s) - 1).bit_length()), bool)
                    m[(s & np.uint64(len(m) - 1)).astype(np.int64)] = True
                    bits.append(np.packbits(m).tobytes())
                part = batch.slice(lo, len(sets))
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits, pa.binary()), _lists(small), part.column("text")], ["rid", "n", "bits", "small", "text"])

    return run


def _possible(percent: int):
    """Drop pairs whose bit maps prove too many differences.

    A bit that one map has and the other has not stands for a shingle of one set only, and |x| + |y| - 2 * (least
    overlap) of those are allowed. Maps of different size are folded to the smaller one. No link is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            nx, ny = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
            for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
                apart = int(np.bitwise_count(x ^ y).sum())
                least = -(-percent * (nx[i] + ny[i]) // (100 + percent))
                if apart <= nx[i] + ny[i] - 2 * least:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _verified(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _text.buffers(batch.column("text_a")), _text.buffers(batch.column("text_b"))
            keep = []
            for i in range(batch.num_rows):
                x, y = (shingle_sets(d, o[i : i + 2], shingle)[0] for d, o in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


@dataclass(frozen=True)
class _Index:
    """What both forms of the join work on; all tables are written ones.

    base: (doc_id, th, n, s1, s2, row) of all rows; reps: (n, s1, s2, min_id, rid, copies), one per distinct set; members: (key, rid,
    members, n) of buckets with two sets or more; involved: (rid); texts: (rid, n, bits, small, text).
    """

    base: DataFrame
    reps: DataFrame
    members: DataFrame
    involved: DataFrame
    texts: DataFrame
    shingle: int
    percent: int

    def fits(self, x: Column, y: Column) -> Column:
        """Whether sets of x and y shingles can link."""
        return (F.lit(self.percent) * F.greatest(x, y)) <= (F.lit(100) * F.least(x, y))

    def close(self, x: str, y: str) -> Column:
        """Whether bit maps leave it open that two rows (aliases x, y with rid, n, small) link; x before y."""
        get = lambda side, i: F.get(f"{side}.small", i)
        apart = sum((F.bit_count(get(x, i).bitwiseXOR(get(y, i))) for i in range(1, SMALL)), F.bit_count(get(x, 0).bitwiseXOR(get(y, 0))))
        both = F.col(f"{x}.n") + F.col(f"{y}.n")
        allowed = both - 2 * F.ceil(F.lit(self.percent) * both / (100 + self.percent) - 1e-9)
        return (F.col(f"{x}.rid") < F.col(f"{y}.rid")) & self.fits(F.col(f"{x}.n"), F.col(f"{y}.n")) & (apart <= allowed)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their whole texts."""
        for c in "ab":
            pairs = pairs.join(self.texts.select(F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
        pairs = written(pairs.mapInArrow(_possible(self.percent), "a bigint, b bigint"))
        for c in "ab":
            pairs = pairs.join(self.texts.select(F.col("rid").alias(c), F.col("text").alias(f"text_{c}")), c)
        return pairs.mapInArrow(_verified(self.shingle, self.percent), "a bigint, b bigint")


def _indexed(docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str) -> _Index:
    spark = docs.sparkSession
    body = F.col(text).cast("string")
    source = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("th"))
    key = [source.schema["doc_id"], T.StructField("th", T.LongType())]
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    rows = source.mapInArrow(_set_rows(shingle), T.StructType([*key, *longs("n", "s1", "s2")]))
    base = written(rows.withColumn("row", F.monotonically_increasing_id()))  # fixed once it is written

    # One representative for all rows with the same set.
    same = ["n", "s1", "s2"]
    reps = written(base.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("min_id"), F.min("row").alias("rid"), F.count("*").alias("copies")))
    unique = written(base.select(F.col("row").alias("rid"), "doc_id", "th", "n").join(reps.select("rid"), "rid"))

    counts = source.select("text").mapInArrow(_prefix_tokens(shingle, percent), "token bigint").groupBy("token").count().filter(F.col("count") > FREQUENT)
    counts = written(counts.withColumn("level", F.floor(8 * F.log2("count")).cast("int")))
    # The lowest level from which on no more than MOST_FREQUENT tokens are left: the driver sees a number per level.
    above, least = 0, 1 << 30
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("n")).collect(), reverse=True):
        above += r.n
        if above > MOST_FREQUENT:
            break
        least = r.level
    often = counts.filter(F.col("level") >= least).select("token").toPandas()["token"].to_numpy(np.int64)
    frequent = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))
    names = unique.select("rid", F.col("doc_id").alias("u_id"), F.col("th").alias("u_th"), "n")
    keys = source.mapInArrow(_key_rows(shingle, percent, frequent), T.StructType([*key, T.StructField("keys", T.ArrayType(T.LongType()))]))
    keys = keys.join(names, names["u_id"].eqNullSafe(keys["doc_id"]) & names["u_th"].eqNullSafe(keys["th"])).select("rid", F.explode("keys").alias("key"))
    # Rows that repeat the representative are told apart from other members only among the few that share a key.
    counted = lambda df: df.withColumn("members", F.count("*").over(W.partitionBy("key"))).filter("members > 1")
    members = written(counted(counted(keys).drop("members").dropDuplicates(["key", "rid"])).join(names.select("rid", "n"), "rid"))

    involved = members.select("rid").distinct()
    wanted = unique.join(involved, "rid").select("rid", F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"))
    texts = source.join(wanted, source["doc_id"].eqNullSafe(wanted["k_id"]) & source["th"].eqNullSafe(wanted["k_th"])).select("rid", "text")
    texts = written(texts.dropDuplicates(["rid"]).mapInArrow(_with_bits(shingle), "rid bigint, n bigint, bits binary, small array<bigint>, text string"))
    return _Index(base, reps, members, involved, texts, shingle, percent)


def similar_components(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, component_id, component) of every row.

    Words are what space, tab, line feed, vertical tab, form feed and carriage return leave; A-Z is lower-cased. Two rows
    link if 100 * |intersection| >= ``percent`` * |union| of their shingle sets. ``component_id`` is the smallest
    doc_id that links lead to; a row without words links with nothing and keeps its own. Null texts have no words;
    null doc_ids take part, but are not the smallest unless alone. Repeated rows give a row each. ``th`` is a
    hash of the text, which tells rows with one doc_id apart. ``component`` tells groups apart where component_id
    cannot: it is never null, and rows have it in common only if links lead from one to the other. It is no name and
    differs from run to run. Other columns are ignored.

    Scale: about 15 to 20 percent of a set's hashes are shuffled twice; texts are shuffled once and written again only
    where a bucket has two members or more. All equal sets are one member, so copies without end cost a row each.
    """
    index = _indexed(docs, shingle, percent, doc_id, text)
    base, reps, members, involved, texts = index.base, index.reps, index.members, index.involved, index.texts
    same = ["n", "s1", "s2"]

    # Leaders: members that share the most with others, as the original of a group of near copies does.
    weight = members.groupBy("rid").agg(F.sum("members").alias("weight"))
    members = members.select("key", "rid", "n").join(weight, "rid")
    members = written(members)
    fits = index.fits
    parts = involved.select(F.col("rid").alias("node"), F.col("rid").alias("component"))
    links: DataFrame | None = None
    tried: DataFrame | None = None
    for turn in range(STAR_ROUNDS + 1):
        last = turn == STAR_ROUNDS
        placed = members.join(parts.withColumnRenamed("node", "rid"), "rid")
        counted = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.max(F.struct("weight", "rid", "n")).alias("lead"))
        main = counted.groupBy("key").agg(F.max(F.struct("c", "lead", "component")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("key", F.col("m.component").alias("at"), F.col("m.lead.rid").alias("lead"), F.col("m.lead.n").alias("lead_n"))
        apart = placed.join(main, "key").filter("component <> at")
        if last:
            # Every pair of different components in a bucket, but for two members of its main component. The bit maps
            # are compared in the join, so pairs that cannot link are never rows.
            open_rows = placed.join(main.select("key", "at"), "key").withColumn("outside", F.col("component") != F.col("at")).select("key", "rid", "n", "component", "outside").join(texts.select("rid", "small"), "rid")
            x, y = open_rows.alias("x"), open_rows.alias("y")
            close = index.close("x", "y") & (F.col("x.component") != F.col("y.component")) & (F.col("x.outside") | F.col("y.outside"))
            pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & close).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()
        elif turn:
            # Each member outside is tried against one member of the main component per bucket: the one before it in an
            # order that differs from bucket to bucket. In a group of near copies most members link this way.
            order = W.partitionBy("key").orderBy(F.xxhash64("rid", "key"), "rid").rowsBetween(W.unboundedPreceding, -1)
            partner = F.last(F.when(F.col("component") == F.col("at"), F.struct("rid", "n")), ignorenulls=True).over(order)
            pairs = placed.join(main, "key").withColumn("p", partner).filter((F.col("component") != F.col("at")) & F.col("p").isNotNull() & fits(F.col("n"), F.col("p.n")))
            pairs = pairs.select(F.least("rid", "p.rid").alias("a"), F.greatest("rid", "p.rid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        else:
            pairs = apart.filter(fits(F.col("n"), F.col("lead_n"))).select(F.least("rid", "lead").alias("a"), F.greatest("rid", "lead").alias("b"), "rid")
            # A few tries per member and round: the leaders that most of its buckets name.
            named = pairs.groupBy("rid", "a", "b").count()
            pairs = named.withColumn("r", F.row_number().over(W.partitionBy("rid").orderBy(F.col("count").desc(), "a", "b"))).filter(F.col("r") <= TRIES).select("a", "b").distinct()
        pairs = written(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = index.verified(pairs)
        links = written(found if links is None else links.unionByName(found))
        parts = written(involved.join(components(links), involved["rid"] == F.col("node"), "left").select(F.col("rid").alias("node"), F.coalesce("component", "rid").alias("component")))

    smallest = reps.join(parts, reps["rid"] == parts["node"], "left").withColumn("component", F.coalesce("component", "rid"))
    by_component = smallest.groupBy("component").agg(F.min("min_id").alias("component_id"))
    ids = smallest.join(by_component, "component").select(*same, "component_id", "component")
    out = base.select("doc_id", "th", "row", *same).join(ids, same, "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "row").alias("component"))


def similar_links(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links): every link between different sets, and to which set each row belongs.

    ``rows`` has (doc_id, th, n_shingles, set_id, n_links): ``n_links`` counts the other rows that a row links with, copies
    among them; ``set_id`` is null for rows without words. ``links`` has (a, b), a < b, of set ids. Rules and edge cases are
    those of ``similar_components``; set ids differ from run to run.

    All pairs of a bucket whose bit maps leave a link open are verified, which is what a group of near copies that all
    link asks for; where only the groups are wanted, ``similar_components`` does far less.
    """
    index = _indexed(docs, shingle, percent, doc_id, text)
    rows = index.members.select("key", "rid", "n").join(index.texts.select("rid", "small"), "rid")
    pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & index.close("x", "y")).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()
    links = written(index.verified(pairs))
    sizes = index.reps.select("rid", "copies")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(sizes, ends["b"] == sizes["rid"]).groupBy("a").agg(F.sum("copies").alias("others"))
    same = ["n", "s1", "s2"]
    counted = index.reps.join(others, index.reps["rid"] == others["a"], "left").select(*same, F.col("rid").alias("set_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = index.base.join(counted, same, "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "set_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), links
