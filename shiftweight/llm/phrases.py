"""Phrase collocations from mergeable Misra-Gries summaries.

First pass: each task counts hashes of n-grams in what it reads; the counts are dealt by hash over partitions, and each partition
merges them into a Misra-Gries summary. A summary that holds more counters than its capacity takes the next largest
count off all of them; the sum of what was taken off stays below ``least``, because a summary whose capacity exceeds the mass it
got divided by ``least`` cannot take off more, and a smaller one grows instead. So every n-gram that occurs ``least`` times
survives. The pass runs by length (words, pairs, then three to five words): an n-gram is counted only where the shorter ones in it may
have survived, told by a bit map of fixed size. Second pass: what survived in a summary that took something off is counted
exactly; the counts of summaries that never did are exact already. The texts of the n-grams that are left are then read off
documents of one class each: a class is a hash of the text, and of the classes an n-gram was met in the smallest is its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._store import written

#: Counters of a summary to begin with; one task holds twice as many, or 3 * mass / least if that is more.
CAPACITY = 1 << 22
#: Bits of the map of survivors (8 MB, whatever the data; full it only lets more n-grams through).
MAP_BITS = 26
#: Bits of one block of the map, which one group of rows makes.
_BLOCK_BITS = 16
#: N-grams that a task gathers before it counts them, and counts it holds before it sends them on.
GATHERED, HELD = 1 << 19, 1 << 21
#: Classes of documents.
CLASSES = 1 << 12
#: Parts of a language's phrases among which the best are found first.
PARTS = 64
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_WORD = np.ones(256, bool)
_WORD[[32, 9, *_SEPARATORS]] = False
_SEPARATES = np.zeros(256, bool)
_SEPARATES[list(_SEPARATORS)] = True


@dataclass
class Summary:
    """Misra-Gries counters of one hash partition: ``counts`` are at most ``taken`` too small. Each key has its smallest class."""

    least: int
    capacity: int = CAPACITY

    def __post_init__(self):
        self.keys, self.counts, self.classes, self.taken = *summed(*[np.zeros(0, np.int64)] * 3), 0

    def add(self, keys: np.ndarray, counts: np.ndarray, classes: np.ndarray, taken: int = 0) -> None:
        """Merge another summary, or counts as they are."""
        self.keys, self.counts, self.classes = summed(np.r_[self.keys, keys], np.r_[self.counts, counts], np.r_[self.classes, classes])
        self.taken += taken
        while len(self.keys) > 2 * self.capacity:
            self.trim()

    def trim(self) -> None:
        """Take the largest count beyond the capacity off all counters, or, if that could lose an n-gram, double the capacity."""
        over = len(self.keys) - self.capacity
        if over <= 0:
            return
        off = int(np.partition(self.counts, over - 1)[over - 1])
        if self.taken + off >= self.least:
            self.capacity *= 2
            return
        keep = self.counts > off
        self.keys, self.counts, self.classes, self.taken = self.keys[keep], self.counts[keep] - off, self.classes[keep], self.taken + off

    def survivors(self) -> np.ndarray:
        """Places of all keys that may have occurred ``least`` times."""
        return np.flatnonzero(self.counts + self.taken >= self.least)


def summed(keys: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sums of their counts and their smallest classes."""
    if not len(keys):
        return keys, counts, classes
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first), np.minimum.reduceat(classes[order], first)


def _own(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams in documents of a class."""
    return _text.mix(h.view(np.uint64) + classes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).view(np.int64)


def _in_map(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _slots(h)
    return ((bitmap[a >> 3] >> (a & 7)) & (bitmap[b >> 3] >> (b & 7)) & 1).astype(bool)


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the map for each hash."""
    u = h.view(np.uint64)
    return (u >> np.uint64(64 - MAP_BITS)).astype(np.int64), (u & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)


@dataclass
class Grams:
    """Words of some rows with the piece and the language they stand in."""

    words: _text.Words
    piece: np.ndarray
    lang: np.ndarray
    row: np.ndarray
    classes: np.ndarray
    first: int

    @staticmethod
    def of(data: np.ndarray, off: np.ndarray, lang: np.ndarray, classes: np.ndarray, first: int) -> Grams:
        """``lang`` is a hash and ``classes`` the class of each row; ``first`` is the first row's number in its batch."""
        w = _text.words(data, off, _WORD)
        row = w.row
        ends = np.r_[0, np.cumsum(_SEPARATES[w.data])]
        # Rows are pieces too: the number of rows before is counted along.
        return Grams(w, ends[w.starts] + row, lang[row], row, classes, first)

    def hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of all runs of k words in one piece; the hash tells lengths and languages apart."""
        g = _text.grams(self.words.hashes, k)
        n = len(g)
        at = np.flatnonzero((self.row[:n] == self.row[k - 1 :]) & (self.piece[:n] == self.piece[k - 1 :])) if n else np.zeros(0, np.int64)
        return at, _text.mix(g[at] + self.lang[at] * np.uint64(2 * k + 1)).view(np.int64)

    def phrase(self, at: int, k: int) -> str:
        w = self.words
        return " ".join([w.data[a:b].tobytes().decode() for a, b in zip(w.starts[at : at + k].tolist(), w.ends[at : at + k].tolist(), strict=True)])


def _known_grams(g: Grams, bitmap: np.ndarray | None, upto: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first words, hashes) for k up to ``longest``, of the n-grams whose parts of at most ``upto`` words are in the map.

    Parts of fewer words lie in those of ``upto`` words or in the two that are one word shorter.
    """
    passes = None  # whether the (k - 1)-gram that begins at a word passes
    for k in range(1, longest + 1):
        at, h = g.hashes(k)
        if passes is not None and len(at):
            keep = passes[at] & passes[at + 1]
            at, h = at[keep], h[keep]
        if k <= upto and bitmap is not None:
            keep = _in_map(bitmap, h)
            at, h = at[keep], h[keep]
        passes = np.zeros(len(g.row) + 1, bool)
        passes[at] = True
        yield k, at, h


def _rows(batch: pa.RecordBatch) -> Iterator[Grams]:
    data, off = _text.buffers(batch.column("text"))
    lang, classes = np.asarray(batch.column("h")).view(np.uint64), np.asarray(batch.column("class")).astype(np.int64)
    for lo, hi in _text.chunks(off):
        yield Grams.of(data, off[lo : hi + 1], lang[lo:hi], classes[lo:hi], lo)


def _partial(bitmap, upto: int, lengths: range, longest: int):
    """Per task: (h, v) for each n-gram of these lengths whose parts of ``upto`` words are in the map; v = count * CLASSES + class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value if bitmap is not None else None
        held, waiting, size = summed(*[np.zeros(0, np.int64)] * 3), [], 0

        def settle():
            nonlocal held, waiting, size
            if waiting:
                h, classes = (np.concatenate(x) for x in zip(*waiting, strict=True))
                new = summed(h, np.ones(len(h), np.int64), classes)
                held = summed(*(np.r_[x, y] for x, y in zip(held, new, strict=True)))
            waiting, size = [], 0

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1] * CLASSES + held[2])], ["h", "v"])

        for batch in batches:
            for g in _rows(batch):
                for k, at, h in _known_grams(g, known, upto, longest):
                    if k in lengths:
                        waiting.append((h, g.classes[g.row[at]]))
                        size += len(h)
                if size > GATHERED:
                    settle()
                if len(held[0]) > HELD:
                    yield send()
                    held = summed(*[np.zeros(0, np.int64)] * 3)
        settle()
        yield send()

    return run


def _merge(least: int, capacity: int):
    """Per hash partition: the summary of all counts, and of it (h, c, taken, class) of the n-grams that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, waiting, size = Summary(least, capacity), [], 0

        def settle():
            nonlocal waiting, size
            if waiting:
                h, v = (np.concatenate(x) for x in zip(*waiting, strict=True))
                summary.add(h, v // CLASSES, v % CLASSES)
            waiting, size = [], 0

        for batch in batches:
            waiting.append((np.asarray(batch.column("h")), np.asarray(batch.column("v"))))
            size += batch.num_rows
            if size > max(GATHERED, len(summary.keys)):
                settle()
        settle()
        at = summary.survivors()
        yield pa.RecordBatch.from_arrays([pa.array(summary.keys[at]), pa.array(summary.counts[at]), pa.array(np.full(len(at), summary.taken)), pa.array(summary.classes[at].astype(np.int32))], ["h", "c", "taken", "class"])

    return run


def _own_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_own(np.asarray(batch.column("h")), np.asarray(batch.column("class"))))], ["h"])


def _bitmap(rows: DataFrame) -> np.ndarray:
    """Bit map of hashes (h); tasks make blocks of it, and 8 MB reach the driver at most."""
    mask = F.lit((1 << MAP_BITS) - 1)
    slot = F.explode(F.array(F.shiftrightunsigned("h", 64 - MAP_BITS), F.col("h").bitwiseAND(mask)))
    low = (F.col("slot").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1))).cast("int")
    blocks = rows.select(slot.alias("slot")).distinct().groupBy(F.shiftright("slot", _BLOCK_BITS).cast("int").alias("block")).agg(F.collect_list(low).alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for bits in batch.column("bits"):
                on = np.zeros(1 << _BLOCK_BITS, bool)
                on[np.asarray(bits.values)] = True
                packed.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed, pa.binary())], ["block", "bits"])

    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    size = (1 << _BLOCK_BITS) // 8
    for r in blocks.mapInArrow(pack, "block int, bits binary").toLocalIterator():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _texts(bitmap, longest: int):
    """Per task: (lang, k, phrase, h, n) of n-grams in documents of their own class; k = 0 has the number n of all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value
        found: dict[int, tuple[str, int, str]] = {}
        words: dict[str, int] = {}

        def send() -> pa.RecordBatch:
            rows = [*((lang, k, phrase, h, 0) for h, (lang, k, phrase) in found.items()), *((lang, 0, "", 0, n) for lang, n in words.items())]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "k", "phrase", "h", "n"])

        for batch in batches:
            names = batch.column("lang").to_pylist()
            for g in _rows(batch):
                for i, n in enumerate(g.words.counts.tolist()):
                    words[names[g.first + i]] = words.get(names[g.first + i], 0) + n
                for k in range(1, longest + 1):
                    at, h = g.hashes(k)
                    own = np.flatnonzero(_in_map(known, _own(h, g.classes[g.row[at]])))
                    for j, key in zip(own.tolist(), h[own].tolist(), strict=True):
                        if key not in found:
                            found[key] = (names[g.first + int(g.row[at[j]])], k, g.phrase(int(at[j]), k))
                if len(found) > HELD // 8 or len(words) > HELD // 8:
                    yield send()
                    found, words = {}, {}
        yield send()

    return run


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 5, least: int = 100, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, f), (lang, n)): the phrases of up to ``longest`` words that occur ``least`` times in a language, and its words.

    Counts are exact and cover all contiguous occurrences within pieces of all texts. N-grams are told apart by 64-bit hashes.
    """
    if not 0 < least < 1 << 31 or longest < 1:
        raise ValueError("least and longest must be positive")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    rows = rows.withColumns({"h": F.xxhash64("lang"), "class": F.pmod(F.xxhash64("text"), F.lit(CLASSES)).cast("int")})
    bounds = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"] // 2 + 1  # words, at two bytes each
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    survivors, shared = None, None

    def share(hashes: DataFrame):
        nonlocal shared
        if shared is not None:
            shared.unpersist()
        shared = spark.sparkContext.broadcast(_bitmap(hashes))
        return shared

    counted = lambda upto, lengths: rows.select("text", "h", "class").mapInArrow(_partial(shared, upto, lengths, lengths[-1]), "h bigint, v bigint")
    for lengths in [r for r in (range(1, 2), range(2, 3), range(3, longest + 1)) if r and r[0] <= longest]:
        # Partitions whose mass over ``least`` is expected to fit the capacity; beside that as many as any shuffle has.
        parts = max(spread, -(-bounds * len(lengths) // (least * capacity)))
        found = written(counted(lengths[0] - 1, lengths).repartition(parts, "h").mapInArrow(_merge(least, capacity), "h bigint, c bigint, taken bigint, class int"))
        survivors = found if survivors is None else survivors.unionByName(found)
        share(survivors.select("h"))
    exact = survivors.filter("taken = 0").select("h", F.col("c").alias("f"), "class")
    again = survivors.filter("taken > 0")
    if not again.isEmpty():
        sums = counted(longest, range(1, longest + 1)).groupBy("h").agg(F.sum(F.floor(F.col("v") / CLASSES)).alias("f"))
        exact = exact.unionByName(again.select("h", "class").join(sums, "h").filter(F.col("f") >= least).select("h", "f", "class"))
    exact = written(exact)
    share(exact.select("h", "class").mapInArrow(_own_hashes, "h bigint"))
    texts = written(rows.mapInArrow(_texts(shared, longest), "lang string, k int, phrase string, h bigint, n bigint"))
    phrases = texts.filter("k > 0").select("lang", "k", "phrase", "h").distinct().join(exact.select("h", "f"), "h").select("lang", "k", "phrase", "f")
    return written(phrases), texts.filter("k = 0").groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 5, least: int = 100, best: int = 2000, capacity: int = CAPACITY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of two words or more of each language.

    Words of lower-cased (A-Z) texts are runs of characters but space and tab, in the pieces between ``.,;:!?`` and line breaks. A phrase
    that occurs a times among n words is cut in two, with l and r occurrences of the parts; its score is floor(1000 a n / (l r))
    at the cut that makes it lowest (the first of these). A phrase goes if a longer one that holds it occurs as often.
    Ranks are by score, then a (both falling), then the phrase's bytes. A null lang is ``und``; null and empty texts have no
    words; repeated rows count again; other columns are ignored; an empty table gives no rows.

    Scale: see the module; of the n-grams only those that may be frequent are shuffled in the second pass. The frequent
    phrases (mass / least at most) are joined with their parts by shuffles, and the best of a language are found in parts first.
    """
    counted, words = frequent_phrases(docs, lang, text, longest, least, capacity)
    candidates = counted.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = candidates.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("x"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("y"))
    of = lambda name, count: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = cuts.join(of("x", "l"), ["lang", "x"]).join(of("y", "r"), ["lang", "y"]).join(words, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    # Whole numbers of up to 38 digits; ``div`` is exact.
    scored = scored.withColumns({"top": (whole("a") * whole("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), "bottom": (whole("l") * whole("r")).cast("decimal(38,0)")})
    scored = scored.withColumn("score", F.expr("cast(top as decimal(38,0)) div bottom"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")))))
    around = candidates.filter("k > 2").select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer", "cut")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
