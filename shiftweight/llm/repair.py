"""Files of token ids under a Re-Pair grammar, with random access.

Ids are cut into shards of a fixed number. In each shard frequent pairs of neighbouring ids are replaced by
nonterminals, and again pairs of what that gives, for some rounds; the rules and the number of ids that each nonterminal
expands to are stored with what is left of the shard. A range of ids is read by the running sum of those numbers: only the symbols
that cover it are expanded.

A file (all numbers little-endian) is: ``RPAIRID1``; the shards; an Arrow stream with one row per document (doc_id in its own
type, first id counted from the file's beginning, number of ids); an Arrow stream with one row per shard (first id,
number of ids, byte where it stands, rules, symbols); then three 64-bit numbers, the bytes where these two streams begin and the
size of the vocabulary, and ``RPAIRID1`` again. A shard is its rules (two symbols each), expansion lengths (32 bits each) and
symbols. A symbol below the vocabulary's size is an id, the others are rules in order. Symbols have 16 bits where these
are enough (and then no more rules are made than fit), else 32.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from ._store import shared_folder, written

MAGIC = b"RPAIRID1"
#: Ids of a shard, and ids after which a file ends with the next document.
SHARD_IDS, FILE_IDS = 1 << 20, 1 << 25
#: Rounds of replacement, pairs looked at in one, times that a pair must occur, times that a rule must be used.
ROUNDS, PAIRS, LEAST, USES = 5, 4096, 8, 4
#: Bytes of text for each range of doc_ids that one task writes.
TASK_BYTES = 128 << 20
#: Slots of the table in which pairs are looked up.
_SLOTS = 1 << 16


def _symbol_type(vocabulary: int) -> type:
    """Width of a symbol: 16 bits if half as many rules as there are frequent pairs fit beside the vocabulary."""
    return np.uint16 if vocabulary + PAIRS // 2 <= 1 << 16 else np.uint32


def _slot(pairs: np.ndarray) -> np.ndarray:
    folded = pairs.astype(np.uint32) if pairs.dtype == np.uint32 else (pairs ^ (pairs >> np.uint64(27))).astype(np.uint32)
    return (folded * np.uint32(0x9E3779B1)) >> np.uint32(16)


@dataclass(frozen=True)
class Shard:
    """``rules`` are (left, right) symbols, ``lengths`` the ids each rule expands to."""

    vocabulary: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of some symbols: all rules at once, one level of the grammar after the other."""
        s = symbols.astype(np.uint32)
        while True:
            rule = np.flatnonzero(s >= self.vocabulary)
            if not len(rule):
                return s
            size = np.ones(len(s), np.int8)
            size[rule] = 2
            pair = self.rules[s[rule] - np.uint32(self.vocabulary)]
            at = rule + np.arange(len(rule))  # where the first symbol of each pair goes
            s = np.repeat(s, size)
            s[at], s[at + 1] = pair[:, 0], pair[:, 1]

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the shard; only the symbols that cover them are expanded."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        size = np.ones(len(self.symbols), np.int64)
        rule = self.symbols >= self.vocabulary
        size[rule] = self.lengths[self.symbols[rule].astype(np.int64) - self.vocabulary]
        end = np.cumsum(size)
        a, b = int(np.searchsorted(end, start, "right")), int(np.searchsorted(end, stop, "left")) + 1
        before = int(end[a] - size[a])
        return self.expand(self.symbols[a:b])[start - before : stop - before]

    def tobytes(self) -> bytes:
        kind = np.dtype(_symbol_type(self.vocabulary)).newbyteorder("<")
        return self.rules.astype(kind).tobytes() + self.lengths.astype("<u4").tobytes() + self.symbols.astype(kind).tobytes()

    @staticmethod
    def frombytes(raw: bytes, vocabulary: int, rules: int, symbols: int) -> Shard:
        kind = np.dtype(_symbol_type(vocabulary)).newbyteorder("<")
        a, b = 2 * rules * kind.itemsize, 4 * rules
        if len(raw) != a + b + symbols * kind.itemsize:
            raise ValueError("a shard does not have the length that its file tells")
        return Shard(vocabulary, np.frombuffer(raw[:a], kind).reshape(-1, 2).astype(np.int64), np.frombuffer(raw[a : a + b], "<u4").astype(np.int64), np.frombuffer(raw[a + b :], kind))


def _chosen(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` are replaced: no two overlap, the better ranked of two neighbours wins, of a run (a a a) every second."""
    wins = np.ones(len(at), bool)
    beside = at[1:] == at[:-1] + 1
    wins[1:] &= ~(beside & (rank[1:] > rank[:-1]))
    wins[:-1] &= ~(beside & (rank[:-1] > rank[1:]))
    at, rank = at[wins], rank[wins]
    runs = np.r_[False, at[1:] == at[:-1] + 1]  # of equal ranks, since the others of two neighbours are gone
    if runs.any():
        where = np.arange(len(at))
        odd = (where - np.maximum.accumulate(np.where(runs, 0, where))) % 2 == 1
        wins[np.flatnonzero(wins)[odd]] = False
    return wins


def compress(ids: np.ndarray, vocabulary: int, rounds: int = ROUNDS) -> Shard:
    """Grammar of some ids, all below ``vocabulary``.

    Each round counts all pairs of neighbours, ranks the ``PAIRS`` most frequent ones that occur ``LEAST`` times, and replaces
    them at once where they do not overlap a better one; pairs that are then replaced less than ``USES`` times make no rule.
    """
    narrow = _symbol_type(vocabulary) is np.uint16
    kind, shift = (np.uint32, 16) if narrow else (np.uint64, 32)
    room = (1 << 16) - vocabulary if narrow else 1 << 24
    s = ids.astype(np.uint16 if narrow else np.uint32)
    rules, lengths = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    for _ in range(rounds):
        if len(s) < 2 or len(rules) >= room:
            break
        key = (s[:-1].astype(kind) << kind(shift)) | s[1:].astype(kind)
        ordered = np.sort(key)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        count = np.diff(np.r_[first, len(ordered)])
        often = np.flatnonzero(count >= LEAST)
        if not len(often):
            break
        best = often[np.argsort(-count[often], kind="stable")][: min(PAIRS, room - len(rules))]
        pairs = ordered[first[best]]
        # A table with one pair a slot, the most frequent one; a pair without a slot waits for a later round.
        held, rank_of = np.zeros(_SLOTS, kind), np.zeros(_SLOTS, np.int32)
        slot = _slot(pairs[::-1])
        held[slot], rank_of[slot] = pairs[::-1], np.arange(len(pairs), dtype=np.int32)[::-1]
        if not held[0] and 0 not in pairs:
            held[0] = 1  # empty slots look like the pair (0, 0), whose slot is the first
        slot = _slot(key)
        at = np.flatnonzero(np.take(held, slot) == key)
        rank = np.take(rank_of, slot[at])
        wins = _chosen(at, rank)
        chosen, rank = at[wins], rank[wins]
        used = np.bincount(rank, minlength=len(pairs))
        kept = np.flatnonzero(used >= USES)
        if not len(kept):
            break
        number = np.full(len(pairs), -1, np.int64)
        number[kept] = vocabulary + len(rules) + np.arange(len(kept))
        new = number[rank]
        chosen, new = chosen[new >= 0], new[new >= 0]
        made = np.stack([pairs[kept] >> kind(shift), pairs[kept] & kind((1 << shift) - 1)], axis=1).astype(np.int64)
        size = np.r_[np.ones(vocabulary, np.int64), lengths]
        rules, lengths = np.vstack([rules, made]), np.r_[lengths, size[made].sum(axis=1)]
        s[chosen] = new
        stays = np.ones(len(s), bool)
        stays[chosen + 1] = False
        s = s[stays]
    return Shard(vocabulary, rules, lengths, s)


class Writer:
    """Writes one file after the other into a folder; memory holds a shard and the list of a file's documents."""

    def __init__(self, folder: str, name: str, vocabulary: int):
        self.fs, self.base = pa.fs.FileSystem.from_uri(folder)
        self.name, self.vocabulary, self.number = name, vocabulary, 0
        self.out = None

    def _open(self) -> None:
        self.temporary = f"{self.base}/_{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.at, self.ids, self.held, self.waiting = len(MAGIC), 0, 0, []
        self.shards, self.doc_ids, self.sizes = [], [], []

    def _shard(self, ids: np.ndarray) -> None:
        shard = compress(ids, self.vocabulary)
        raw = shard.tobytes()
        self.out.write(raw)
        self.shards.append((self.ids, len(ids), self.at, len(shard.rules), len(shard.symbols)))
        self.at, self.ids = self.at + len(raw), self.ids + len(ids)

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> Iterator[dict]:
        """Whole documents, one after the other; yields what is known of a file that is full."""
        if self.out is None:
            self._open()
        self.doc_ids.append(doc_ids)
        self.sizes.append(sizes)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= SHARD_IDS:
            whole = np.concatenate(self.waiting)
            full = len(whole) // SHARD_IDS * SHARD_IDS
            for a in range(0, full, SHARD_IDS):
                self._shard(whole[a : a + SHARD_IDS])
            self.waiting, self.held = [whole[full:]], len(whole) - full
        if self.ids >= FILE_IDS:
            yield self.close()

    def close(self) -> dict:
        if self.held:
            self._shard(np.concatenate(self.waiting))
        sizes = np.concatenate(self.sizes)
        doc_ids = pa.concat_arrays(self.doc_ids)
        columns = zip(*self.shards, strict=True) if self.shards else [[]] * 5
        tables = [
            pa.table([doc_ids, pa.array(np.cumsum(sizes) - sizes), pa.array(sizes)], ["doc_id", "start", "n_tokens"]),
            pa.table([pa.array(c, pa.int64()) for c in columns], ["start", "n_ids", "at", "rules", "symbols"]),
        ]
        places = []
        for t in tables:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as stream:
                stream.write_table(t)
            raw = sink.getvalue()
            places.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.out.write(struct.pack("<qqq", *places, self.vocabulary) + MAGIC)
        self.out.close()
        name = f"{self.name}-{self.number:05d}.rpair"
        self.fs.move(self.temporary, f"{self.base}/{name}")
        self.out, self.number = None, self.number + 1
        return {"seq": self.number - 1, "file": name, "docs": len(sizes), "ids": int(sizes.sum()), "bytes": self.at + 24 + len(MAGIC)}


class Reader:
    """Random access to one file: ``ids(start, stop)`` and ``document(i)``; a file cut short or damaged is an error."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = self._bytes(max(size - 32, 0), size)
        if size < len(MAGIC) + 32 or tail[-8:] != MAGIC or self._bytes(0, 8) != MAGIC:
            raise ValueError("not a file of token ids, or cut short")
        docs, shards, self.vocabulary = struct.unpack("<qqq", tail[:24])
        table = lambda a, b: pa.ipc.open_stream(self._bytes(a, b)).read_all()
        self.documents = table(docs, shards)
        self.shards = [tuple(r.values()) for r in table(shards, size - 32).to_pylist()]
        self.ends = [at for _, _, at, _, _ in self.shards[1:]] + [docs]
        self.first = np.array([s[0] for s in self.shards], np.int64)
        self.starts, self.sizes = (np.asarray(self.documents.column(c)) for c in ("start", "n_tokens"))

    def _bytes(self, a: int, b: int) -> bytes:
        self.file.seek(a)
        return self.file.read(b - a)

    def shard(self, k: int) -> Shard:
        _, n, at, rules, symbols = self.shards[k]
        return Shard.frombytes(self._bytes(at, self.ends[k]), self.vocabulary, rules, symbols)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1, counted from the file's beginning."""
        parts = [np.zeros(0, np.uint32)]
        k = int(np.searchsorted(self.first, start, "right")) - 1
        while start < stop and k < len(self.shards):
            first, n = self.shards[k][:2]
            parts.append(self.shard(k).read(start - first, min(stop - first, n)))
            start, k = first + n, k + 1
        return np.concatenate(parts)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i] + self.sizes[i]))

    def all_documents(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(first, behind the last, their ids) for runs of documents; each shard is read and expanded once."""
        ends = self.starts + self.sizes
        done, waiting = 0, []
        for k, (first, n, *_) in enumerate(self.shards):
            shard = self.shard(k)
            ids = shard.expand(shard.symbols)
            if len(ids) != n:
                raise ValueError(f"shard {k} has {len(ids)} ids instead of {n}")
            upto = int(np.searchsorted(ends, first + n, "right"))
            cuts = ends[done:upto] - first
            pieces = np.split(ids, cuts)
            if upto > done:
                pieces[0] = np.concatenate([*waiting, pieces[0]])
                yield done, upto, pieces[:-1]
                waiting, done = [pieces[-1]], upto
            else:  # a document longer than the shard
                waiting.append(ids)
        if done < len(ends):
            raise ValueError("ids of the last documents are missing")


def _write(folder: str, raw, classes, vocabulary: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        writer = Writer(folder, f"part-{part:07d}-{task.taskAttemptId():09d}", vocabulary)
        encoder = pretokens.encoder(raw.value, classes.value)
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
        row = lambda known: pa.RecordBatch.from_pylist([{"part": part, **known}], schema)
        for batch in batches:
            for lo, hi, ids, sizes in encoder.encode_column(batch.column("text")):
                whole = np.insert(ids, np.cumsum(sizes), end_id)  # the end of each document
                for known in writer.add(batch.column("doc_id").slice(lo, hi - lo), sizes + 1, whole):
                    yield row(known)
        if writer.out is not None:
            yield row(writer.close())

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Encode every whole text, put ``end_id`` behind each, and write the ids to files in ascending doc_id order.

    Returns a table of the files: (part, seq, file, docs, ids, bytes, start), ``start`` being the number of ids before
    the file. Null doc_ids come first; rows that repeat a doc_id stand next to each other in any order. Null and empty texts have
    the end id alone. No rows make no file. ``path`` names a tokenizer file that only the driver opens; tasks get its
    content and one byte per code point. Other columns are ignored, whatever their names.

    Scale: texts are shuffled once, into ranges of doc_id of about ``TASK_BYTES``; a doc_id that repeats without end is dealt
    over ranges by the place of its rows. A task holds a shard and its known words. The driver sees one number per range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("place", F.monotonically_increasing_id())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    parts = max(1, -(-(size["bytes"] + 64 * size["n"]) // TASK_BYTES))
    raw = pretokens.read_tokenizer(path)
    vocabulary = max(pretokens.vocabulary_size(raw), end_id + 1)
    fs, base = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    share = spark.sparkContext.broadcast
    files = written(ranges.mapInArrow(_write(folder, share(raw), share(pretokens.character_classes()), vocabulary, end_id), "part int, seq int, file string, docs bigint, ids bigint, bytes bigint"))
    before, starts = 0, []
    for r in files.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect():  # a number for each range
        starts.append((r.part, before))
        before += r.ids
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("ids").over(inside), F.lit(0))
    return files.join(F.broadcast(spark.createDataFrame(starts, "part int, before bigint")), "part").withColumn("start", first).drop("before")


def read_token_files(files: DataFrame, folder: str, id_type: T.DataType, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of the listed files (file, start).

    ``start`` counts the ids of all documents before it; the checksum is taken over ids as little-endian unsigned 32-bit numbers,
    which is also what ``ids`` holds as bytes. Files are dealt over tasks, one is opened at a time and expanded shard by shard.
    """
    fields = [T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as file:
                    try:
                        reader = Reader(file)
                        for lo, hi, found in reader.all_documents():
                            raw = [x.astype("<u4").tobytes() for x in found]
                            doc_ids = reader.documents.column("doc_id").slice(lo, hi - lo).combine_chunks()
                            columns = [doc_ids, pa.array(start + reader.starts[lo:hi]), pa.array(reader.sizes[lo:hi]), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if ids else [])], ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])
                    except ValueError as e:
                        raise ValueError(f"{base}/{name}: {e}") from e

    schema = T.StructType([*fields, *[T.StructField("ids", T.BinaryType())] * ids])
    return files.select("file", "start").repartition(max(1, min(files.count(), 1 << 15)), "file").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Write all documents to files in the shared folder and read them back (see the two functions above)."""
    folder = shared_folder(docs.sparkSession)
    files = write_token_files(docs, folder, path, doc_id, text)
    return read_token_files(files, folder, docs.schema[doc_id].dataType, ids)
