"""BPE encoding and decoding by batched numpy merge rounds.

Distinct words of a batch lie in one flat array of symbol ids. In each round the pairs of neighbours are looked up
by binary search over the sorted pair keys (left * size + right); in every word the pair of lowest rank is merged
wherever it stands, and words without a known pair are done. The vocabulary is read on the driver from a tokenizer
file whose path is a parameter, and broadcast (about 3 MB for 49,000 entries; its size does not depend on the data).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text

_NEVER = np.int64(1 << 40)
#: Bytes of words, ids and decoded texts remembered per task; beyond it the memory starts anew, results do not change.
MEMORY = 1 << 25
#: Bytes of a word beyond which a round over all words for each of its ranks would take too long.
LONG = 2048
#: Bytes of text that are encoded together: their new words share merge rounds.
BATCH = 1 << 21


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _ranges(points: list[int]) -> str:
    """Inside of a regex class for sorted code points."""
    p = np.array(points)
    cut = np.flatnonzero(np.diff(p) > 1)
    first, last = p[np.r_[0, cut + 1]], p[np.r_[cut, len(p) - 1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


def unicode_rules() -> tuple[str, str, str, dict[int, str], frozenset[str]]:
    """Letters, numbers and white space as regex classes, lower-casing where Python's differs, and odd characters.

    Odd are those that the regex module or Python treats in another way.

    Which code points belong to a class depends on the Unicode version. These are read off the tokenizers library,
    one code point at a time, so that this module follows the version installed beside it.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(map(chr, points[i : i + 20_000])) for i in range(0, len(points), 20_000)]
    classes, differ = [], set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        split = pre_tokenizers.Split(Regex(name), "removed", invert=True)
        own = regex.compile(name.replace(r"\s", r"\p{White_Space}"))
        found = {c for b in blocks for piece, _ in split.pre_tokenize_str(b) for c in piece}
        differ |= found ^ {c for b in blocks for c in own.findall(b)}
        classes.append(_ranges(sorted(map(ord, found))))
    lower = normalizers.Lowercase()
    # Python lower-cases a final sigma by its context; the rule here is by character.
    odd = {c: low for c in points if (low := lower.normalize_str(chr(c))) != chr(c).lower()} | {ord("Σ"): "σ"}
    return (*classes, odd, frozenset(differ | {c for a, b in odd.items() for c in chr(a) + b}))


@dataclass(frozen=True)
class Vocabulary:
    """Tables of a byte-level BPE with an end-of-word suffix, lower-casing and NFC."""

    tokens: list[str]
    inner: np.ndarray  # symbol of a byte inside a word
    final: np.ndarray  # and at its end
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    special: dict[str, int]
    pattern: str
    plain: str  # the same with the regex module's classes
    lower: dict[int, str]
    odd: frozenset[str]  # characters that need ``pattern`` and ``lower``

    @functools.cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and merged symbol of each pair key."""
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))

    @staticmethod
    def read(path: str) -> Vocabulary:
        """Read a tokenizer file (once while it does not change); a kind that this module does not cover is an error."""
        known = os.stat(path)
        return Vocabulary._read(path, known.st_mtime_ns, known.st_size)

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def _read(path: str, changed: int, size: int) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        covered = model["type"] == "BPE" and not model["unk_token"] and not model["fuse_unk"] and not model["ignore_merges"] and not model["continuing_subword_prefix"] and spec["decoder"] is None and spec["post_processor"] is None
        covered &= [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and not steps[1]["use_regex"]
        if not covered:
            raise ValueError(f"{path}: not a lower-casing byte-level BPE with word ends")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max(*ids.values(), *special.values()) + 1)
        for token, i in [*ids.items(), *special.items()]:
            tokens[i] = token
        letters = byte_letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        merged, ranks = np.array([ids[a + b] for a, b in pairs], np.int64), np.arange(len(pairs))
        made = np.full(len(tokens), -1, np.int64)
        made[merged[::-1]] = ranks[::-1]
        if ((made[left] >= ranks) | (made[right] >= ranks)).any():
            raise ValueError(f"{path}: a merge stands before those that make its parts")
        keys = left * len(tokens) + right
        order = np.argsort(keys)
        table = lambda suffix: np.array([ids.get(c + suffix, -1) for c in letters], np.int64)
        letters_, numbers, spaces, lower, odd = unicode_rules()
        plain = steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        pattern = steps[0]["pattern"]["Regex"].replace(r"[\p{L}]", f"[{letters_}]").replace(r"[\p{N}]", f"[{numbers}]").replace(r"\s\p{L}\p{N}", spaces + letters_ + numbers)
        if "\\p" in pattern or "\\s" in pattern:
            raise ValueError(f"{path}: word pattern not covered")
        return Vocabulary(tokens, table(""), table(end), keys[order], ranks[order], merged[order], special, pattern, plain, lower, odd)


def merge_long(sym: list[int], v: Vocabulary) -> list[int]:
    """Token ids of one word's symbols by a heap of its pairs: time n log n, whatever the number of ranks in it.

    The lowest rank merges first, the leftmost place of equal ones, which is what rounds over the whole word do.
    """
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := v.pairs.get(sym[i] * len(v.tokens) + sym[j])):
            heapq.heappush(heap, (found[0], i, found[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        rank, i, merged = heapq.heappop(heap)
        j = after[i]
        if sym[i] < 0 or j >= n or v.pairs.get(sym[i] * len(v.tokens) + sym[j], (-1, 0))[0] != rank:
            continue  # one of the two is no longer what it was
        sym[i], sym[j] = merged, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [s for s in sym if s >= 0]


def encode_words(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """Token ids of each word; those of more than ``LONG`` bytes one by one (``merge_long``)."""
    if any(len(w) > LONG for w in words):
        out = encode_words([b"" if len(w) > LONG else w for w in words], v)
        for i, w in enumerate(words):
            if len(w) > LONG:
                data = np.frombuffer(w, np.uint8)
                sym = v.inner[data]
                sym[-1] = v.final[data[-1]]
                out[i] = np.array(merge_long(sym[sym >= 0].tolist(), v), np.int64)
        return out
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    size = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    sym = v.inner[data]
    ends = np.cumsum(size)
    last = ends[size > 0] - 1
    sym[last] = v.final[data[last]]
    word = np.repeat(np.arange(len(words)), size)
    sym, word = sym[sym >= 0], word[sym >= 0]  # bytes without a symbol are left out
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        rank, at = np.full(len(sym), _NEVER), np.zeros(len(sym), np.int64)
        pair = np.flatnonzero(word[1:] == word[:-1])
        key = sym[pair] * len(v.tokens) + sym[pair + 1]
        found = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        known = v.keys[found] == key
        rank[pair[known]], at[pair[known]] = v.ranks[found[known]], found[known]
        low = np.minimum.reduceat(rank, first)
        done = low == _NEVER
        counts = np.diff(np.r_[first, len(sym)])
        if done.any():
            for f, n in zip(first[done].tolist(), counts[done].tolist(), strict=True):
                out[word[f]] = sym[f : f + n]
        best = np.repeat(low, counts)
        merge = (rank == best) & (best < _NEVER)
        # In a run of overlapping places (a a a) every second one merges, from the left.
        head = merge & ~np.r_[False, merge[:-1]]
        where = np.arange(len(sym))
        merge &= (where - np.maximum.accumulate(np.where(head, where, 0))) % 2 == 0
        sym = np.where(merge, v.merged[at], sym)
        keep = ~np.r_[False, merge[:-1]] & np.repeat(~done, counts)
        sym, word = sym[keep], word[keep]
    return out


class Coder:
    """Encodes and decodes whole texts; words met before are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.exact = regex.compile(vocabulary.pattern)
        # The regex module's own classes are much faster; they hold wherever no code point of another version occurs.
        self.words = regex.compile(vocabulary.plain)
        self.odd = vocabulary.odd
        self.split = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.known: dict[str, tuple[bytes, str]] = {}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens are matched in the raw text and stay whole."""
        parts = self.split.split(text) if self.split and "<" in text else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif part:
                part = unicodedata.normalize("NFC", part)
                if part.isascii() or self.odd.isdisjoint(part):
                    out += self.words.findall(part.lower())
                else:
                    out += self.exact.findall(part.translate(self.v.lower).lower())
        return out

    def learn(self, words: set[str]) -> None:
        """Encode words that are not yet known, in one batch."""
        if self.held > MEMORY:
            self.known.clear()
            self.held = 0
        new = [w for w in words if w not in self.known]
        plain = [w for w in new if w not in self.v.special]
        for w, ids in zip(plain, encode_words([w.encode() for w in plain], self.v), strict=True):
            self.known[w] = (ids.astype("<u4").tobytes(), self.decode(ids))
        for w in new:
            if w in self.v.special:
                ids = np.array([self.v.special[w]])
                self.known[w] = (ids.astype("<u4").tobytes(), self.decode(ids))
        self.held += sum(len(w) + sum(map(len, self.known[w])) + 200 for w in new)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens side by side with a space between, as a vocabulary without decoder rules asks."""
        return " ".join([self.v.tokens[i] for i in ids.tolist()])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids (little-endian 32-bit) and decoded text of each text."""
        pieces = [self.pieces(t) for t in texts]
        self.learn(set().union(*pieces) if pieces else set())
        for words in pieces:
            found = [self.known[w] for w in words]
            yield b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])


#: Columns that encoding adds.
MADE = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")


def _beside(df: DataFrame, keep: list[str], column: str, kind: str | None = None) -> DataFrame:
    """Columns ``keep`` and one more behind them, under a name that none of them can have."""
    value = df[column].cast(kind) if kind else df[column]
    return df.select(*[df[c] for c in keep], value.alias("beside " + "/".join(keep)))


def _rows(vocabulary, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary.value)
        for batch in batches:
            _, off = _text.buffers(batch.column(batch.num_columns - 1))
            for lo, hi in _text.chunks(off, BATCH):
                part = batch.slice(lo, hi - lo)
                coded, sums, decoded = [], [], []
                for raw, text in coder.encode(["" if t is None else t for t in part.column(part.num_columns - 1).to_pylist()]):
                    coded.append(raw)
                    sums.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                size = np.array([len(c) // 4 for c in coded], np.int64)
                columns = [*part.columns[:-1], pa.array(size), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], *MADE[: 4 if ids else 3]])

    return run


def encode_documents(docs: DataFrame, path: str, keep: list[str], text: str = "text", ids: bool = True) -> DataFrame:
    """Columns ``keep`` and (n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text, one row per input row.

    Null and empty texts have no tokens and decode to the empty text. Special tokens in a text are encoded as such.
    A word without a break, however long, is encoded whole. ``path`` names a tokenizer file that only the driver opens.
    Columns not in ``keep`` are ignored; those in it have any names but the ones that are added (an error). A map over
    partitions: nothing is shuffled.
    """
    if clash := {c.lower() for c in keep} & set(MADE):
        raise ValueError(f"columns {sorted(clash)} have names of columns that are added")
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    source = _beside(docs, keep, text, "string")
    fields = [*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return source.mapInArrow(_rows(vocabulary, ids), T.StructType([*fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids]))


def decode_documents(coded: DataFrame, path: str, keep: list[str], ids: str = "ids", into: str = "text") -> DataFrame:
    """Columns ``keep`` and ``into`` (text) from arrays of token ids; a null array gives a null text."""
    vocabulary = coded.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    source = _beside(coded, keep, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary.value)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, np.int64)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], into])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(into, T.StringType())]))
