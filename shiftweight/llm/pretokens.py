"""Encoding with a byte-level BPE tokenizer file, words cut and looked up in numpy.

The cut of such files is a rule over classes of characters (letters, numbers, white space, others), so it is done on
whole arrays of code points. Each distinct word is encoded once a task by the tokenizers library; the ids of
a text are then gathered by the hashes of its words. Memory is bounded: beyond ``MEMORY`` ids the known words start anew.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _text

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Ids of known words held by a task.
MEMORY = 1 << 22
#: Slots of the table that is asked first; words it misses are searched among all known ones.
SLOTS = 1 << 18
#: Words that the library encodes in one call; what it returns takes about a kilobyte for each.
CALL = 4096
#: Bytes of text that are worked on together (a longer text is one piece).
BATCH = 1 << 20


@functools.lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point, read off the installed tokenizers library so that its Unicode version holds."""
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(map(chr, points[i : i + 20_000])) for i in range(0, len(points), 20_000)]
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        split = pre_tokenizers.Split(Regex(name), "removed", invert=True)
        for block in blocks:
            found = "".join(piece for piece, _ in split.pre_tokenize_str(block))
            out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def read_tokenizer(path: str) -> str:
    """The text of a tokenizer file; a kind whose words this module does not cut is an error."""
    with open(path, encoding="utf-8") as file:
        raw = file.read()
    spec = json.loads(raw)
    cut, model = spec["pre_tokenizer"], spec["model"]
    if not (model["type"] == "BPE" and spec["normalizer"] is None and spec["post_processor"] is None and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]):
        raise ValueError(f"{path}: not a byte-level BPE without normalisation")
    # Truncation and padding are not part of what a text is encoded as.
    return json.dumps(spec | {"truncation": None, "padding": None})


def vocabulary_size(raw: str) -> int:
    spec = json.loads(raw)
    return 1 + max(*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]])


def word_starts(points: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words begin in the code points of some texts; text i is ``bounds[i]:bounds[i + 1]``.

    A word is a run of letters, of numbers or of others, with one space before it if there is one; of white space before a
    word all but the last character is one word, and so is that character if it is no space; white space at the end of a text
    is one word. An apostrophe that begins a word takes s, t, m, d, re, ve or ll behind it along.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[points]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = edge[:-1].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(starts)
    end = np.r_[begin[1:], n]
    blank = (kind[begin] == SPACE) & ~edge[end]
    last = end[blank] - 1
    starts[last] = True
    starts[end[blank][points[last] == 32]] = False
    quote = begin[(points[begin] == 39) & (end - begin == 1) & ~edge[end]]
    quote = quote[starts[quote]]
    one = points[quote + 1]
    two = np.where(edge[np.minimum(quote + 2, n)], 0, points[np.minimum(quote + 2, n - 1)])
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))), 2, 0))
    quote, size = quote[size > 0], size[size > 0]
    starts[quote + 1] = False
    behind = quote + 1 + size
    behind = behind[~edge[behind]]
    starts[behind] = True
    return np.flatnonzero(starts)


def _put(values: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``values`` with ``more`` from place n on; room is doubled when it runs out."""
    if n + len(more) > len(values):
        values = np.r_[values[:n], np.zeros(n + 2 * len(more), values.dtype)]
    values[n : n + len(more)] = more
    return values


class Encoder:
    """Encodes whole texts as the tokenizers library does with ``add_special_tokens=False``."""

    def __init__(self, raw: str, classes: np.ndarray):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(raw)
        self.special = [t["content"] for t in json.loads(raw)["added_tokens"]]
        self.classes = classes
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.words, self.held = 0, 0
        self.flat, self.first, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.slot_key, self.slot_word = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)

    def _words(self, h: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word among the known ones; new words are encoded by the library."""
        if self.held > MEMORY:
            self._forget()
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        word = self.slot_word[slot]
        word[self.slot_key[slot] != h] = -1
        missed = np.flatnonzero(word < 0)
        if len(missed):
            keys, at, back = np.unique(h[missed], return_index=True, return_inverse=True)
            found = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            known = self.keys[found] == keys if len(self.keys) else np.zeros(len(keys), bool)
            number = np.empty(len(keys), np.int32)
            if known.any():
                number[known] = self.place[found[known]]
            new = np.flatnonzero(~known)
            if len(new):
                where = missed[at[new]]
                texts = [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
                ids = [e.ids for i in range(0, len(texts), CALL) for e in self.tokenizer.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False)]
                size = np.array([len(i) for i in ids], np.int64)
                number[new] = self.words + np.arange(len(new))
                self.first = _put(self.first, self.words, self.held + np.cumsum(size) - size)
                self.size = _put(self.size, self.words, size)
                self.flat = _put(self.flat, self.held, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum())))
                self.words, self.held = self.words + len(new), self.held + int(size.sum())
                at = np.searchsorted(self.keys, keys[new])
                self.keys, self.place = np.insert(self.keys, at, keys[new]), np.insert(self.place, at, number[new])
            word[missed] = number[back]
            self.slot_key[slot[missed]], self.slot_word[slot[missed]] = h[missed], word[missed]
        return word

    def encode(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one text after the other, number of ids of each); ``bounds`` are byte offsets into ``raw``."""
        text = raw.decode()
        if any(s in text for s in self.special):
            rows = [raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            parts = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) if any(s in t for s in self.special) else self.encode(t.encode(), np.array([0, len(t.encode())]))[0] for t in rows]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) == len(raw):
            rows = bounds
        else:  # bytes that begin a character, up to each bound
            lead = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
            rows = lead[bounds]
        starts = word_starts(points, rows, self.classes)
        ends = np.r_[starts[1:], len(points)].astype(np.int64)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(rows) - 1, np.int64)
        word = self._words(_text.span_hashes(_text.prefix_hashes(points), starts, ends), points, starts, ends)
        size = self.size[word]
        done = np.r_[0, np.cumsum(size)]
        ids = self.flat[np.repeat(self.first[word] - done[:-1], size) + np.arange(done[-1])]
        return ids, np.diff(done[np.searchsorted(starts, rows)])

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row behind the last, ids, number of ids of each row) in pieces; null counts as the empty text."""
        data, off = _text.buffers(column)
        for lo, hi in _text.chunks(off, BATCH):
            yield lo, hi, *self.encode(data[off[lo] : off[hi]].tobytes(), off[lo : hi + 1] - off[lo])



_encoders: dict[str, Encoder] = {}


def encoder(raw: str, classes: np.ndarray) -> Encoder:
    """The encoder of this worker process for a tokenizer file; what it knows stays for the tasks that follow."""
    if raw not in _encoders:
        _encoders.clear()
        _encoders[raw] = Encoder(raw, classes)
    return _encoders[raw]
