"""Hashed count features of whole texts, as dense rows for small linear models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text

#: Byte classes of word shapes: lower case (and all outside ASCII), upper case, digits, one for each other byte.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _frequencies(row: np.ndarray, slot: np.ndarray, n: int, dims: int) -> np.ndarray:
    """Square roots of relative frequencies of slots in each row."""
    x = np.bincount(row * dims + slot, minlength=n * dims).reshape(n, dims).astype(np.float32)
    return np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))


def letter_grams(data: np.ndarray, off: np.ndarray, dims: int) -> np.ndarray:
    """Runs of one to three lower-cased bytes of each row."""
    part = _text.LOWER[data[off[0] : off[-1]]].astype(np.uint64)
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    out = np.zeros((n, dims), np.float32)
    code = np.zeros(len(part), np.uint64)
    for k in range(1, 4):
        m = len(part) - k + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(256) + part[k - 1 :]
        inside = row[:m] == row[k - 1 :]
        slot = ((code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(dims)
        out += _frequencies(row[:m][inside], slot[inside].astype(np.int64), n, dims)
    return out


def shapes_and_words(data: np.ndarray, off: np.ndarray, dims: int) -> np.ndarray:
    """Word shapes (Ab!! -> Aa!), pairs of shapes, repeated words, and the words themselves.

    ``dims`` slots: half for words, a quarter each for shapes and their pairs; slot 0 counts words equal to the last.
    """
    w = _text.words(data, off, _text.WORD_NOT_SPACE)
    n, row, quarter = len(off) - 1, w.row, np.uint64(dims // 4)
    raw = _SHAPE[data[off[0] : off[-1]]]
    begins = np.zeros(len(raw) + 1, bool)
    begins[w.starts] = True
    keep = begins[:-1] | np.r_[True, raw[1:] != raw[:-1]] if len(raw) else np.zeros(0, bool)
    at = np.r_[0, np.cumsum(keep)]
    shape = _text.span_hashes(_text.prefix_hashes(raw[keep]), at[w.starts], at[w.ends])
    again = np.r_[False, w.hashes[1:] == w.hashes[:-1]] if len(w.hashes) else np.zeros(0, bool)
    single = np.where(again, 0, 1 + (shape % (quarter - np.uint64(1))).astype(np.int64))
    parts = [_frequencies(row, single, n, int(quarter))]
    pair = _text.grams(shape, 2)
    inside = row[:-1] == row[1:] if len(pair) else np.zeros(0, bool)
    parts.append(_frequencies(row[:-1][inside] if len(pair) else row[:0], (pair[inside] % quarter).astype(np.int64), n, int(quarter)))
    parts.append(_frequencies(row, (w.hashes % np.uint64(dims // 2)).astype(np.int64), n, dims // 2))
    return np.hstack(parts)


def feature_blocks(column: pa.Array, features, dims: int, most: int = 512) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row behind the last, features) for blocks of at most ``most`` rows."""
    data, off = _text.buffers(column)
    for lo, hi in _text.chunks(off):
        for a in range(lo, hi, most):
            b = min(a + most, hi)
            yield a, b, features(data, off[a : b + 1], dims)


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)


def sampled(rows: DataFrame, by: str, most: int, key: str) -> tuple[DataFrame, int]:
    """(about ``most`` rows of each value of ``by``, or all where there are fewer, chosen by hash of ``key``; twice as many rows).

    Used to fit classifiers only; ``by`` must have few values. A key that repeats could add any number of rows: whoever collects
    the sample limits it to the second number.
    """
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    share = F.lit(1.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(share)
    return rows.filter(unit_hash(F.col(key)) < share), 2 * most * max(len(counts), 1)


def bounded_sample(rows: DataFrame, by: str, most: int, key: str) -> DataFrame:
    """``sampled`` rows, limited; for narrow rows, since those of a limit pass through one task."""
    found, bound = sampled(rows, by, most, key)
    return found.limit(bound)


def collect_features(sample: DataFrame, target: str, features, dims: int, bound: int | None = None) -> tuple[np.ndarray, list]:
    """Feature rows (float16 on the way) and targets of a bounded sample with columns (text, target), ``bound`` rows at most.

    Texts become features where they are; the limit sees only these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in feature_blocks(batch.column("text"), features, dims):
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), batch.column(target).slice(a, b - a)], ["x", target])

    kind = dict(sample.dtypes)[target]
    found = sample.select("text", target).mapInArrow(run, f"x binary, {target} {kind}")
    found = (found if bound is None else found.limit(bound)).toPandas()
    x = np.frombuffer(b"".join(found["x"]), np.float16).reshape(-1, dims).astype(np.float32)
    return x, found[target].tolist()


def adam(gradient, parameters: list[np.ndarray], steps: int, rate: float) -> list[np.ndarray]:
    """Full-batch Adam; ``gradient(parameters)`` returns one array per parameter."""
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(parameters, gradient(parameters), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return parameters


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
