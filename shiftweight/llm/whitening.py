"""Whitening of embeddings by principal components, refined from 32-bit eigenvectors.

Vectors become whole numbers first, so sums over the table are exact whatever the order of tasks: the covariance is
taken over vectors shifted by the whole number nearest to their mean, and what is left of the mean (half a unit at most) is put right
in whole numbers too. Its eigenvectors are computed in 32 bits and then corrected by Ogita and Aishima's iteration,
which consists of matrix products in extended precision and doubles the number of right digits each time.
Eigenvalues that lie too close for the iteration to tell apart are solved as a small problem of their own, in the
space of their vectors, and then take part again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Higher precision of the refinement (80 bits where the machine has them).
HIGH = np.longdouble
#: Whole number of an entry c: floor(SCALE * c) + SHIFT. Entries of LARGEST and more count as not finite.
SCALE, SHIFT, LARGEST = 1024.0, 100_000, float(1 << 38)
#: Components whose variance is below this part of the largest have none.
NO_VARIANCE = 1e-15
#: Tasks in which sums of tasks are merged before the driver sees them.
MERGES = 8
#: Bits of each of the four parts that a whole number is sent in.
_BITS, _PARTS = 40, 4
#: Rows that are multiplied at a time: products of entries below 2^20 then add up without rounding.
_ROWS = 4096


def whole_vectors(column: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows whose vector has ``size`` finite entries, and these as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    rows = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(rows)).flatten()
    c = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan)).reshape(len(rows), size)
    with np.errstate(invalid="ignore"):
        good = (np.abs(c) < LARGEST).all(axis=1)
    return rows[good], np.floor(SCALE * c[good]).astype(np.int64) + SHIFT


def _split(values) -> np.ndarray:
    """Whole numbers of up to 180 bits as rows of 64 bits."""
    out, v = [], [int(i) for i in values]
    for _ in range(_PARTS - 1):
        out.append([i & ((1 << _BITS) - 1) for i in v])
        v = [i >> _BITS for i in v]
    return np.array([*out, v], np.int64)


def _joined(row: list[int]) -> np.ndarray:
    parts = np.array(row, object).reshape(_PARTS, -1)
    return sum((parts[k] << (_BITS * k) for k in range(1, _PARTS)), parts[0])


def _exact_sums(df: DataFrame, vector: str, size: int, sums) -> list[int]:
    """Sums over all usable vectors of the whole numbers that ``sums(x)`` returns, exact whatever the tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            _, x = whole_vectors(batch.column(0), size)
            for a in range(0, len(x), _ROWS):
                new = sums(x[a : a + _ROWS])
                held = new if held is None else held + new
        yield from _as_row(None if held is None else _split(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in batch.column(0):
                new = _joined(row.as_py())
                held = new if held is None else held + new
        yield from _as_row(None if held is None else _split(held))

    rows = df.select(vector).mapInArrow(part, "x array<bigint>").repartition(MERGES).mapInArrow(merge, "x array<bigint>").collect()
    found = [_joined(r.x) for r in rows]
    return list(sum(found[1:], found[0])) if found else []


def _as_row(values: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    rows = [] if values is None else [values.ravel().tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["x"])


def _products(y: np.ndarray) -> np.ndarray:
    """Sum of the products of each row with itself, exact: in doubles where these hold all sums, else in whole numbers."""
    largest = int(np.abs(y).max()) if y.size else 0
    if largest < 1 << 20:  # _ROWS products below 2^40
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object).ravel()
    z = y.astype(object)
    return (z.T @ z).ravel()


def covariance(n: int, sums: list[int], products: list[int], shift: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) from exact sums of products of vectors shifted by ``shift``, rounded once."""
    size = len(sums)
    left = [s - n * int(m) for s, m in zip(sums, shift, strict=True)]
    exact = np.array(products, object).reshape(size, size) * n - np.outer(np.array(left, object), np.array(left, object))
    high, low = exact // (1 << 40), exact % (1 << 40)
    return (high.astype(HIGH) * HIGH(2.0**40) + low.astype(HIGH)) / HIGH(n) / HIGH(n)


def _clusters(values: np.ndarray, distance) -> list[np.ndarray]:
    """Runs of sorted eigenvalues whose neighbours are no further apart than ``distance``."""
    order = np.argsort(-values)
    cut = np.flatnonzero(values[order][:-1] - values[order][1:] > distance) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, HIGH]:
    """One step of the iteration: better vectors, their eigenvalues, and how far apart eigenvalues must be to be told apart."""
    ax = a @ x
    r = np.eye(len(x), dtype=HIGH) - x.T @ x
    s = x.T @ ax
    r, s = (r + r.T) / 2, (s + s.T) / 2  # their rounding, divided by small gaps, would bend right angles
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    # Frobenius norms bound the spectral ones from above.
    apart = 2 * (np.sqrt((off * off).sum()) + np.abs(values).max() * np.sqrt((r * r).sum()))
    apart = max(apart, 2 * len(x) * np.finfo(HIGH).eps * np.abs(values).max())  # below this a difference is rounding
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= apart
    e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
    return x + x @ e, values, apart


def eigenvectors(a: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as columns) of a symmetric matrix, to double precision or better.

    Starts from 32-bit eigenvectors. Where eigenvalues are too close to be told apart, the matrix restricted to the
    space of their vectors, less their mean, is solved alone: its entries are small, so its own 32-bit solution tells them apart
    by a factor of the rounding of 32 bits each time. Equal eigenvalues have any orthonormal vectors of their space. The sign
    of each vector makes its largest entry positive.
    """
    a = a.astype(HIGH)
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(len(a), HIGH), np.eye(len(a), dtype=HIGH)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    last = np.inf
    for _ in range(steps):
        x, values, apart = _refined(a, x)
        for group in _clusters(values, apart):
            y = x[:, group]
            mean = values[group].mean()
            inner = y.T @ (a @ y - mean * y)
            size = np.abs(inner).max()
            if size > 16 * np.finfo(HIGH).eps:
                turn = np.linalg.eigh(((inner + inner.T) / 2 / size).astype(np.float32))[1].astype(HIGH)
                # 32-bit vectors are orthonormal to 32 bits only: two Newton-Schulz steps bring them to full precision.
                for _ in range(3):
                    turn = turn + turn @ (np.eye(len(group), dtype=HIGH) - turn.T @ turn) / 2
                x[:, group] = y @ turn
        ax = a @ x
        values = (x * ax).sum(axis=0) / (x * x).sum(axis=0)
        rest = float(np.abs(ax - x * values).max() + np.abs(np.eye(len(x), dtype=HIGH) - x.T @ x).max())
        if rest >= last / 2 and rest < 1e-15:
            break
        last = min(last, rest)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    x = x / np.sqrt((x * x).sum(axis=0))
    top = np.abs(x).argmax(axis=0)
    return values * scale, x * np.where(x[top, np.arange(len(x))] < 0, -1, 1)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: n vectors with sums ``sums``; components are the rows of ``components``."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    def shift(self) -> np.ndarray:
        """Whole numbers nearest to the mean."""
        return np.array([round(Fraction(s, self.n)) for s in self.sums], np.int64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of whole vectors: less the mean, along each component, over the root of its eigenvalue."""
        m = self.shift()
        left = np.array([float(Fraction(s, self.n) - int(k)) for s, k in zip(self.sums, m, strict=True)])
        return ((x - m).astype(np.float64) - left) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        m = self.shift()
        left = np.array([s - self.n * int(k) for s, k in zip(self.sums, m, strict=True)], object)
        y = x - m
        largest = self.n * (int(np.abs(y).max()) + 1) if y.size else 0
        if largest * largest * self.size < 1 << 62:
            d = self.n * y - left.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * y.astype(object) - left
        return (d * d).sum(axis=1).tolist()


def vector_size(df: DataFrame, vector: str) -> int | None:
    """Number of entries that most vectors have (the larger one on ties); None without any."""
    sizes = df.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("size")).count()
    row = sizes.orderBy(F.col("count").desc(), F.col("size").desc()).first()
    return None if row is None else row["size"]


def fit(df: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """Fit on all usable vectors: two passes, in which each task returns its sums. None without usable vectors.

    Usable are vectors of the most frequent length whose entries are all finite. Components without variance are left out.
    """
    size = vector_size(df, vector)
    if size is None:
        return None
    found = _exact_sums(df, vector, size, lambda x: np.r_[len(x), x.sum(axis=0)].astype(object))
    if not found or not found[0]:
        return None
    n, sums = found[0], found[1:]
    shift = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    products = _exact_sums(df, vector, size, lambda x: _products(x - shift))
    v = covariance(n, sums, products, shift)
    values, vectors = eigenvectors(v)
    kept = [k for k in range(min(components, size)) if values[k] > NO_VARIANCE * values[0]]
    return Whitening(n, sums, values[kept].astype(np.float64), vectors[:, kept].T.astype(np.float64), float(np.trace(v)))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest entry, without sign, of the covariance of the whitened vectors less the identity.

    Each batch is centred by its own mean before it is multiplied; batches are put together by their means.
    """
    k = len(model.values)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def together(parts: np.ndarray) -> np.ndarray:
        """Rows (n, mean, centred products) as one such row."""
        n = parts[:, 0].sum()
        mean = (parts[:, :1] * parts[:, 1 : k + 1]).sum(axis=0) / n
        d = parts[:, 1 : k + 1] - mean
        return np.r_[n, mean, parts[:, k + 1 :].sum(axis=0) + np.einsum("i,ij,ik->jk", parts[:, 0], d, d).ravel()]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            _, x = whole_vectors(batch.column(0), shared.value.size)
            if len(x):
                w = shared.value.whiten(x)
                mean = w.mean(axis=0)
                new = np.r_[len(w), mean, ((w - mean).T @ (w - mean)).ravel()][None, :]
                held = together(new if held is None else np.vstack([held, new]))[None, :]
        yield pa.RecordBatch.from_arrays([pa.array([] if held is None else held.tolist(), pa.list_(pa.float64()))], ["x"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in filter(lambda b: b.num_rows, batches):
            new = np.array(batch.column(0).to_pylist())
            held = together(new if held is None else np.vstack([held, new]))[None, :]
        yield pa.RecordBatch.from_arrays([pa.array([] if held is None else held.tolist(), pa.list_(pa.float64()))], ["x"])

    rows = df.select(vector).mapInArrow(part, "x array<double>").repartition(MERGES).mapInArrow(merge, "x array<double>").collect()
    whole = together(np.array([r.x for r in rows]))
    return float(np.abs(whole[k + 1 :].reshape(k, k) / whole[0] - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, whitened array<double>, deviation decimal) of every usable vector; rows stay where they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_vectors(batch.column("vector"), shared.value.size)
            w = shared.value.whiten(x)
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            columns = [batch.column("vec_id").take(pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(w.ravel())), pa.array([str(d) for d in shared.value.deviation(x)], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "whitened", "deviation"])

    schema = T.StructType([source.schema["vec_id"], T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.StringType())])
    return source.mapInArrow(run, schema).withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def whitened_components(df: DataFrame, components: int = 8, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    Vectors that are null, empty, of another length than most, or that hold null or non-finite entries have no rows; repeated
    rows have rows each, null vec_ids too. Components are numbered from 1; those without variance are left out, so that equal vectors
    (or a single one) and an empty table give no rows. ``deviation`` is null beyond 64 bits. Other columns are
    ignored. Four passes over one column, nothing but sums is shuffled, and the driver holds matrices of the vector's size.
    """
    kind = df.schema[vec_id].dataType
    model = fit(df, vector, components)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("vec_id", kind)])).selectExpr("vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    error = identity_error(df, model, vector)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    rows = whiten(df, model, vector, vec_id).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error")
    )
