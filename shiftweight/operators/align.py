"""Alignment of two samples: maximum mean discrepancy with a mixture of Gaussian kernels.

Batch pairs are independent groups of bounded size (the batch), so they run as one grouped task each. Whole samples
are packed into cells, which are joined with cells by pairs of blocks; only kernel sums leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored
from .latent import lists, matrix, merged, vector_sums


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def _kernel(d: np.ndarray, bandwidth: float, mul: float, num: int) -> np.ndarray:
    base = bandwidth / mul ** (num // 2)
    return sum(np.exp(-d / (base * mul**i + 1e-12)) for i in range(num))


def mmd_matrix(xs: list[np.ndarray], ys: list[np.ndarray], mul: float = 2.0, num: int = 5, sigma: float | None = None) -> float:
    """Biased MMD of two samples; several representations multiply their kernels, each with its own bandwidth."""
    n, k = len(xs[0]), 1.0
    for x, y in zip(xs, ys, strict=True):
        z = np.vstack([x, y])
        d = _squared(z, z)
        k = k * _kernel(d, sigma if sigma is not None else d.sum() / max(1, len(z) ** 2 - len(z)), mul, num)
    return float(k[:n, :n].mean() + k[n:, n:].mean() - k[:n, n:].mean() - k[n:, :n].mean())


def batch_mmd(source: DataFrame, target: DataFrame, features: list[str], mul: float = 2.0, num: int = 5, sigma: float | None = None) -> DataFrame:
    """(batch_no, mmd) for batches that both sides have; with several ``features`` the joint MMD."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        s, t = df[df["side"] == 0], df[df["side"] == 1]
        if s.empty or t.empty:
            return pd.DataFrame({"batch_no": pd.Series([], dtype="int64"), "mmd": pd.Series([], dtype="float64")})
        stack = lambda part: [np.stack(part[f].to_numpy()).astype(np.float64) for f in features]
        return pd.DataFrame({"batch_no": [int(df["batch_no"].iloc[0])], "mmd": [mmd_matrix(stack(s), stack(t), mul, num, sigma)]})

    pick = lambda df, side: df.select(F.col("batch_no").cast("long").alias("batch_no"), F.lit(side).alias("side"), *features)
    return pick(source, 0).unionByName(pick(target, 1)).groupBy("batch_no").applyInPandas(run, "batch_no bigint, mmd double")


def bandwidth(both: DataFrame, feature: str) -> float:
    """Mean squared distance of all ordered pairs in one linear pass: 2 n sum |x|^2 - 2 |sum x|^2."""
    n, s, q = vector_sums(both, feature)
    return (2 * n * float(q.sum()) - 2 * float(s @ s)) / max(1, n**2 - n)


def block_mmd(source: DataFrame, target: DataFrame, features: list[str], mul: float = 2.0, num: int = 5, sigma: float | None = None, block_rows: int = 1000, id_col: str = "sample_id") -> DataFrame:
    """(mmd, blocks): mean of the MMD of random blocks of about ``block_rows`` rows of each side; linear in the rows.

    Blocks are hash classes of the id, so each row goes to one task. Use it where ``whole_mmd``, which compares all pairs of
    rows, is out of reach.
    """
    blocks = max(1, min(source.count(), target.count()) // block_rows)
    dealt = lambda df: df.withColumn("batch_no", F.pmod(F.xxhash64(id_col), F.lit(blocks)))
    return batch_mmd(dealt(source), dealt(target), features, mul, num, sigma).agg(F.avg("mmd").alias("mmd"), F.count("*").alias("blocks"))


def grid_size(rows: int, tasks: int, cell_rows: int) -> int:
    """Blocks for all pairs of blocks to make ``tasks`` tasks: copies of each row, however many rows there are (none is of less than a cell)."""
    return max(1, min(int(np.ceil(np.sqrt(2 * tasks))) - 1, max(1, rows)))


def _packed(rows: DataFrame, features: list[str], cell: int) -> DataFrame:
    """(cell, n0, n1, one binary for each feature): up to ``cell`` rows of a partition as matrices, those of side 0 first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def pack(table: pa.Table) -> pa.RecordBatch:
            side = np.asarray(table["side"].combine_chunks())
            order = np.argsort(side, kind="stable")
            xs = [matrix(table[f].combine_chunks())[order] for f in features]
            n1 = int(side.sum())
            return pa.RecordBatch.from_pydict({"n0": pa.array([len(side) - n1], pa.int32()), "n1": pa.array([n1], pa.int32())} | {f"x{i}": pa.array([x.tobytes()], pa.binary()) for i, x in enumerate(xs)})

        for batch in filter(lambda b: b.num_rows, batches):
            held.append(batch)
            table = pa.Table.from_batches(held)
            whole = len(table) // cell * cell
            for at in range(0, whole, cell):
                yield pack(table.slice(at, cell))
            held = table.slice(whole).to_batches()
        if held:
            yield pack(pa.Table.from_batches(held))

    kinds = "n0 int, n1 int, " + ", ".join(f"x{i} binary" for i in range(len(features)))
    return rows.select("side", *features).mapInArrow(run, kinds).withColumn("cell", F.monotonically_increasing_id())


def _wide(x: np.ndarray, left: bool) -> np.ndarray:
    """Two columns more, so that one product of a left and a right matrix is the matrix of squared distances."""
    norm, one = (x * x).sum(axis=1)[:, None], np.ones((len(x), 1))
    return np.hstack([-2 * x, norm, one] if left else [x, one, norm])


def _mixture(d: np.ndarray, width: float, mul: float, num: int) -> np.ndarray:
    """``_kernel`` of squared distances, which are overwritten. If each bandwidth is twice the one before, the kernels are squares of the widest one."""
    base = width / mul ** (num // 2)
    if mul != 2 or base < 1e-2:  # the 1e-12 added to small bandwidths would be seen
        return _kernel(np.maximum(d, 0, out=d), width, mul, num)
    np.maximum(d, 0, out=d)
    d *= -1 / (base * mul ** (num - 1) + 1e-12)
    np.exp(d, out=d)
    k = d.copy()
    for _ in range(num - 1):
        np.multiply(d, d, out=d)
        k += d
    return k


def whole_mmd(source: DataFrame, target: DataFrame, features: list[str], mul: float = 2.0, num: int = 5, tasks: int | None = None, cell_rows: int = 40_000, tile: int = 2000, id_col: str = "sample_id") -> DataFrame:
    """(mmd, copies) of two whole samples, exact. All pairs of rows are the definition.

    Rows are packed into cells of at most 2,000 rows, and cells are dealt over g blocks. The g (g + 1) / 2 pairs of blocks are the groups
    of a join of cells with cells (``tasks`` of them, default: four for each task that the session runs at once), so that each row is
    sent g + 1 times, about the root of twice the number of tasks, whatever the number of rows. A task sees the joined pairs of cells one
    after another, of no more than ``cell_rows`` rows together, and sums kernels by tiles of ``tile`` rows. Work grows
    with the square of the rows; ``fourier_mmd`` and ``block_mmd`` are linear.
    """
    spark = source.sparkSession
    rows = source.select(*features, F.lit(0).alias("side")).unionByName(target.select(*features, F.lit(1).alias("side"))).persist()
    try:
        widths = [bandwidth(rows, f) for f in features]
        cells = stored(_packed(rows, features, max(1, min(2000, cell_rows // 2))))
    finally:
        rows.unpersist()
    n = cells.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    g = grid_size(n.n0 + n.n1, tasks or 4 * spark.sparkContext.defaultParallelism, cell_rows)
    cells = cells.withColumn("block", F.pmod(F.xxhash64("cell"), F.lit(g)).cast("int"))
    parts = 2 * g * (g + 1)  # four for each pair of blocks, so that few pairs fall into one
    pair = lambda i, j: F.explode(F.transform(F.sequence(i, j), lambda o: F.least("block", o) * g + F.greatest("block", o))).alias("pair")
    as_side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in cells.columns]
    left = cells.select(*as_side("a"), pair(F.col("block"), F.lit(g - 1))).repartition(parts, "pair")
    right = cells.select(*as_side("b"), pair(F.lit(0), F.col("block"))).repartition(parts, "pair")
    both = left.join(right.hint("merge"), "pair").filter("a_block < b_block OR a_cell <= b_cell").drop("pair", "a_block", "b_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2))
        read = lambda r, s, i: np.frombuffer(r[f"{s}_x{i}"]).reshape(r[f"{s}_n0"] + r[f"{s}_n1"], -1)
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                a, b = ([_wide(read(r, s, i), s == "a") for i in range(len(widths))] for s in "ab")
                sa, sb = (np.repeat(np.eye(2), [r[f"{s}_n0"], r[f"{s}_n1"]], axis=0) for s in "ab")
                found = np.zeros((2, 2))
                for x in range(0, len(sa), tile):
                    for y in range(0, len(sb), tile):
                        k = 1.0
                        for u, v, width in zip(a, b, widths, strict=True):
                            k = k * _mixture(u[x : x + tile] @ v[y : y + tile].T, width, mul, num)
                        found += sa[x : x + tile].T @ k @ sb[y : y + tile]
                sums += found if r["a_cell"] == r["b_cell"] else found + found.T
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (sums[0, 0], sums[1, 1], (sums[0, 1] + sums[1, 0]) / 2)], ["xx", "yy", "xy"])

    sums = both.mapInArrow(run, "xx double, yy double, xy double").agg(F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.sum("xy").alias("xy")).first()
    value = sums.xx / n.n0**2 + sums.yy / n.n1**2 - 2 * sums.xy / (n.n0 * n.n1)
    return spark.createDataFrame([(value, g)], "mmd double, copies int")


def frequencies(dims: list[int], widths: list[float], mul: float, num: int, count: int, seed: int) -> np.ndarray:
    """Random frequencies (count x sum of dims) of the product of the kernels, which is a mixture of Gaussian kernels."""
    rng = np.random.default_rng(seed)
    parts = []
    for d, width in zip(dims, widths, strict=True):
        scale = width / mul ** (num // 2) * mul ** rng.integers(0, num, count) + 1e-12
        parts.append(rng.normal(size=(count, d)) * np.sqrt(2 / scale)[:, None])  # exp(-|x|^2 / s) is the mean of cos(w x), w ~ N(0, 2 / s)
    return np.hstack(parts)


def fourier_mmd(source: DataFrame, target: DataFrame, features: list[str], mul: float = 2.0, num: int = 5, count: int = 2048, seed: int = 0, confidence: float = 0.99) -> DataFrame:
    """(mmd, std_error, bound) by random Fourier features: two passes over the rows, in which each task returns sums.

    The mixture kernel is num^(features) times a mean of cosines of random frequencies, so the MMD is as many times the mean of the squared
    distances of the two samples' characteristic functions at ``count`` of them. Each distance is at most 4: with
    probability ``confidence`` the error is at most ``bound`` (Hoeffding); ``std_error`` is what the distances themselves tell.
    """
    rows = source.select(*features, F.lit(0).alias("side")).unionByName(target.select(*features, F.lit(1).alias("side"))).persist()
    try:
        widths = [bandwidth(rows, f) for f in features]
        first = rows.select(*[F.size(f).alias(f) for f in features]).first()
        w = rows.sparkSession.sparkContext.broadcast(frequencies([first[f] for f in features], widths, mul, num, count, seed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((2, 1 + 2 * count))
            for batch in filter(lambda b: b.num_rows, batches):
                side = np.asarray(batch.column("side"))
                x = np.hstack([matrix(batch.column(f)) for f in features])
                for a in range(0, len(x), 1024):
                    angle = x[a : a + 1024] @ w.value.T
                    waves = np.hstack([np.ones((len(angle), 1)), np.cos(angle), np.sin(angle)])
                    for p in (0, 1):
                        held[p] += waves[side[a : a + 1024] == p].sum(axis=0)
            yield pa.RecordBatch.from_arrays([lists(held.reshape(1, -1))], ["x"])

        sums = merged(rows.mapInArrow(run, "x array<double>"), lambda x: x.sum(axis=0)).reshape(2, -1)
    finally:
        rows.unpersist()
    if not sums[:, 0].all():
        raise ValueError("both samples must have rows")
    gap = sums[0, 1:] / sums[0, 0] - sums[1, 1:] / sums[1, 0]
    each = float(num) ** len(features) * (gap[:count] ** 2 + gap[count:] ** 2)
    bound = 4 * float(num) ** len(features) * np.sqrt(np.log(2 / (1 - confidence)) / (2 * count))
    return source.sparkSession.createDataFrame([(float(each.mean()), float(each.std() / np.sqrt(count)), float(bound))], "mmd double, std_error double, bound double")
