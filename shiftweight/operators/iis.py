"""Moment constraints and the maximum-entropy solve over them.

A constraint is a (layer, component, class) triple; its feature on a row is gamma_j * p_c. The feature matrix is never
materialised: with weights w_t proportional to exp(lambda . f_t), lambda . f_t = sum over layers of
gamma^T Lambda p, and the moments are gamma^T diag(w) p. Each iteration is one pass over the cached source that
returns one row of sums per task; weights are written out once, at the end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import total
from .latent import lists, matrix, merged

EPS = 1e-12


@dataclass(frozen=True)
class Constraints:
    """Layers (name -> components) and number of classes; ids run layer by layer, the class innermost."""

    layers: dict[str, int]
    classes: int

    @property
    def size(self) -> int:
        return sum(self.layers.values()) * self.classes

    def offsets(self) -> dict[str, int]:
        out, at = {}, 0
        for name, k in self.layers.items():
            out[name] = at
            at += k * self.classes
        return out

    def encode(self, layer: str, component: int, label: int) -> int:
        if layer not in self.layers or not 0 <= component < self.layers[layer] or not 0 <= label < self.classes:
            raise ValueError(f"no constraint ({layer}, {component}, {label})")
        return self.offsets()[layer] + component * self.classes + label

    def decode(self, i: int) -> tuple[str, int, int]:
        if not 0 <= i < self.size:
            raise ValueError(f"no constraint {i}")
        layer = [name for name, at in self.offsets().items() if at <= i][-1]
        return layer, *divmod(i - self.offsets()[layer], self.classes)

    def table(self, spark: SparkSession) -> DataFrame:
        """(constraint_id, layer, component, class), a small dimension table."""
        return spark.createDataFrame([(i, *self.decode(i)) for i in range(self.size)], "constraint_id int, layer string, component int, class int")

    def column(self, layer: Column, component: Column, label: Column) -> Column:
        """Column form of :meth:`encode`; outside the range is an error."""
        at = F.create_map(*[F.lit(x) for item in self.offsets().items() for x in item])[layer]
        most = F.create_map(*[F.lit(x) for item in self.layers.items() for x in item])[layer]
        ok = at.isNotNull() & component.between(0, most - 1) & label.between(0, self.classes - 1)
        return F.when(ok, at + component * self.classes + label).otherwise(F.raise_error(F.lit("no such constraint")).cast("int")).cast("int")


class _Soft:
    """Class probabilities of a batch."""

    def __init__(self, p: np.ndarray):
        self.p = p

    def scores(self, g: np.ndarray, block: np.ndarray) -> np.ndarray:
        return ((g @ block) * self.p).sum(axis=1)

    def sums(self, g: np.ndarray) -> np.ndarray:
        return g.T @ self.p


class _Labelled:
    """Class labels of a batch, as if each were a one-hot row: only column y of a block is touched.

    Work per row does not depend on the number of classes. A label that is null or no class stands for a row of zeros.
    """

    def __init__(self, y: np.ndarray, classes: int):
        self.rows = np.flatnonzero((y >= 0) & (y < classes))
        self.y, self.n, self.classes = y[self.rows], len(y), classes

    def scores(self, g: np.ndarray, block: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        out[self.rows] = np.einsum("ij,ij->i", g[self.rows], block.T[self.y])
        return out

    def sums(self, g: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.y, x, self.classes) for x in g[self.rows].T])


def _classes(batch: pa.RecordBatch, probs: str, label: str | None, classes: int) -> _Soft | _Labelled:
    if label is None:
        return _Soft(matrix(batch.column(probs)))
    return _Labelled(np.asarray(pc.fill_null(batch.column(label).cast(pa.int64()), -1)), classes)


def _moments_pass(df: DataFrame, c: Constraints, lam: np.ndarray | None, probs: str, weight: str | None, label: str | None = None) -> np.ndarray:
    """Merged sums over all rows: see ``run``."""
    layers, k = list(c.layers), c.classes
    shared = df.sparkSession.sparkContext.broadcast(lam)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, sums, low, high, n = -np.inf, np.zeros(c.size + 2), np.inf, -np.inf, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _classes(batch, probs, label, k)
            g = [matrix(batch.column(name)) for name in layers]
            blocks = np.split(shared.value, [c.offsets()[name] for name in layers[1:]]) if shared.value is not None else None
            s = sum(p.scores(x, b.reshape(-1, k)) for x, b in zip(g, blocks, strict=True)) if blocks else np.zeros(batch.num_rows)
            if weight:
                e, new = np.asarray(batch.column(weight), np.float64), 0.0
            else:
                new = max(top, float(s.max()))
                e = np.exp(s - new)
            scale = np.exp(top - new) if np.isfinite(top) else 0.0
            f = np.concatenate([p.sums(x * e[:, None]).ravel() for x in g])
            sums = sums * (scale if not weight else 1.0) + np.r_[f, e.sum(), (e * s).sum()]
            top, low, high, n = new, min(low, float(s.min())), max(high, float(s.max())), n + batch.num_rows
        yield pa.RecordBatch.from_arrays([lists(np.r_[top, low, high, n, sums].reshape(1, -1))], ["x"])

    def together(parts: np.ndarray) -> np.ndarray:
        parts = parts[parts[:, 3] > 0]
        if not len(parts):
            return np.r_[-np.inf, np.inf, -np.inf, 0, np.zeros(c.size + 2)]
        top = parts[:, 0].max()
        scale = np.ones(len(parts)) if weight else np.exp(parts[:, 0] - top)
        return np.r_[top, parts[:, 1].min(), parts[:, 2].max(), parts[:, 3].sum(), (parts[:, 4:] * scale[:, None]).sum(axis=0)]

    sums = merged(df.select(*layers, label or probs, *([weight] if weight else [])).mapInArrow(run, "x array<double>"), together)
    if not sums[3]:
        raise ValueError("no rows")
    return sums


def target_moments(target: DataFrame, c: Constraints, probs: str = "probs") -> np.ndarray:
    """Mean of gamma_j * p_c over the target rows, for each constraint."""
    r = _moments_pass(target, c, None, probs, None)
    return r[4 : 4 + c.size] / r[3]


def model_moments(source: DataFrame, c: Constraints, weight: str = "w", probs: str = "probs", label: str | None = None) -> np.ndarray:
    """Sum of w_t * gamma_j * p_c over the source rows; with ``label``, p is the one-hot row of that column."""
    return _moments_pass(source, c, None, probs, weight, label)[4 : 4 + c.size]


def moments_long(df: DataFrame, c: Constraints, weight: str | None = None, probs: str = "probs") -> DataFrame:
    """(layer, component, class, moment) by exploding; an inspection form of the two functions above."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = [df.select(F.lit(name).alias("layer"), w.alias("w"), F.posexplode(name).alias("component", "g"), F.col(probs).alias("p")) for name in c.layers]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select("layer", "component", "w", "g", F.posexplode("p").alias("class", "p"))
    value = F.sum(F.col("w") * F.col("g") * F.col("p")) if weight else F.avg(F.col("g") * F.col("p"))
    return rows.groupBy("layer", "component", "class").agg(value.alias("moment"))


def class_marginals(source: DataFrame, target: DataFrame, weight: str = "w", probs: str = "probs") -> DataFrame:
    """(class, target, source, weighted) mean class probabilities."""
    mean = lambda df, name: df.select(F.posexplode(probs).alias("class", "p")).groupBy("class").agg(F.avg("p").alias(name))
    both = source.select(F.col(weight).alias("w"), F.posexplode(probs).alias("class", "p")).groupBy("class").agg(F.avg("p").alias("source"), F.sum(F.col("w") * F.col("p")).alias("weighted"))
    return mean(target, "target").join(both, "class", "full")


def feature_mass_stats(df: DataFrame, layers: list[str], probs: str = "probs", label: str | None = None, classes: int | None = None) -> DataFrame:
    """Per-row mass of all features: min, max, mean, sample deviation, and the deviation relative to the mean."""
    row = total(F.col(probs)) if label is None else F.coalesce(F.col(label).between(0, classes - 1).cast("double"), F.lit(0.0))
    mass = sum((total(F.col(name)) for name in layers[1:]), total(F.col(layers[0]))) * row
    return df.select(mass.alias("m")).agg(F.min("m").alias("min"), F.max("m").alias("max"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std")).withColumn("rel_std", F.col("std") / F.greatest(F.col("mean"), F.lit(EPS)))


def validate_joint(df: DataFrame, layers: list[str], probs: str = "probs", tolerance: float = 1e-2) -> DataFrame:
    """(min_entry, max_layer_error, max_total_error, valid): entries >= -1e-8, each layer's mass 1, the total their number."""
    p = F.col(probs)
    layer_mass = [total(F.col(name)) * total(p) for name in layers]
    # The smallest product of two entries is one of their extremes; a negative one may meet any class.
    ends = lambda a: (F.array_min(a), F.array_max(a))
    smallest = F.least(*[x * y for name in layers for x in ends(F.col(name)) for y in ends(p)], F.lit(float("inf")))
    worst = F.greatest(*[F.abs(m - 1) for m in layer_mass], F.lit(0.0))
    whole = F.abs(sum(layer_mass[1:], layer_mass[0]) - len(layers))
    out = df.agg(F.min(smallest).alias("min_entry"), F.max(worst).alias("max_layer_error"), F.max(whole).alias("max_total_error"))
    return out.withColumn("valid", (F.col("min_entry") >= -1e-8) & (F.col("max_layer_error") <= tolerance) & (F.col("max_total_error") <= tolerance * len(layers)))


def unachievable_constraints(source: DataFrame, pg: np.ndarray, c: Constraints, probs: str = "probs", label: str | None = None) -> list[tuple[str, int, int]]:
    """Constraints with target mass that no source row can give."""
    r = _moments_pass(source, c, None, probs, None, label)
    return [c.decode(int(i)) for i in np.flatnonzero((r[4 : 4 + c.size] <= 0) & (pg > 0))]


def override_moments(pg: np.ndarray, override: np.ndarray | None, c: Constraints) -> tuple[np.ndarray, bool]:
    """Replaced target moments, and whether their mass is off by more than 1e-3 (a warning)."""
    if override is None:
        return pg, False
    override = np.asarray(override, np.float64)
    if override.shape != (c.size,):
        raise ValueError(f"expected {c.size} moments, got {override.shape}")
    if not np.isfinite(override).all() or (override < 0).any():
        raise ValueError("moments must be finite and not negative")
    return override, abs(override.sum() - len(c.layers)) > 1e-3


@dataclass(frozen=True)
class Iteration:
    """What one solver iteration looked like; weights are those after it."""

    iteration: int
    delta_norm: float
    kl: float
    max_error: float
    mean_error: float
    l2_error: float
    weight_min: float
    weight_max: float
    weight_entropy: float
    mass_mean: float
    mass_min: float
    mass_max: float
    objective: float
    log_z: float


def iis_delta(pg: np.ndarray, pm: np.ndarray, layers: int) -> np.ndarray:
    """ln(Pg / Pm) over the number of feature layers, with both floored at 1e-12."""
    return np.log(np.maximum(pg, EPS) / np.maximum(pm, EPS)) / layers


@dataclass(frozen=True)
class SolverState:
    """All that a solve needs to go on: rounds done, lambda, the last step, history, and mass (mean, min, max) of the features."""

    rounds: int
    lam: np.ndarray
    step: np.ndarray | None
    history: list[Iteration]
    mass: tuple[float, float, float]
    done: bool = False

    def to_json(self) -> str:
        """JSON in which every number keeps all its bits."""
        exact = lambda a: None if a is None else [float(x).hex() for x in a]
        rows = [{k: v if k == "iteration" else float(v).hex() for k, v in asdict(h).items()} for h in self.history]
        return json.dumps({"rounds": self.rounds, "lam": exact(self.lam), "step": exact(self.step), "mass": exact(self.mass), "history": rows, "done": self.done})

    @staticmethod
    def from_json(text: str) -> SolverState:
        x = json.loads(text)
        exact = lambda a: None if a is None else np.array([float.fromhex(v) for v in a])
        rows = [Iteration(**{k: v if k == "iteration" else float.fromhex(v) for k, v in h.items()}) for h in x["history"]]
        return SolverState(x["rounds"], exact(x["lam"]), exact(x["step"]), rows, tuple(exact(x["mass"]).tolist()), x["done"])


def solve_iis(
    source: DataFrame, c: Constraints, pg: np.ndarray, max_iter: int = 15, tol: float = 0.0, step: float = 1.0, damping: float = 0.0, probs: str = "probs", label: str | None = None,
    state: SolverState | None = None, save: Callable[[SolverState], None] | None = None,
) -> tuple[DataFrame, np.ndarray, list[Iteration]]:
    """(source with weight column ``w`` summing to 1, lambda, history).

    ``source`` has one array column per layer and ``probs``, or for labelled rows the class column ``label``, which stands for
    one-hot probabilities that are never made. From the second iteration on the step is damped: d = (1 - damping) * d
    + damping * d_before. Stops when the largest moment error is below ``tol``.

    ``save`` is called with the state after each iteration; a solve that is given such a ``state`` goes on behind it.
    """
    rows = source.persist()
    try:
        if state is None:
            mass = feature_mass_stats(rows, list(c.layers), probs, label, c.classes).first()
            state = SolverState(0, np.zeros(c.size), None, [], (mass["mean"], mass["min"], mass["max"]))
        if len(state.lam) != c.size:
            raise ValueError(f"expected the state of {c.size} constraints, got {len(state.lam)}")
        sums = _moments_pass(rows, c, state.lam, probs, None, label)
        while state.rounds < max_iter and not state.done:
            pm = sums[4 : 4 + c.size] / sums[4 + c.size]
            delta = step * iis_delta(pg, pm, len(c.layers))
            if state.step is not None:
                delta = (1 - damping) * delta + damping * state.step
            lam = state.lam + delta
            sums = _moments_pass(rows, c, lam, probs, None, label)
            top, low, high, z = sums[0], sums[1], sums[2], sums[4 + c.size]
            if not np.isfinite(z) or z <= 0:
                raise ValueError("weights collapsed")
            log_z = float(top + np.log(z))
            pm = sums[4 : 4 + c.size] / z
            error = np.abs(pm - pg)
            entropy = log_z - float(sums[5 + c.size] / z)
            now = Iteration(
                state.rounds, float(np.linalg.norm(delta)), float((pg * np.log((pg + 1e-8) / (pm + 1e-8))).sum()), float(error.max()), float(error.mean()), float(np.linalg.norm(pm - pg)),
                float(np.exp(low - log_z)), float(np.exp(high - log_z)), entropy, *state.mass, float(lam @ pg - log_z), log_z,
            )
            state = SolverState(state.rounds + 1, lam, delta, [*state.history, now], state.mass, bool(error.max() < tol))
            if save is not None:
                save(state)
        log_z = float(sums[0] + np.log(sums[4 + c.size]))
    finally:
        rows.unpersist()
    return weighted(source, c, state.lam, log_z, probs, label), state.lam, state.history


def weighted(source: DataFrame, c: Constraints, lam: np.ndarray, log_z: float, probs: str = "probs", label: str | None = None) -> DataFrame:
    """Add w = exp(lambda . f - logZ): a projection, no shuffle and no join."""
    shared = source.sparkSession.sparkContext.broadcast(lam)
    layers, k = list(c.layers), c.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = np.split(shared.value, [c.offsets()[name] for name in layers[1:]])
        for batch in batches:
            w = np.zeros(0)
            if batch.num_rows:
                p = _classes(batch, probs, label, k)
                w = np.exp(sum(p.scores(matrix(batch.column(name)), b.reshape(-1, k)) for name, b in zip(layers, blocks, strict=True)) - log_z)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, pa.float64())], [*batch.schema.names, "w"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("w", T.DoubleType())]))


def history_table(spark: SparkSession, history: list[Iteration]) -> DataFrame:
    fields = ", ".join(f"{name} {'int' if name == 'iteration' else 'double'}" for name in Iteration.__dataclass_fields__)
    return spark.createDataFrame([tuple(asdict(h).values()) for h in history], fields)


def objective_decreased(history: DataFrame, tolerance: float = 1e-8, n_source: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Mark iterations whose objective fell by more than the tolerance; the first one is compared with -ln N if N is given."""
    before = F.lag("objective").over(Window.partitionBy(*(by or [])).orderBy("iteration"))
    start = F.lit(None).cast("double") if n_source is None else F.lit(-float(np.log(n_source)))
    return history.withColumn("decreased", F.coalesce(F.col("objective") + tolerance < F.coalesce(before, start), F.lit(False)))


def ema_moments(by_epoch: DataFrame, alpha: float, key: str = "constraint_id", epoch: str = "epoch", value: str = "x") -> DataFrame:
    """(key, moment): m = alpha * m + (1 - alpha) * x over the epochs in order, from the first; alpha 0 is the last x.

    An epoch whose x is null or NaN was skipped: the moment stays as it was.
    """
    steps = F.array_sort(F.collect_list(F.struct(epoch, value)))
    fold = F.aggregate("s", F.lit(None).cast("double"), lambda m, s: F.when(F.isnan(s[value]), m).otherwise(F.coalesce(m * alpha + s[value] * (1 - alpha), s[value], m)))
    return by_epoch.groupBy(key).agg(steps.alias("s")).select(key, fold.alias("moment"))
