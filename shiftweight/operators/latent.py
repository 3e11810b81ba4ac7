"""Latent structure: responsibilities, Gaussian mixtures and unit-sphere prototypes.

Responsibilities are a matrix product per Arrow batch. Mixtures are fitted by EM over per-partition sufficient
statistics: each pass moves J * (2 D + 1) + 1 numbers per task (with covariance matrices up to J * D * D more).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import entropy, l2_normalize
from .select import fit_sample, low_entropy_keep


#: Tasks in which sums of tasks are merged before the driver sees them.
MERGES = 8
#: Restarts that run side by side.
RESTARTS = 10


class LatentModel(Protocol):
    """What a latent backend returns: a map from vectors to component probabilities."""

    n_components: int

    def log_scores(self, x: np.ndarray) -> np.ndarray: ...


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<double> column."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d, pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))


def merged(parts: DataFrame, together: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """One vector from the rows (x) that tasks return; ``together`` makes one row of many and may be applied in steps.

    Rows are first merged in ``MERGES`` tasks, so the driver sees no more of them however many tasks there were.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in filter(lambda b: b.num_rows, batches):
            x = matrix(batch.column(0))
            held = together(x if held is None else np.vstack([held, x]))
        yield pa.RecordBatch.from_arrays([lists((np.zeros((0, 0)) if held is None else held[None, :]))], ["x"])

    return together(np.array([r.x for r in parts.repartition(MERGES).mapInArrow(run, "x array<double>").collect()]))


def vector_sums(df: DataFrame, feature: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of rows, sum of the vectors, and sum of their squares by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in filter(lambda b: b.num_rows, batches):
            x = matrix(batch.column(0))
            new = np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)]
            held = new if held is None else held + new
        yield pa.RecordBatch.from_arrays([lists((np.zeros((0, 0)) if held is None else held[None, :]))], ["x"])

    s = merged(df.select(feature).mapInArrow(run, "x array<double>"), lambda x: x.sum(axis=0))
    d = len(s) // 2
    return float(s[0]), s[1 : d + 1], s[d + 1 :]


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class SphereModel:
    """Prototypes on the unit sphere: P(j | x) = softmax(kappa * cos(x, mu_j))."""

    centroids: np.ndarray
    kappa: float = 20.0

    @property
    def n_components(self) -> int:
        return len(self.centroids)

    def log_scores(self, x: np.ndarray) -> np.ndarray:
        unit = lambda m: np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 1e-12, m / np.maximum(n, 1e-300), 0.0)
        return self.kappa * unit(x) @ unit(self.centroids).T


COVARIANCES = ("diag", "spherical", "full", "tied")


@dataclass(frozen=True)
class MixtureModel:
    """Gaussian mixture. ``variances``: components x D (diag, spherical), components x D x D (full), or D x D (tied)."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    covariance_type: str = "diag"
    log_likelihood: float = float("nan")

    @property
    def n_components(self) -> int:
        return len(self.weights)

    @property
    def matrices(self) -> bool:
        """Whether covariances are matrices."""
        return self.covariance_type in ("full", "tied")

    def _distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of rows from the means in units of the covariances, and logarithms of their determinants."""
        if not self.matrices:
            inv = 1 / self.variances
            return (x * x) @ inv.T - 2 * x @ (self.means * inv).T + (self.means**2 * inv).sum(axis=1), np.log(self.variances).sum(axis=1)
        quad, det = np.empty((len(x), self.n_components)), np.empty(self.n_components)
        for j in range(self.n_components):
            low = np.linalg.cholesky(self.variances[j] if self.covariance_type == "full" else self.variances)
            quad[:, j] = (np.linalg.solve(low, (x - self.means[j]).T) ** 2).sum(axis=0)
            det[j] = 2 * np.log(np.diag(low)).sum()
        return quad, det

    def log_scores(self, x: np.ndarray) -> np.ndarray:
        quad, det = self._distances(x)
        return np.log(np.maximum(self.weights, 1e-300)) - 0.5 * (quad + self.means.shape[1] * np.log(2 * np.pi) + det)

    def parameters(self) -> int:
        m, d = self.means.shape
        return m * d + m - 1 + {"diag": m * d, "spherical": m, "full": m * d * (d + 1) // 2, "tied": d * (d + 1) // 2}[self.covariance_type]

    def bic(self, n: int) -> float:
        return -2 * self.log_likelihood + self.parameters() * float(np.log(n))


def all_responsibilities(df: DataFrame, models: dict[str, tuple[str, LatentModel]]) -> DataFrame:
    """Set array columns (name -> feature and model) to component probabilities, all in one pass: a task has one Python worker for them.

    Every feature is read as it is in ``df``; a column that is there is replaced and stands behind the others. Rows stay where they are.
    """
    shared = df.sparkSession.sparkContext.broadcast(models)  # components * dimensions numbers
    keep = [f for f in df.schema.fields if f.name not in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = lambda feature, model: lists(softmax_rows(model.log_scores(matrix(batch.column(feature))))) if batch.num_rows else pa.array([], pa.list_(pa.float64()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], *[scored(*m) for m in shared.value.values()]], [*[f.name for f in keep], *shared.value])

    return df.mapInArrow(run, T.StructType([*keep, *[T.StructField(name, T.ArrayType(T.DoubleType())) for name in models]]))


def responsibilities(df: DataFrame, model: LatentModel, feature: str, into: str) -> DataFrame:
    """Add the component probabilities of ``feature`` as array column ``into``; rows stay where they are."""
    return all_responsibilities(df, {into: (feature, model)})


def check_vectors(df: DataFrame, feature: str) -> int:
    """Dimension of the vectors; no rows or vectors of different length are errors."""
    r = df.agg(F.min(F.size(feature)).alias("lo"), F.max(F.size(feature)).alias("hi")).first()
    if r.lo is None or r.lo < 1:
        raise ValueError("no vectors to fit")
    if r.lo != r.hi:
        raise ValueError("vectors differ in length")
    return r.lo


def lloyd(df: DataFrame, feature: str, centers: np.ndarray, max_iter: int = 20, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """(centers, cost) of k-means from given centers: one pass a round, until no center moves further than ``tol``.

    A center without rows stays where it is. ``cost`` is that of the last round's starting centers.
    """
    cost = float("inf")
    for _ in range(max_iter):
        shared = df.sparkSession.sparkContext.broadcast(centers)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            sums, far = np.zeros((len(c), c.shape[1] + 1)), 0.0
            for batch in filter(lambda b: b.num_rows, batches):
                x = matrix(batch.column(0))
                d = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
                near = d.argmin(axis=1)
                far += float(np.maximum(d[np.arange(len(x)), near], 0).sum())
                one = (near[:, None] == np.arange(len(c))).astype(np.float64)
                sums += np.hstack([one.sum(axis=0)[:, None], one.T @ x])
            yield pa.RecordBatch.from_arrays([lists(np.r_[far, sums.ravel()].reshape(1, -1))], ["x"])

        whole = merged(df.select(feature).mapInArrow(run, "x array<double>"), lambda x: x.sum(axis=0))
        cost, sums = float(whole[0]), whole[1:].reshape(len(centers), -1)
        moved = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), centers)
        step, centers = float(np.linalg.norm(moved - centers, axis=1).max()), moved
        if step <= tol:
            break
    return centers, cost


def kmeans_centers(df: DataFrame, feature: str, k: int, seed: int, n_init: int = 1, sample: int = 20_000) -> np.ndarray:
    """Centers of k-means: ``n_init`` runs on a sample of at most ``sample`` rows, the cheapest of them refined over all rows.

    Seeding (k-means||) and restarts see the sample only and run side by side, since each is a row of small jobs; the whole table is passed over by
    one set of rounds. A table no larger than the sample is the sample. Vectors are made once and cached for both.
    """
    rows = df.select(feature).persist()
    part = fit_sample(rows, sample, seed, feature).select(array_to_vector(feature).alias("v")).persist()
    try:
        n = part.count()
        fit = inheritable_thread_target(df.sparkSession)(lambda i: KMeans(k=k, seed=seed + i, featuresCol="v").fit(part))
        with ThreadPoolExecutor(min(n_init, RESTARTS)) as pool:
            fits = list(pool.map(fit, range(n_init)))
        best = np.array(min(fits, key=lambda m: m.summary.trainingCost).clusterCenters())
        return best if n < sample else lloyd(rows, feature, best)[0]
    finally:
        part.unpersist()
        rows.unpersist()


def em_step(df: DataFrame, feature: str, model: MixtureModel, reg_covar: float = 1e-6) -> MixtureModel:
    """One EM step; ``log_likelihood`` of the result is that of the model put in.

    Each task returns for each component its mass, the sum of its rows, and sums of squares: D numbers, D * D for ``full``,
    and D * D for all components together for ``tied``. Rows are shifted by the mean of the means first.
    """
    middle = model.weights @ model.means / model.weights.sum()
    shared = df.sparkSession.sparkContext.broadcast((model, middle))
    j, d = model.means.shape
    full, tied = model.covariance_type == "full", model.covariance_type == "tied"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shift = shared.value
        mass, firsts, ll = np.zeros(j), np.zeros((j, d)), 0.0
        squares = np.zeros((j, d, d) if full else (d, d) if tied else (j, d))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                z = m.log_scores(x)
                top = z.max(axis=1, keepdims=True)
                norm = top + np.log(np.exp(z - top).sum(axis=1, keepdims=True))
                r, y = np.exp(z - norm), x - shift
                ll += float(norm.sum())
                mass += r.sum(axis=0)
                firsts += r.T @ y
                squares += np.stack([(y * r[:, [i]]).T @ y for i in range(j)]) if full else y.T @ y if tied else r.T @ (y * y)
        yield pa.RecordBatch.from_arrays([lists(np.r_[ll, mass, firsts.ravel(), squares.ravel()].reshape(1, -1))], ["x"])

    whole = merged(df.select(feature).mapInArrow(run, "x array<double>"), lambda x: x.sum(axis=0))
    mass, firsts, squares = np.maximum(whole[1 : j + 1], 1e-10), whole[j + 1 : j + 1 + j * d].reshape(j, d), whole[j + 1 + j * d :]
    at = firsts / mass[:, None]
    if full:
        var = squares.reshape(j, d, d) / mass[:, None, None] - at[:, :, None] * at[:, None, :] + reg_covar * np.eye(d)
    elif tied:
        var = (squares.reshape(d, d) - (at * mass[:, None]).T @ at) / mass.sum() + reg_covar * np.eye(d)
    else:
        var = np.maximum(squares.reshape(j, d) / mass[:, None] - at**2, 0) + reg_covar
        if model.covariance_type == "spherical":
            var = np.repeat(var.mean(axis=1, keepdims=True), d, axis=1)
    return MixtureModel(mass / mass.sum(), middle + at, var, model.covariance_type, float(whole[0]))


def fit_gmm(df: DataFrame, feature: str, n_components: int, covariance_type: str = "diag", reg_covar: float = 1e-6, seed: int = 0, max_iter: int = 100, tol: float = 1e-3) -> MixtureModel:
    """Gaussian mixture by EM from k-means centers, until the mean log-likelihood gains less than ``tol``.

    ``covariance_type`` is diag, spherical, full (a matrix for each component) or tied (one for all).
    """
    if covariance_type not in COVARIANCES:
        raise ValueError(f"covariance_type must be one of {', '.join(COVARIANCES)}")
    check_vectors(df, feature)
    n = df.count()
    centers = kmeans_centers(df, feature, min(n_components, n), seed)
    rows, at, squares = vector_sums(df, feature)
    var = np.maximum(squares / rows - (at / rows) ** 2, 0) / len(centers) + reg_covar
    if covariance_type == "spherical":
        var = np.full_like(var, var.mean())
    start = {"full": np.tile(np.diag(var), (len(centers), 1, 1)), "tied": np.diag(var)}.get(covariance_type, np.tile(var, (len(centers), 1)))
    model = MixtureModel(np.full(len(centers), 1 / len(centers)), centers, start, covariance_type)
    last = -np.inf
    for _ in range(max_iter):
        following = em_step(df, feature, model, reg_covar)
        if (following.log_likelihood - last) / n < tol and np.isfinite(last):
            break
        last, model = following.log_likelihood, following
    return MixtureModel(model.weights, model.means, model.variances, covariance_type, em_step(df, feature, model, reg_covar).log_likelihood)


def select_gmm_bic(df: DataFrame, feature: str, lo: int = 2, hi: int = 8, id_col: str = "sample_id", sample: int = 20_000, seed: int = 0, **options) -> MixtureModel:
    """Smallest BIC over numbers of components (first on ties), tried on at most ``sample`` rows, refitted on all."""
    part = fit_sample(df.select(id_col, feature), sample, seed, id_col).persist()
    try:
        n = part.count()
        if not n:
            raise ValueError("no vectors to fit")
        lo, hi = min(lo, n), min(hi, n)
        best = min((fit_gmm(part, feature, m, seed=seed, **options) for m in range(lo, hi + 1)), key=lambda m: m.bic(n))
    finally:
        part.unpersist()
    return fit_gmm(df, feature, best.n_components, seed=seed, **options)


def fit_vmf(df: DataFrame, feature: str, k: int, kappa: float = 20.0, seed: int = 0, n_init: int = 10) -> SphereModel:
    """k-means on unit vectors; the centers are brought back to the sphere. Restarts see a sample (``kmeans_centers``)."""
    check_vectors(df, feature)
    centers = kmeans_centers(df.select(l2_normalize(F.col(feature)).alias(feature)), feature, k, seed, n_init)
    return SphereModel(centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12), kappa)


#: Latent backends by name; each maps (df, feature, components, **options) to a model.
BACKENDS = {
    "gmm": lambda df, feature, k, **o: fit_gmm(df, feature, k, **o),
    "gmm_bic": lambda df, feature, k, **o: select_gmm_bic(df, feature, hi=k, **o),
    "vmf": lambda df, feature, k, **o: fit_vmf(df, feature, k, **o),
}


def backend(name: str):
    if name not in BACKENDS:
        raise ValueError(f"unknown latent backend {name!r}; known: {sorted(BACKENDS)}")
    return BACKENDS[name]


def fit_target_structure(target: DataFrame, layers: dict[str, int], kind: str = "gmm", clean_ratio: float = 1.0, probs: str = "probs", id_col: str = "sample_id", **options) -> dict[str, LatentModel]:
    """One model per layer (array column -> number of components), on the rows of lowest entropy if ``clean_ratio`` < 1."""
    fit = backend(kind)
    rows = target
    if clean_ratio < 1:
        rows = low_entropy_keep(target.withColumn("_h", entropy(F.col(probs))), clean_ratio, "_h", id_col).drop("_h")
    rows = rows.persist()
    try:
        counts = rows.agg(*[F.count(c).alias(c) for c in layers]).first().asDict()
        if len(set(counts.values())) > 1:
            raise ValueError(f"layers differ in rows: {counts}")
        return {c: fit(rows, c, k, **options) for c, k in layers.items()}
    finally:
        rows.unpersist()
