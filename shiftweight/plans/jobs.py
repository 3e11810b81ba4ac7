"""Whole jobs: one-shot weights, the confidence-filtered update, and experiment tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import class_probs
from ..operators import iis, latent, runs, select, weights
from ..operators.iis import Constraints
from ..sources.files import shared_folder, stored, write_best_by_val
from ..sources.snapshots import Folder


@dataclass(frozen=True)
class WeightConfig:
    """Settings of both weight jobs. ``layers`` maps an array column to its number of components."""

    layers: dict[str, int]
    classes: int
    backend: str = "vmf"
    backend_options: dict = field(default_factory=dict)
    max_iter: int = 15
    tol: float = 0.0
    step: float = 1.0
    damping: float = 0.0
    clip_max: float | None = None
    mix_alpha: float = 0.8  # of the update: share of the solved weights
    mix_uniform: float = 0.0  # of the one-shot job: share of the uniform weight
    clean_ratio: float = 1.0
    conf_mode: str = "maxprob"
    tau: float = 0.9
    max_entropy: float | None = None
    min_count: int = 1
    policy: str = "lower_thresh"
    ema_alpha: float = 0.0
    constraint_weight: float = 1.0
    fit_rows: int = 20_000
    seed: int = 0


def _responsibilities(df: DataFrame, models: dict[str, latent.LatentModel]) -> DataFrame:
    """Replace each layer's vectors by its responsibilities, all layers in one pass."""
    return latent.all_responsibilities(df, {name: (name, model) for name, model in models.items()})


def _constraints(models: dict[str, latent.LatentModel], classes: int) -> Constraints:
    return Constraints({name: m.n_components for name, m in models.items()}, classes)


def one_shot_weights(source: DataFrame, target: DataFrame, cfg: WeightConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source with w, iteration history, one-row summary) from features and logits of both sides.

    Source and target classes are softmax probabilities. In the result each layer holds responsibilities instead of vectors, and
    ``probs`` stands for ``logits``. These short rows are written once to the shared folder: iterations, post-processing
    and summary read them, and neither the latents nor the scores are computed again. Nothing is joined.
    """
    add = lambda df: df.withColumn("probs", class_probs("softmax", F.col("logits"))).drop("logits")
    target = add(target)
    models = latent.fit_target_structure(target, cfg.layers, cfg.backend, cfg.clean_ratio, **cfg.backend_options)
    c = _constraints(models, cfg.classes)
    pg = iis.target_moments(_responsibilities(target.select("probs", *cfg.layers), models), c)
    solved, _, history = iis.solve_iis(stored(_responsibilities(add(source), models)), c, pg, cfg.max_iter, cfg.tol, cfg.step, cfg.damping)
    out = stored(weights.postprocess_weights(solved, cfg.clip_max, cfg.mix_uniform, "oneshot"))
    return out, iis.history_table(source.sparkSession, history), weights.weights_summary(out)


@dataclass
class UpdateRecord:
    """What one update did; ``moments`` is the state that the next update smooths with."""

    status: str
    tau_used: float
    target_total: int
    target_selected: int
    moments: np.ndarray | None = None
    history: list[iis.Iteration] = field(default_factory=list)
    ess: float | None = None
    weight_entropy: float | None = None
    topk_idx: list[int] = field(default_factory=list)
    epoch: int | None = None
    weights: str | None = None  # where the weights of the epoch are, in a series of updates


class UpdateLog:
    """State of a series of updates in a shared folder: one file for each thing that is done, each put there whole.

    ``epoch-e-prepared.json`` names the table of responsibilities and the moments of epoch e, ``epoch-e-round-r.json`` is the solver
    after r rounds, ``epoch-e.json`` the record of a finished epoch.
    """

    def __init__(self, spark: SparkSession, path: str, epoch: int):
        self.folder, self.epoch, self.path = Folder(spark, path), epoch, path
        self.prefix = f"epoch-{epoch:06d}"

    def _load(self, name: str) -> str | None:
        return self.folder.get(name) if name in self.folder.names() else None

    def prepared(self) -> dict | None:
        text = self._load(f"{self.prefix}-prepared.json")
        return None if text is None else json.loads(text)

    def prepare(self, **known) -> None:
        self.folder.put(f"{self.prefix}-prepared.json", json.dumps(known))

    def state(self) -> iis.SolverState | None:
        rounds = [n for n in self.folder.names() if n.startswith(f"{self.prefix}-round-")]
        return iis.SolverState.from_json(self.folder.get(rounds[-1])) if rounds else None

    def save(self, state: iis.SolverState) -> None:
        self.folder.put(f"{self.prefix}-round-{state.rounds:06d}.json", state.to_json())

    def finish(self, record: UpdateRecord) -> None:
        x = {k: v for k, v in record.__dict__.items() if k not in ("moments", "history")}
        x["moments"] = _exact(record.moments)
        x["history"] = [h.__dict__ for h in record.history]
        self.folder.put(f"{self.prefix}.json", json.dumps(x))

    def record(self) -> UpdateRecord | None:
        text = self._load(f"{self.prefix}.json")
        if text is None:
            return None
        x = json.loads(text)
        return UpdateRecord(**x | {"moments": _numbers(x["moments"]), "history": [iis.Iteration(**h) for h in x["history"]]})


def _exact(a: np.ndarray | None) -> list[str] | None:
    return None if a is None else [float(v).hex() for v in a]


def _numbers(a: list[str] | None) -> np.ndarray | None:
    return None if a is None else np.array([float.fromhex(v) for v in a])


def _prepared(source: DataFrame, target: DataFrame, cfg: WeightConfig, state: np.ndarray | None, id_col: str) -> UpdateRecord | dict:
    """Selection, fit and moments of an update: a table of (id, label, responsibilities) and the target moments, or why there are none."""
    seen = target.select(id_col, "probs", *cfg.layers).persist()
    try:
        total = seen.count()
        if not total:
            return UpdateRecord("skipped_empty_target", cfg.tau, 0, 0, state)
        kept, tau, status = select.select_confident(seen, cfg.conf_mode, cfg.tau, cfg.min_count, cfg.policy, cfg.max_entropy)
        if kept is None:
            return UpdateRecord(status, tau, total, 0, state)
        kept = select.finite_rows(kept, ["probs", *cfg.layers])
        n = kept.count()
        if not n:
            return UpdateRecord("skipped_no_finite_rows", tau, total, 0, state)
        models = latent.fit_target_structure(select.fit_sample(kept, cfg.fit_rows, cfg.seed, id_col), cfg.layers, cfg.backend, **cfg.backend_options)
        c = _constraints(models, cfg.classes)
        pg = iis.target_moments(_responsibilities(kept, models), c)
        if state is not None and len(state) == len(pg) and cfg.ema_alpha > 0:
            pg = cfg.ema_alpha * state + (1 - cfg.ema_alpha) * pg
        path = shared_folder(source.sparkSession)
        joint = select.finite_rows(_responsibilities(source.select(id_col, F.col("label").cast("int").alias("label"), *cfg.layers), models), list(cfg.layers))
        joint.write.parquet(path)
        return {"joint": path, "layers": c.layers, "pg": _exact(pg), "tau": tau, "total": total, "selected": n}
    finally:
        seen.unpersist()


def update_importance_weights(source: DataFrame, target: DataFrame, cfg: WeightConfig, before: UpdateRecord | None = None, id_col: str = "sample_id", log: UpdateLog | None = None) -> tuple[DataFrame | None, UpdateRecord]:
    """One update of the source weights from confident target rows. Target labels are never read.

    Source classes are the true labels; one-hot rows of them are never made. If the update is skipped, the weights are
    None and the moments of ``before`` stay. The target is scored once and cached; thresholds, fit and moments read that
    cache. The source's responsibilities are written once and read by every iteration.

    With a ``log`` every step is kept in its folder, and an update that was broken off goes on behind the last one.
    """
    spark = source.sparkSession
    found = log.prepared() if log else None
    if found is None:
        found = _prepared(source, target, cfg, before.moments if before else None, id_col)
        if isinstance(found, UpdateRecord):
            return None, found
        if log:
            log.prepare(**found)
    c, pg = Constraints(found["layers"], cfg.classes), _numbers(found["pg"])
    joint = spark.read.parquet(found["joint"])
    solved, _, history = iis.solve_iis(joint, c, pg, cfg.max_iter, cfg.tol, cfg.step * cfg.constraint_weight, cfg.damping, label="label", state=log.state() if log else None, save=log.save if log else None)
    out = stored(weights.postprocess_weights(solved.select(id_col, "w"), cfg.clip_max, cfg.mix_alpha, "update"))
    s = weights.weights_summary(out, entropy="floor").first()
    top = [r[id_col] for r in select.top_weights(out, 10).collect()]
    return out, UpdateRecord("updated", found["tau"], found["total"], found["selected"], pg, history, s.ess, s.entropy, top)


def weight_updates(source: DataFrame, target_of: Callable[[int], DataFrame], cfg: WeightConfig, epochs: int, folder: str, id_col: str = "sample_id") -> list[UpdateRecord]:
    """Updates of epochs 0 to epochs - 1, each smoothed with the moments of the one before; their records, skipped ones too.

    ``target_of(epoch)`` gives the target rows as scored in that epoch. Records and weights (a Parquet table for each updated
    epoch, named in its record) are in ``folder``, which must be shared. Calling this again with the same folder returns finished epochs
    as they are and goes on with the first unfinished one, behind its last solver round.
    """
    spark, out = source.sparkSession, []
    for epoch in range(epochs):
        log = UpdateLog(spark, folder, epoch)
        record = log.record()
        if record is None:
            found, record = update_importance_weights(source, target_of(epoch), cfg, out[-1] if out else None, id_col, log)
            record.epoch = epoch
            if found is not None:
                record.weights = f"{folder}/weights/{log.prefix}-{uuid.uuid4().hex}"
                found.write.parquet(record.weights)
            log.finish(record)
        out.append(record)
    return out


def experiment_tables(expected: DataFrame, artifacts: DataFrame, methods: list[str], best_path: str | None = None) -> dict[str, DataFrame]:
    """Tables ``runs``, ``stats``, ``pivot``, ``best`` and ``status`` of expected runs and what was found for them.

    ``best_path`` is where the best runs are written as one JSON object. Artifacts with a column ``metrics`` (split -> metrics) are
    chosen from by ``runs.best_selected``, others by ``val_acc``.
    """
    found = runs.collect_expected_runs(expected, artifacts).withColumn("status", F.col("run_status"))
    flagged = runs.flag_invalid_comparisons(found)
    stats = runs.transfer_stats(flagged)
    per_transfer = runs.transfer_stats(flagged, overall=False)
    best = runs.best_selected(flagged, order="run_id") if "metrics" in flagged.columns else runs.best_by_val(flagged, order="run_id")
    if best_path:
        write_best_by_val(best, best_path)
    return {"runs": flagged, "stats": stats, "pivot": runs.pivot_results(per_transfer, methods), "best": best, "status": runs.status_counts(flagged)}
