"""Column functions over arrays of doubles: probabilities, entropies, norms, products and losses.

All are built-in expressions; nothing leaves the JVM. Wide vectors (hundreds of dimensions) are better served
by the Arrow kernels in ``shiftweight.operators.latent`` and ``scoring``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def softmax(logits: Column) -> Column:
    """Row softmax, shifted by the largest logit."""
    return let(logits, lambda x: let(F.array_max(x), lambda m: let(F.transform(x, lambda v: F.exp(v - m)), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, 1.0).otherwise(0.0))


def class_probs(mode: str, logits: Column | None = None, label: Column | None = None, classes: int | None = None) -> Column:
    """``softmax`` of logits or ``onehot`` of labels; another mode is an error."""
    if mode == "softmax":
        return softmax(logits)
    if mode == "onehot":
        return one_hot(label, classes)
    raise ValueError(f"unknown class-probability mode {mode!r}")


def max_prob(probs: Column) -> Column:
    return F.array_max(probs)


def argmax(x: Column) -> Column:
    """Index (from 0) of the first maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


#: Per-element terms of the three entropy conventions.
ENTROPIES: dict[str, Callable[[Column], Column]] = {
    "clip": lambda p: let(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)), lambda q: q * F.ln(q + 1e-12)),
    "floor": lambda p: p * F.ln(F.greatest(p, F.lit(1e-12))),
    "clamp": lambda p: let(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-6)), lambda q: q * F.ln(q)),
}


def entropy(probs: Column, variant: str = "clip") -> Column:
    """Entropy in nats. ``clip``: of p in [0, 1] with 1e-12 added in the log; ``floor``: log of max(p, 1e-12);
    ``clamp``: p held in [1e-6, 1]. The three are kept apart because results near zero differ."""
    return -total(F.transform(probs, ENTROPIES[variant]))


def entropy_weight(probs: Column) -> Column:
    """1 + exp(-H): certain rows count up to twice as much."""
    return 1 + F.exp(-entropy(probs, "clamp"))


def l2_normalize(x: Column, eps: float = 1e-12) -> Column:
    """Unit norm; rows with a norm of eps or less become zeros."""
    return let(F.sqrt(total(F.transform(x, lambda v: v * v))), lambda n: F.transform(x, lambda v: F.when(n > eps, v / n).otherwise(0.0)))


def row_normalize(p: Column, clamp: bool = False) -> Column:
    """Divide by the row sum. Entries below -1e-12 or a sum of zero are errors; ``clamp`` first raises entries to 0."""
    x = F.transform(p, lambda v: F.greatest(v, F.lit(0.0))) if clamp else p
    bad = F.lit(False) if clamp else F.exists(p, lambda v: v < -1e-12)
    return F.when(bad, F.raise_error(F.lit("negative probability")).cast("array<double>")).otherwise(
        let(total(x), lambda s: F.when(s > 0, F.transform(x, lambda v: v / s)).otherwise(F.raise_error(F.lit("row without mass")).cast("array<double>")))
    )


def joint(gamma: Column, probs: Column) -> Column:
    """gamma_j * p_c, flattened with the class as the inner index."""
    return F.flatten(F.transform(gamma, lambda g: F.transform(probs, lambda p: g * p)))


def conditional_representation(feat: Column, probs: Column) -> Column:
    """p_c * x_d, flattened with the class as the outer index."""
    return F.flatten(F.transform(probs, lambda p: F.transform(feat, lambda v: p * v)))


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.ln(total(F.transform(x, lambda v: F.exp(v - m)))))


def cross_entropy(logits: Column, label: Column, ignore_index: int | None = None) -> Column:
    """Loss per row; null for rows with the ignored label, which a mean then leaves out."""
    loss = log_sum_exp(logits) - F.get(logits, label)
    return loss if ignore_index is None else F.when(label != ignore_index, loss)


def is_finite(x: Column) -> Column:
    """True if no element is null, NaN or infinite."""
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def dense_logits(feat: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """x W^T + b for a small number of classes, as one expression."""
    rows = F.array(*[F.struct(F.array(*map(F.lit, w)).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weights, bias, strict=True)])
    return F.transform(rows, lambda r: dot(feat, r["w"]) + r["b"])
