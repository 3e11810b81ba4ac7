"""Ranges of a column: numbering, cutting and order statistics of whole tables without one large task.

Edges come from a bounded sample of *rows*, so that a range holds about as many rows as any other; a value that fills
several of the sample's quantiles becomes a range of its own, between itself and the next larger value of the table. A range
is called a tie only if its smallest and largest value are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task may sort at the end of a cut.
SMALL = 100_000
#: Sampled rows for each range.
SAMPLED = 40
#: Number of the range of nulls: behind all others.
NULLS = 1 << 30


_NAN = float("nan")


def _same(v):
    """All NaN are one object, so that sets and comparisons by identity know them."""
    return _NAN if v != v else v


def _rising(values) -> list:
    """Sorted as Spark does: NaN is the largest number."""
    return sorted(map(_same, values), key=lambda v: (v is _NAN, 0 if v is _NAN else v))


def range_edges(df: DataFrame, value: Column, parts: int = 200, rows: int | None = None) -> list:
    """At most 2 * parts values that cut the column into ranges of about equal numbers of rows.

    The range of number i begins with the i-th edge. Some SAMPLED * parts rows are collected (twice as many at most).
    """
    known = df.select(value.alias("v")).filter("v IS NOT NULL")
    n = known.count() if rows is None else rows
    share = min(1.0, SAMPLED * parts / max(n, 1))
    seen = known if share == 1 else known.sample(share, seed=1)
    values = _rising(r.v for r in seen.limit(2 * SAMPLED * parts).collect())
    if not values:
        return []
    picked = [values[len(values) * k // parts] for k in range(parts)]
    heavy = _rising({v for v, following in zip(picked, picked[1:], strict=False) if v == following or v is following} | {v for v in values[:1] if v == values[-1] or v is values[-1]})
    if not heavy:
        return _rising(set(picked[1:]))
    behind = known.agg(*[F.min(F.when(F.col("v") > F.lit(v), F.col("v"))).alias(f"v{i}") for i, v in enumerate(heavy)]).first()
    return _rising(set(picked[1:]) | set(heavy) | {_same(v) for v in behind if v is not None})


def range_number(value: Column, edges: list, null: int = -1) -> Column:
    """Number of edges up to the value, searched in groups of edges and then in one group."""
    if not edges:
        return F.when(value.isNull(), null).otherwise(F.lit(0))
    size = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + size] for i in range(0, len(edges), size)]
    upto = lambda a: F.size(F.filter(a, lambda e: e <= value))
    heads = F.array(*[F.lit(g[0]) for g in groups])
    if len(groups) == 1:
        return F.when(value.isNull(), null).otherwise(upto(F.array(*[F.lit(e) for e in edges])))
    tails = F.array(*[F.array(*[F.lit(e) for e in g]) for g in groups])
    # The group is the last one whose head is not larger; in front of the first head no edge counts.
    number = F.element_at(F.transform(F.array(upto(heads)), lambda g: F.when(g == 0, 0).otherwise((g - 1) * size + upto(F.get(tails, g - 1)))), 1)
    return F.when(value.isNull(), null).otherwise(number)


@dataclass(frozen=True)
class Part:
    """A range of a column within a scope: rows before it in the scope, its own, and whether all its values are one."""

    number: int
    before: int
    rows: int
    single: bool
    lowest: object


def ranged(scope: DataFrame, column: str, parts: int = 200) -> tuple[Column, list[Part]]:
    """(number of each row's range, what is known of each range); nulls are the last range, a tie of their own."""
    value = F.col(column)
    number = range_number(value, range_edges(scope, value, parts), NULLS)
    rows = scope.groupBy(number.alias("part")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias("single")).collect()  # 2 * parts + 1 at most
    out, before = [], 0
    for r in sorted(rows, key=lambda r: r.part):
        out.append(Part(r.part, before, r.n, r.single, r.lo))
        before += r.n
    return number, out


def cut(df: DataFrame, columns: list[str], n: int, small: int | None = None) -> tuple[list[Column], Column, int, bool]:
    """Where the first n rows in the order of ``columns`` (null last) end.

    Returns (conditions, border, rest, tie): rows that meet one of the conditions are in, and of those that meet
    ``border`` the first ``rest`` ones. These are ``small`` (SMALL) rows at most unless ``tie``: then all columns are equal in them.
    Ranges are narrowed by a factor of about 200 a round, by the second column where the first is equal, and so on.
    """
    rows = df.select(*columns).persist()
    try:
        whole, border = [], F.lit(True)
        for column in columns:
            while True:
                number, parts = ranged(rows.filter(border), column)
                at = next((p for p in parts if p.before + p.rows >= n), None)
                if at is None:
                    return [F.lit(True)], F.lit(False), 0, False
                whole.append(border & (number < at.number))
                border, n = border & (number == at.number), n - at.before
                if at.rows <= (SMALL if small is None else small):
                    return whole, border, n, False
                if at.single:
                    break
        return whole, border, n, True
    finally:
        rows.unpersist()


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, object]:
    """Values at 0-based ranks of the column in rising order, nulls left out; ranks beyond the last value are missing.

    All ranks share the first round of ranges; those that fall into one range share the following ones too. Only ranges of
    SMALL rows are sorted.
    """
    rows = df.select(F.col(column).alias("v")).filter("v IS NOT NULL").persist()
    try:
        found: dict[int, object] = {}
        open_: list[tuple[Column, dict[int, int]]] = [(F.lit(True), {r: r for r in set(ranks) if r >= 0})]
        while open_:
            border, wanted = open_.pop()
            if not wanted:
                continue
            number, parts = ranged(rows.filter(border), "v")
            for p in parts:
                inside = {rank: at - p.before for rank, at in wanted.items() if p.before <= at < p.before + p.rows}
                if not inside:
                    continue
                here = border & (number == p.number)
                if p.single:
                    found |= dict.fromkeys(inside, p.lowest)
                elif p.rows <= SMALL:
                    values = rows.filter(here).orderBy("v").limit(max(inside.values()) + 1)
                    numbered = values.groupBy().agg(F.array_sort(F.collect_list("v")).alias("s"))
                    picked = numbered.select(*[F.get("s", F.lit(at)).alias(str(rank)) for rank, at in inside.items()]).first()
                    found |= {rank: picked[str(rank)] for rank in inside}
                else:
                    open_.append((here, inside))
        return found
    finally:
        rows.unpersist()
