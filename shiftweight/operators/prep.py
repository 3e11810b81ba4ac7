"""Manifests, splits, protocols, class indices and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import range_edges, range_number

NO_LABEL = -1
# The splits that a protocol adapts on, by split mode.
ADAPT_SPLIT = {"uda_target": "test_unlabeled", "align_val": "val_unlabeled"}


def drop_labels(df: DataFrame, value: int = NO_LABEL, label: str = "label") -> DataFrame:
    return df.withColumn(label, F.lit(value))


def assert_labels_dropped(df: DataFrame, value: int = NO_LABEL, label: str = "label") -> None:
    """Error if any row has a label; no rows pass."""
    if not df.filter(~F.col(label).eqNullSafe(F.lit(value))).isEmpty():
        raise ValueError("target rows still have labels")


def route_splits(df: DataFrame, split_mode: str, adapt_split: str | None = None, eval_split: str | None = None) -> DataFrame:
    """Rows of the protocol with ``role`` source, adapt or eval; adapt rows lose their label.

    ``uda_target`` adapts on test_unlabeled and evaluates on test, ``align_val`` on val_unlabeled and val.
    """
    if split_mode not in ADAPT_SPLIT:
        raise ValueError(f"unknown split mode {split_mode!r}")
    adapt, held = adapt_split or ADAPT_SPLIT[split_mode], eval_split or ("val" if split_mode == "align_val" else "test")
    role = F.when(F.col("split") == "train", "source").when(F.col("split") == adapt, "adapt").when(F.col("split") == held, "eval")
    return df.withColumn("role", role).filter(F.col("role").isNotNull()).withColumn("label", F.when(F.col("role") == "adapt", F.lit(NO_LABEL)).otherwise(F.col("label")))


def protocol_violation() -> Column:
    """The first rule that a configuration (split_mode, adapt_split, eval_split) breaks, or null.

    Null settings have the defaults uda_target, test_unlabeled and test; names are as they stand, in lower case.
    """
    mode, adapt, held = (F.coalesce(F.col(c), F.lit(d)) for c, d in (("split_mode", "uda_target"), ("adapt_split", "test_unlabeled"), ("eval_split", "test")))
    return (
        F.when(~mode.isin(*ADAPT_SPLIT), "unknown split_mode")
        .when(~held.isin("val", "test"), "unknown eval_split")
        .when(~adapt.isin(*ADAPT_SPLIT.values()), "unknown adapt_split")
        .when((mode == "align_val") & (adapt != "val_unlabeled"), "align_val adapts on val_unlabeled")
        .when((mode == "align_val") & (held != "val"), "align_val evaluates on val")
        .when((mode == "uda_target") & (adapt != "test_unlabeled"), "uda_target adapts on test_unlabeled")
        .when((held == "test") & (adapt == "test_unlabeled") & (mode != "uda_target"), "test_unlabeled with test needs uda_target")
    )


def label_violations(df: DataFrame, classes: int, ignore_index: int | None = None, label: str = "label") -> DataFrame:
    """Rows whose label is outside [0, classes), but for the ignored one."""
    bad = F.col(label).isNull() | ~F.col(label).between(0, classes - 1)
    return df.filter(bad if ignore_index is None else bad & (F.coalesce(F.col(label), F.lit(ignore_index + 1)) != ignore_index))


def class_to_idx(manifest: DataFrame, name: str = "class_name") -> DataFrame:
    """(class_name, idx): 0-based index over the sorted class names; the distinct list is small."""
    names = manifest.select(name).filter(F.col(name).isNotNull()).distinct()
    return names.select(name, (F.row_number().over(Window.orderBy(name)) - 1).alias("idx"))


def with_class_index(manifest: DataFrame, name: str = "class_name") -> DataFrame:
    return manifest.join(class_to_idx(manifest, name).withColumnRenamed("idx", "label"), name)


def shared_class_index(manifest: DataFrame, source: str, target: str, preferred: str = "A", name: str = "class_name", domain: str = "domain") -> DataFrame:
    """(class_name, idx) over the sorted classes of one domain: ``preferred`` if it is the source or target, else the source.

    Source and target must have the same classes; otherwise an error.
    """
    of = lambda d: manifest.filter(F.col(domain) == d)
    assert_same_classes(of(source), of(target), name)
    return class_to_idx(of(preferred if preferred in (source, target) else source), name)


def sample_index(df: DataFrame, order: str = "path", into: str = "sample_id", range_rows: int = 100_000) -> DataFrame:
    """0-based index in the order of a column (null first; equal values in any order).

    Ranges of about ``range_rows`` rows are numbered each by itself from the count of rows before it. A value that is
    a range of its own, however many rows have it, is dealt over parts of that size by a hash of the whole row, and rows that are equal in
    all columns are counted and numbered again in blocks; so no task sees more than a few ranges' rows. Columns must
    be comparable (no maps).
    """
    value, columns = F.col(order), df.columns
    total = df.count()
    if total <= range_rows:  # one range
        return df.withColumn(into, F.row_number().over(Window.orderBy(value)).cast("long") - 1)
    edges = range_edges(df, value, min(4096, max(8, total // range_rows)), total)
    rows = df.withColumn("_range", range_number(value, edges))
    # A range with one value is split by row hash; the split depends on the row alone, so both passes agree on it.
    known = sorted(rows.groupBy("_range").agg(F.count("*").alias("n"), F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias("single")).collect())  # two per range at most
    split = {r["_range"]: -(-r.n // range_rows) for r in known if r.single and r.n > range_rows}
    if not split:
        offsets = [(r["_range"], sum(q.n for q in known[:k])) for k, r in enumerate(known)]
        starts = df.sparkSession.createDataFrame(offsets, "_range int, _before bigint")
        number = F.row_number().over(Window.partitionBy("_range").orderBy(value)) - 1
        return rows.join(F.broadcast(starts), "_range").withColumn(into, F.col("_before") + number).drop("_range", "_before")
    copies = F.coalesce(F.create_map(*[F.lit(x) for item in split.items() for x in item])[F.col("_range")], F.lit(1))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*columns, F.lit(3)), copies).cast("int"))
    counts = rows.groupBy("_range", "_part").count()
    dense = counts.filter(F.col("count") > 4 * range_rows).select("_range", "_part")
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))  # a row for each range_rows rows
    inside = Window.partitionBy("_range", "_part")
    sparse = rows.join(F.broadcast(dense), ["_range", "_part"], "left_anti").join(starts, ["_range", "_part"])
    sparse = sparse.withColumn(into, F.col("_before") + F.row_number().over(inside.orderBy(value)) - 1)
    if dense.isEmpty():
        return sparse.drop("_range", "_part", "_before")
    equal = rows.join(F.broadcast(dense), ["_range", "_part"]).groupBy("_range", "_part", *columns).agg(F.count("*").alias("_n")).join(starts, ["_range", "_part"])
    first = F.col("_before") + F.coalesce(F.sum("_n").over(inside.orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = equal.withColumn("_first", first).select(*columns, (F.col("_first") + F.col("_n") - 1).alias("_last"), F.explode(F.expr(f"sequence(_first, _first + _n - 1, {range_rows}L)")).alias("_from"))
    again = blocks.repartition(min(4096, 1 + total // range_rows), "_from").withColumn(into, F.explode(F.sequence("_from", F.least(F.col("_from") + range_rows - 1, F.col("_last")))))
    return sparse.drop("_range", "_part", "_before").unionByName(again.drop("_from", "_last"))


def class_mismatch(source: DataFrame, target: DataFrame, name: str = "class_name") -> DataFrame:
    """(class_name, missing_in) for classes that only one side has."""
    a, b = source.select(name).distinct(), target.select(name).distinct()
    return a.join(b, name, "left_anti").withColumn("missing_in", F.lit("target")).unionByName(b.join(a, name, "left_anti").withColumn("missing_in", F.lit("source")))


def assert_same_classes(source: DataFrame, target: DataFrame, name: str = "class_name") -> None:
    found = class_mismatch(source, target, name).limit(20).collect()
    if found:
        raise ValueError("classes differ: " + ", ".join(f"{r[name]} missing in {r.missing_in}" for r in sorted(found)))


def tagged_union(source: DataFrame, target: DataFrame, into: str = "domain_label") -> DataFrame:
    """Both sides with domain label 0 (source) and 1 (target)."""
    return source.withColumn(into, F.lit(0)).unionByName(target.withColumn(into, F.lit(1)), allowMissingColumns=True)


def num_classes(manifest: DataFrame, name: str = "class_name") -> DataFrame:
    return manifest.agg(F.countDistinct(name).alias("num_classes"))


def step_budget(df: DataFrame, batch_size: int, epochs_source: int, epochs_adapt: int, method: str = "reweight", steps_override: int | None = None, domain: str = "domain") -> DataFrame:
    """Batches per epoch of both domains, adapt steps per epoch (the smaller one, or given) and totals; one row.

    ``source_only`` adapts for 0 steps. Negative settings and an empty target that has to be adapted to are errors.
    """
    if batch_size <= 0 or epochs_source < 0 or epochs_adapt < 0 or (steps_override or 0) < 0:
        raise ValueError("negative budget")
    n = df.agg(F.count_if(F.col(domain) == "source").alias("n_source"), F.count_if(F.col(domain) == "target").alias("n_target"))
    n = n.withColumns({"source_steps": F.ceil(F.col("n_source") / batch_size), "target_steps": F.ceil(F.col("n_target") / batch_size)})
    adapt = F.lit(0).cast("long") if method == "source_only" else F.lit(steps_override).cast("long") if steps_override is not None else F.least("source_steps", "target_steps")
    if method != "source_only":
        adapt = F.when(F.col("n_target") > 0, adapt).otherwise(F.raise_error(F.lit("empty target")).cast("long"))
    n = n.withColumn("adapt_steps", adapt)
    return n.withColumn("total_steps", F.col("source_steps") * epochs_source + F.col("adapt_steps") * epochs_adapt)


def pair_batches(source: DataFrame, target: DataFrame, mode: str = "zip") -> DataFrame:
    """(batch_no, target_batch): ``zip`` stops with the shorter side, ``cycle`` repeats the target until the source ends."""
    s, t = source.select("batch_no").distinct(), target.select(F.col("batch_no").alias("target_batch")).distinct()
    if mode == "zip":
        return s.join(t, F.col("batch_no") == F.col("target_batch"))
    if mode != "cycle":
        raise ValueError(f"unknown mode {mode!r}")
    n = t.agg(F.count("*").alias("n"))
    return s.crossJoin(F.broadcast(n)).join(t, F.col("target_batch") == F.col("batch_no") % F.col("n")).drop("n")
