"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A text is a sequence of lines: it is cut behind line breaks and behind the end of a sentence, so that a passage
set into the middle of a paragraph still has lines of its own. A line weighs one per six bytes begun without the
space around it, about one per word (and alike in languages without spaces). Lines of space weigh nothing: they
are left out of the sequence, belong to no run, and go where the lines on both sides of them go.

The window at a line is the shortest run of lines from there that weighs ``least``; since each line in the sequence weighs one at
least, that is ``least`` lines at most. The smallest line hash of
each window is its fingerprint; neighbouring windows mostly share one. A window's fingerprint depends on the
window alone, so a run of lines that weighs ``least`` and stands at two places has the same fingerprint at both:
no such run can be missed. Positions of equal fingerprints are joined. Around each of them the run is extended
both ways by hashing the runs of lines that hold it, and each of these is compared with its first place in
the corpus, whichever document that is. A line is deleted if it is in a run that stood at an earlier place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import spread_join, written

#: Cuts: behind a line break, a full-width sentence end, or a sentence end with a space; not before a line break.
CUT = r"(?<=[ \n。！？])(?<![^.!?] )(?<!\A )(?!\r?\n)"
SPACE = " \t\r\n"
#: Bytes of a line for each unit of its weight.
BYTES = 6


def _lines(text: Column) -> Column:
    """Lines of a text, none of them empty; joined they are the text again."""
    return F.filter(F.split(text, CUT, -1), lambda u: u != "")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _lengths(w: Column, least: int) -> Column:
    """Number of lines of the window at each line; null where the next ``least`` lines weigh too little.

    ``w`` holds weights of at most ``least``; the running sum is kept in the low half of an integer, lines in the high half.
    """
    weighs = lambda a: a.bitwiseAND(0xFFFF) >= least
    step = lambda a, x: F.when(weighs(a), a).otherwise(a + x + (1 << 16))
    count = lambda i: F.aggregate(F.slice(w, i + 1, least), F.lit(0), step, lambda a: F.when(weighs(a), F.shiftright(a, 16)))
    # One to three lines are mostly enough; a line behind the last one is null, and then the sum over the slice decides.
    two, three = lambda x, i: x + F.get(w, i + 1), lambda x, i: x + F.get(w, i + 1) + F.get(w, i + 2)
    return F.transform(w, lambda x, i: F.when(x >= least, 1).when(two(x, i) >= least, 2).when(three(x, i) >= least, 3).otherwise(count(i)))


def _windows(rows: DataFrame) -> DataFrame:
    """Add the fingerprint ``f`` of the window at line i and its line ``p`` to rows with (h, n, i); rows without a window go."""
    window = F.slice("h", F.col("i") + 1, F.get("n", F.col("i")))
    rows = rows.filter(F.get("n", F.col("i")).isNotNull()).withColumn("f", F.array_min(window))
    return rows.withColumn("p", (F.col("i") + F.array_position(window, F.col("f")) - 1).cast("int"))


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """(doc_id, th, n_lines, ranges): the ranges [lo, hi] of lines of each document that stood at an earlier place.

    Lines are numbered without lines of space, which ``n_lines`` counts along. The ranges are exactly the lines of all
    runs that weigh ``least`` or more, however long, and stand at an earlier place, whole and line by line equal without the space around
    lines. Places are ordered by doc_id (null first), hash ``th`` of the text, and line. Rows equal in doc_id and text are one
    document. Lines are compared by 96 bits of hash.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cut = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("th"), F.split(body, CUT, -1).alias("all"))
    # The last piece alone can be empty.
    count = (F.size("all") - (F.element_at("all", -1) == "").cast("int")).cast("long")
    units = cut.select("doc_id", "th", count.alias("n_lines"), F.filter(F.transform("all", _bare), lambda u: u != "").alias("u"))
    weight = lambda u: F.least(F.floor((F.octet_length(u) + BYTES - 1) / BYTES).cast("int"), F.lit(least))
    lines = units.select("doc_id", "th", "n_lines", F.transform("u", lambda u: F.xxhash64(u)).alias("h"), F.transform("u", lambda u: F.hash(u)).alias("g"), F.transform("u", weight).alias("w"))
    lines = lines.select("doc_id", "th", "h", "g", _lengths(F.col("w"), least).alias("n"), "n_lines")
    prepared = written(lines.withColumn("row", F.monotonically_increasing_id()))  # fixed once it is written

    # Fingerprints: each position once, at the first window that selects it.
    found = _windows(prepared.select("row", "doc_id", "th", "h", "n", F.posexplode("h").alias("i", "x")).drop("x"))
    i, p = F.col("i"), F.col("p")
    new = (i == 0) | (F.get("h", i - 1) <= F.col("f")) | (p > i + F.coalesce(F.get("n", i - 1), F.lit(0)) - 2)
    prints = found.filter(new).select("row", "doc_id", "th", "f", "i", "p")
    place = F.xxhash64("doc_id", "th", "p")
    repeated = prints.groupBy("f").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).filter("n > 1 AND a < b").select("f", "n")
    joined = spread_join(prints.select("row", "f", "i", "p"), written(repeated), ["f"], F.xxhash64("row", "p"))

    # Extension: the windows that hold a joined position, each alone and with the lines behind it that it does not
    # need its first line to reach (those are in the next window).
    marks = joined.groupBy("row").agg(F.collect_list(F.struct("i", "p")).alias("marks"))
    around = prepared.join(marks, "row").select("doc_id", "th", "h", "g", "n", F.explode("marks").alias("m"))
    around = around.select("doc_id", "th", "h", "g", "n", F.col("m.p").alias("at"), F.explode(F.sequence("m.i", "m.p")).alias("i"))
    around = _windows(around).filter("p = at")
    last = i + F.get("n", i) - 1
    further = F.least(i + F.coalesce(F.get("n", i + 1), F.lit(least)) - 1, F.size("h") - 1)
    around = around.select("doc_id", "th", "h", "g", "i", F.explode(F.sequence(last, F.greatest(last, further))).alias("hi"))
    part = lambda c: F.slice(c, F.col("i") + 1, F.col("hi") - F.col("i") + 1)
    runs = written(around.select("doc_id", "th", F.col("i").alias("lo"), "hi", F.xxhash64(part("h")).alias("k"), F.hash(part("g")).alias("c")))

    place = F.struct("doc_id", "th", "lo")
    first = written(runs.groupBy("k", "c").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"))
    again = spread_join(runs, first, ["k", "c"], F.xxhash64("doc_id", "th", "lo")).filter(place > F.col("first")).select("doc_id", "th", "lo", "hi")
    sizes = prepared.groupBy("doc_id", "th").agg(F.max("n_lines").alias("n_lines"))
    ranges = _merged(again).select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "ranges")
    return sizes.join(ranges, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left").drop("r_id", "r_th")


def _merged(runs: DataFrame) -> DataFrame:
    """(doc_id, th, ranges) from (doc_id, th, lo, hi): ranges that overlap or touch are one."""
    runs = runs.groupBy("doc_id", "th", "lo").agg(F.max("hi").alias("hi"))
    by = W.partitionBy("doc_id", "th").orderBy("lo")
    opens = F.coalesce(F.col("lo") > F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(True))
    parts = runs.withColumn("opens", opens.cast("int")).withColumn("part", F.sum("opens").over(by)).groupBy("doc_id", "th", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return parts.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 12, into: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The input rows with later repetitions (see ``repeated_runs``) cut out of the text, and two counts added.

    All columns are kept, whatever their names; only those named as in ``into`` (number of lines, number of lines
    deleted, lines of space among both) are replaced. What stays is byte for byte the original. Null and empty texts have no lines and stay as
    they are; lines of space alone are no run. Rows equal in doc_id and text count as one document and get the same
    result; null doc_ids come first in the order. The first occurrence of every line stays, so an exact copy of
    an earlier document ends up empty.

    Scale: line hashes (a third of the text) are written and shuffled once, fingerprints twice (the first time
    pre-aggregated), runs around repeated fingerprints twice, texts once. Frequent fingerprints and runs are spread
    over tasks; nothing grows with the square of a group.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("th")).alias("key"))
    found = repeated_runs(docs, doc_id, text, least).select(F.struct("doc_id", "th").alias("key"), "n_lines", "ranges")
    old = F.col("doc")[text].cast("string")
    rows = rows.join(found, "key").withColumn("units", F.when(F.col("ranges").isNotNull(), _lines(old)))
    # From numbers without lines of space to places among all lines.
    places = F.filter(F.transform("units", lambda u, i: F.when(_bare(u) != "", i)), lambda i: i.isNotNull())
    rows = rows.withColumn("places", places)
    rows = rows.withColumn("ranges", F.transform("ranges", lambda r: F.struct(F.get("places", r["lo"]).alias("lo"), F.get("places", r["hi"]).alias("hi"))))
    begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get("ranges", j - 1)["hi"] + 1)
    gaps = F.transform("ranges", lambda r, j: F.slice("units", begin(j) + 1, r["lo"] - begin(j)))
    tail_from = F.element_at("ranges", -1)["hi"] + 1
    tail = F.slice("units", tail_from + 1, F.greatest(F.size("units") - tail_from, F.lit(0)))
    removed = F.coalesce(F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["hi"] - r["lo"] + 1), F.lit(0).cast("long"))
    kept = F.when(F.col("ranges").isNull(), old).otherwise(F.array_join(F.concat(F.flatten(gaps), tail), ""))
    # The condition always holds; it keeps Catalyst from moving filters on the result below this, where the lines would be made again for each range.
    rows = rows.withColumn("made", F.when(F.monotonically_increasing_id() >= 0, F.struct(kept.alias("kept"), removed.alias("removed"))))
    columns = [F.col("made")["kept"].alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns if c not in into]
    return rows.select(*columns, F.col("n_lines").alias(into[0]), F.col("made")["removed"].alias(into[1]))
