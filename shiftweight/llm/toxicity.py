"""Toxicity by weak supervision.

Voters: every word of a lexicon mined from labelled rows votes *toxic* where it occurs (the strongest each for itself, the
rest pooled); pattern voters vote on how many and how dense such words are, on shouting and on exclamation
marks, and *clean* where no lexicon word occurs. A generative label model estimates each voter's rates in both classes
by EM over all documents: equal rows of votes are counted first, then each round sums posteriors in Spark. Voters that
agree more than these rates explain are correlated and share their weight. Labelled rows are a prior of the rates
(their part is ``GOLD``), which fixes the direction of the classes; no posterior takes over a label. A linear
classifier is trained on the posterior labels of all documents, over the votes and counts: equal rows of both are
counted first, and each of its Newton steps is a sum over them in Spark. It scores every document; slope and shift of
its scores are set on the labelled rows, so that 0.5 is an even chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._features import adam, bounded_sample, sigmoid
from ._store import written

#: Lexicon words that are voters of their own; the others that qualify vote in ``POOLS`` voters by hash.
LEXICON = 512
POOLS = 16
#: Likelihood ratio (G) that a lexicon word must reach; 20 is a chance of about one in 100,000.
LEAST_RATIO = 20.0
#: Part of the voters' rates that labelled rows have, whatever their number; all documents have the other part.
GOLD = 0.5
ROUNDS = 8
#: Newton steps of the classifier at most, its pull towards zero, and steps of density that are told apart.
STEPS, RIDGE, DENSITY = 25, 1e-4, 16
PATTERNS = ["two words", "four words", "one in 50", "one in 200", "shouting", "exclamations"]


@dataclass(frozen=True)
class Lexicon:
    hashes: np.ndarray  # sorted word hashes
    voters: np.ndarray  # voter of each word

    @property
    def size(self) -> int:
        """Voters of words."""
        return int(self.voters.max()) + 1 if len(self.voters) else 0


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    rates: np.ndarray  # (voters, 2): vote probability in clean and toxic rows, as estimated


def lexicon_of(words: np.ndarray) -> Lexicon:
    """Voters for word hashes, the best word first: one for each of the first ``LEXICON``, pools for the rest."""
    voters = np.arange(len(words))
    rest = voters >= LEXICON
    voters[rest] = LEXICON + (words[rest] >> np.uint64(17)).astype(np.int64) % POOLS
    order = np.argsort(words)
    return Lexicon(words[order], voters[order])


def votes(data: np.ndarray, off: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Votes (n, word voters + patterns + 1) of 0 and 1 for each row, and counts (n, 2) for the classifier."""
    w = _text.words(data, off, _text.WORD_ALNUM)
    n, row, m, known = len(off) - 1, w.row, lexicon.size, lexicon.hashes
    at = np.searchsorted(known, w.hashes)
    hit = known[np.minimum(at, len(known) - 1)] == w.hashes if m else np.zeros(len(row), bool)
    words = np.bincount(row[hit] * max(m, 1) + (lexicon.voters[at[hit]] if m else 0), minlength=n * max(m, 1)).reshape(n, -1)[:, :m]
    total, kinds, size = words.sum(axis=1), (words > 0).sum(axis=1), np.maximum(w.counts, 1)
    raw = data[off[0] : off[-1]]
    of = np.repeat(np.arange(n), np.diff(off))
    upper = np.bincount(of[(raw >= 65) & (raw <= 90)], minlength=n)
    lower = np.bincount(of[(raw >= 97) & (raw <= 122)], minlength=n)
    marks = np.bincount(of[raw == 33], minlength=n)
    patterns = [kinds >= 2, kinds >= 4, total * 50 >= size, total * 200 >= size, upper > lower, marks * 10 > size]
    patterns[2] &= total > 0
    patterns[3] &= total > 0
    out = np.hstack([words > 0, np.stack([*patterns, kinds == 0], axis=1)]).astype(np.float32)
    density = np.floor(DENSITY * np.minimum(10.0, 100.0 * total / size)) / DENSITY
    return out, np.stack([np.log1p(kinds), density], axis=1).astype(np.float32)


@dataclass(frozen=True)
class LabelModel:
    """Voters' rates (m, 2) in clean and toxic rows, the part of its weight that each keeps, and P(toxic)."""

    rates: np.ndarray
    share: np.ndarray
    prior: float

    def posterior(self, v: np.ndarray) -> np.ndarray:
        on, off = np.log(self.rates[:, 1] / self.rates[:, 0]), np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0]))
        return sigmoid(np.log(self.prior / (1 - self.prior)) + v @ (self.share * on) + (1 - v) @ (self.share * off))


def class_sums(v: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(2, 1 + m): number of rows and votes of each voter in clean and toxic rows, for rows that count n and are toxic with p."""
    return np.stack([np.r_[q.sum(), q @ v] for q in (n * (1 - p), n * p)])


def pair_sums(v: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(2, m, m): rows in which both voters vote, by class."""
    return np.stack([(v * q[:, None]).T @ v for q in (n * (1 - p), n * p)])


def rates_of(sums: np.ndarray) -> np.ndarray:
    """Rates from class sums, smoothed towards the voter's overall rate by one row."""
    overall = sums[:, 1:].sum(axis=0) / max(sums[:, 0].sum(), 1e-9)
    return np.clip(np.stack([(s[1:] + overall) / (s[0] + 1) for s in sums], axis=1), 1e-5, 1 - 1e-5)


def shares_of(sums: np.ndarray, pairs: np.ndarray, least: float = 0.2) -> np.ndarray:
    """Part of its weight that each voter keeps: one over one plus its correlations inside the classes beyond ``least``."""
    extra = np.zeros(pairs.shape[1:])
    for s, both in zip(sums, pairs, strict=True):
        r = s[1:] / max(s[0], 1e-9)
        spread = np.sqrt(np.maximum(r * (1 - r), 1e-9))
        extra = np.maximum(extra, (both / max(s[0], 1e-9) - np.outer(r, r)) / np.outer(spread, spread))
    np.fill_diagonal(extra, 0)
    return 1 / (1 + np.where(extra > least, extra, 0).sum(axis=1))


def estimate(gold: np.ndarray, sum_classes, sum_pairs, rounds: int = ROUNDS) -> LabelModel:
    """EM over rows that two functions of a model sum: ``sum_classes`` (class sums), ``sum_pairs`` (pair sums).

    ``gold`` are the class sums of labelled rows, from which EM starts and whose rates have the part ``GOLD`` in every
    round. Correlations are measured once, after half of the rounds.
    """
    mix = lambda new, old: (1 - GOLD) * new + GOLD * old
    base, known = float(np.clip(gold[1, 0] / gold[:, 0].sum(), 0.01, 0.99)), rates_of(gold)
    model = LabelModel(known, np.ones(len(known)), base)
    for i in range(rounds):
        sums = sum_classes(model)
        share = shares_of(sums, sum_pairs(model)) if i == rounds // 2 else model.share
        model = LabelModel(mix(rates_of(sums), known), share, float(np.clip(mix(sums[1, 0] / sums[:, 0].sum(), base), 0.01, 0.99)))
    return model


def calibration(z: np.ndarray, gold: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) the chance of label 1 among labelled rows; two numbers, the order of scores stays."""
    weight = weight / weight.sum()

    def gradient(p: list[np.ndarray]) -> list[np.ndarray]:
        error = weight * (sigmoid(np.exp(p[0]) * z + p[1]) - gold)
        return [np.array([(error * z).sum() * np.exp(p[0][0])]) + 1e-5 * p[0], np.array([error.sum()]) + 1e-5 * p[1]]

    log_slope, shift = adam(gradient, [np.zeros(1), np.zeros(1)], 500, 0.05)
    return float(np.exp(log_slope[0])), float(shift[0])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each labelled text."""
    for batch in batches:
        data, off = _text.buffers(batch.column("text"))
        for lo, hi in _text.chunks(off):
            w = _text.words(data, off[lo : hi + 1], _text.WORD_ALNUM)
            order = np.lexsort((w.hashes, w.row))
            h, row = w.hashes[order], w.row[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), batch.column("label").take(pa.array(row[new] + lo))], ["h", "label"])


def _totals(rows: DataFrame, sums, shape: tuple[int, ...], voters: int) -> np.ndarray:
    """Sum over counted rows (v packed, c, n) of what ``sums(v, c, n)`` returns: one sparse row of numbers per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in filter(lambda b: b.num_rows, batches):
            packed = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            v, n = np.unpackbits(packed, axis=1)[:, :voters].astype(np.float64), np.asarray(batch.column("n"), np.float64)
            c = np.frombuffer(b"".join(batch.column("c").to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64) if "c" in batch.schema.names else None
            total += sums(v, c, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["i", "x"])

    out = np.zeros(int(np.prod(shape)))
    for r in rows.mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # at most as many as ``shape`` has
        out[r.i] = r.x
    return out.reshape(shape)


def _summed(patterns: DataFrame, model: LabelModel, pairs: bool) -> np.ndarray:
    """Class or pair sums over counted rows of votes (v packed, n)."""
    shared, m = patterns.sparkSession.sparkContext.broadcast(model), len(model.rates)
    each = pair_sums if pairs else class_sums
    return _totals(patterns.select("v", "n"), lambda v, c, n: each(v, n, shared.value.posterior(v)), (2, m, m) if pairs else (2, 1 + m), m)


def slopes(x: np.ndarray, n: np.ndarray, want: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(1 + m, m): gradient and curvatures of the logistic loss of rows that count n and are to have chance ``want``."""
    p = sigmoid(x @ w)
    return np.vstack([(n * (p - want)) @ x, (x * (n * p * (1 - p))[:, None]).T @ x])


def newton(sums, m: int, rows: float) -> np.ndarray:
    """Weights at which ``sums(w)``, a mean over ``rows`` rows with a pull of RIDGE towards zero, has no slope; the last one is the shift, without pull."""
    w, pull = np.zeros(m), np.r_[np.full(m - 1, RIDGE), 1e-9]
    for _ in range(STEPS):
        found = sums(w) / rows
        step = np.linalg.solve(found[1:] + np.diag(pull), found[0] + pull * w)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))  # far from the end a whole step may go too far
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", most_per_class: int = 8000, most_words: int | None = None) -> ToxicityModel:
    """Mine the lexicon, estimate the label model over all documents and train the classifier.

    ``labels`` has (doc_id, label 0/1). About ``most_per_class`` labelled rows of each class, chosen by hash of doc_id and
    with whole texts, make the lexicon, the prior of the rates and the slope and shift of the scores; that is the one bounded
    sample. The label model and the classifier, which learns what that says of each document, see all documents. A word
    enters the lexicon if enough rows have it (five, or a tenth of the toxic rows if that is less, but two at least),
    most of them toxic and beyond chance; ``most_words`` keeps the best ones only (None: all). Null labels teach nothing; a doc_id with several labels has any of them. Without toxic or without clean
    labels every score is 0 or 1; without documents of both, it is the share of toxic labels.
    """
    spark = docs.sparkSession
    rated = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    share = {r.label: r["count"] for r in rated.groupBy("label").count().collect()}
    constant = lambda bias: ToxicityModel(Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64)), np.zeros(len(PATTERNS) + 3, np.float32), bias, np.zeros((0, 2)))
    if len(share) < 2:
        return constant(20.0 if 1 in share else -20.0)
    chosen = F.broadcast(bounded_sample(rated, "label", most_per_class, "doc_id"))  # at most about 2 * most_per_class rows
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = source.join(chosen, "doc_id")
    used = {c: min(1.0, most_per_class / n) for c, n in share.items()}
    sizes = {c: n * used[c] for c, n in share.items()}
    support = int(max(2, min(5, sizes[1] // 10)))
    # Precision at the classes' own shares, since both are sampled apart.
    t, c = F.col("t") / used[1], (F.col("n") - F.col("t")) / used[0]
    mined = known.mapInArrow(_word_rows, "h bigint, label int").groupBy("h").agg(F.count("*").alias("n"), F.sum("label").alias("t"))
    # Chance alone must not make a word: likelihood ratio against the share of toxic rows among those used.
    base = sizes[1] / (sizes[0] + sizes[1])
    part = lambda k, p: F.when(k > 0, k * F.ln(k / (F.col("n") * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("t"), base) + part(F.col("n") - F.col("t"), 1 - base))
    mined = mined.filter((F.col("t") >= support) & (t >= 3 * c) & (ratio >= LEAST_RATIO)).orderBy(((t + 0.1) / (t + c + 1) * F.log1p("t")).desc(), "h")
    mined = mined if most_words is None else mined.limit(most_words)
    lexicon = lexicon_of(mined.toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    shared, m = spark.sparkContext.broadcast(lexicon), lexicon.size + len(PATTERNS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = _text.buffers(batch.column("text"))
            for lo, hi in _text.chunks(off):
                v, counts = votes(data, off[lo : hi + 1], shared.value)
                packed = pa.array([r.tobytes() for r in np.packbits(v.astype(bool), axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), packed, pa.array([r.tobytes() for r in counts], pa.binary())], ["label", "v", "c"])

    voted = lambda df: df.select("text", "label").mapInArrow(run, "label int, v binary, c binary")
    counted = written(voted(source.select("text", F.lit(None).cast("int").alias("label"))).groupBy("v", "c").agg(F.count("*").alias("n")))
    patterns = written(counted.groupBy("v").agg(F.sum("n").alias("n")))
    n = patterns.agg(F.sum("n")).first()[0] or 0
    # Rows of votes, not texts, go through the task of the limit, which a doc_id with many labelled rows may need.
    found = voted(known).limit(4 * most_per_class).toPandas()
    if found["label"].nunique() < 2:
        return constant(float(np.log(share[1] / share[0])))
    unpack = lambda column, kind: np.frombuffer(b"".join(found[column]), kind).reshape(len(found), -1)
    v = np.unpackbits(unpack("v", np.uint8), axis=1)[:, :m].astype(np.float64)
    gold = found["label"].to_numpy(np.float64)
    weight = np.where(gold == 1, 1 / used[1], 1 / used[0])
    # Labelled rows count as in the corpus, but no more than there are of them.
    model = estimate(class_sums(v, weight * len(gold) / weight.sum(), gold), lambda at: _summed(patterns, at, False), lambda at: _summed(patterns, at, True))
    told = spark.sparkContext.broadcast(model)

    def slopes_at(w: np.ndarray) -> np.ndarray:
        row = lambda v, c: np.hstack([v, c, np.ones((len(v), 1))])
        return _totals(counted, lambda v, c, n: slopes(row(v, c), n, told.value.posterior(v), w), (m + 4, m + 3), m)

    w = newton(slopes_at, m + 3, float(n))
    x = np.hstack([v, unpack("c", np.float32).astype(np.float64)])
    slope, shift = calibration(x @ w[:-1] + w[-1], gold, weight)
    return ToxicityModel(lexicon, (slope * w[:-1]).astype(np.float32), float(slope * w[-1] + shift), model.rates)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text", into: str = "score") -> DataFrame:
    """Columns ``keep`` and the score ``into`` (0 to 1) of every whole text, one row per input row.

    Null and empty texts have no lexicon word and are scored as such. Only the text is used. A map over partitions.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("scored text of " + "/".join(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = _text.buffers(batch.column(batch.num_columns - 1))
            out = np.zeros(batch.num_rows)
            for lo, hi in _text.chunks(off):
                v, counts = votes(data, off[lo : hi + 1], m.lexicon)
                out[lo:hi] = sigmoid(np.hstack([v, counts]) @ m.weights + m.bias)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], into])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(into, T.DoubleType())]))
