"""Phrase collocations against loops over all n-grams."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftweight.llm import _text, phrases

SCHEMA = "doc_id bigint, text string, lang string, h string, class string, phrase string, k string, n string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, lang, "h", "c", "p", "k", "n") for i, (t, lang) in enumerate(rows)], SCHEMA)


def direct(rows, longest, least, best):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if a >= least}
    found = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        if any(len(q) > len(p) and often[lg, q] * 100 >= a * 100 and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for lg, q in often if lg == lang):
            continue
        score, cut = min((1000 * a * n[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), often[lang, p[:cut]], often[lang, p[cut:]]))
    out = []
    for lang, rows_ in found.items():
        for rank, (s, a, p, x, y) in enumerate(sorted(rows_)[:best], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def texts(seed, n=150):
    r = random.Random(seed)
    words = ["New", "york", "the", "CITY", "of", "a", "é", "Éa", "x-1", " ", "the", "the"]
    fixed = ["New York City council", "over and over and over", "a a a a", "ni hao", "one two three four five six"]
    make = lambda: "".join(r.choice([r.choice(fixed), r.choice(words), r.choice(words)]) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "?!", "\x0b"]) for _ in range(r.randint(0, 60)))
    rows = [(make(), r.choice(["en", "de", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", "en"), (" \t\n", "fr"), rows[0], rows[0], ("a " * 3000, "en"), ("word" * 5000, "en")]


@pytest.mark.parametrize("capacity", [phrases.CAPACITY, 8])
def test_collocations(spark, capacity):
    """With a capacity of eight counters summaries take off what they can and what survives is counted again."""
    rows = texts(1)
    for least, best in ((5, 1000), (12, 7)):
        got = sorted(tuple(x) for x in phrases.collocations(frame(spark, rows).repartition(3), least=least, best=best, capacity=capacity).collect())
        want = direct(rows, 5, least, best)
        assert got == want and len(want) > 10


def test_summaries_take_off_and_are_counted_again(spark, monkeypatch):
    """Small summaries do take counts off: their own counts are too small, the result is not."""
    rows = [(f"red apple {i} red apple b{i % 40} c{i % 7}", "en") for i in range(300)]
    seen = []
    survivors = phrases.Summary.survivors
    summary = phrases.Summary(100, 4)
    r = np.random.default_rng(0)
    stream = r.permutation(np.r_[np.full(150, 7), np.full(120, 8), r.integers(100, 4000, 3000)])
    for part in np.array_split(stream, 40):
        keys, counts = np.unique(part, return_counts=True)
        summary.add(keys.astype(np.int64), counts.astype(np.int64), np.full(len(keys), 3, np.int64))
        seen.append(len(summary.keys))
    kept = summary.keys[survivors(summary)]
    assert {7, 8} <= set(kept.tolist()) and 0 < summary.taken < 100 and max(seen) < 800
    assert summary.counts[summary.keys == 7][0] <= 150 <= summary.counts[summary.keys == 7][0] + summary.taken
    got = sorted(tuple(x) for x in phrases.collocations(frame(spark, rows), least=100, capacity=2).collect())
    assert got == direct(rows, 5, 100, 2000) and got[0][2] == "red apple"


def test_merged_summaries_are_one_summary():
    r = np.random.default_rng(1)
    whole, parts = phrases.Summary(50, 10), [phrases.Summary(50, 10) for _ in range(4)]
    for p in parts:
        keys = np.r_[r.integers(0, 500, 400), np.full(20, 1000)]
        p.add(*(x.astype(np.int64) for x in np.unique(keys, return_counts=True)), np.zeros(len(np.unique(keys)), np.int64))
        whole.add(p.keys, p.counts, p.classes, p.taken)
    assert 1000 in whole.keys[whole.survivors()] and whole.taken < 50


def test_very_large_counts_are_exact(spark):
    """The product a * n * 1000 passes 64 bits."""
    a, n, x, y = 4 * 10**15, 9 * 10**15, 5 * 10**15, 7 * 10**15
    row = spark.createDataFrame([(a, n, x, y)], "a bigint, n bigint, l bigint, r bigint")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    top = (whole("a") * whole("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    got = row.select(top.alias("top"), (whole("l") * whole("r")).cast("decimal(38,0)").alias("bottom")).selectExpr("cast(top as decimal(38,0)) div bottom AS s").first().s
    assert got == 1000 * a * n // (x * y)


def test_collocations_of_odd_tables(spark):
    assert phrases.collocations(frame(spark, []).limit(0)).count() == 0
    assert phrases.collocations(frame(spark, [(None, None), ("", "en"), (". , !", "en")]), least=1).count() == 0
    same = [("Big Deal", None)] * 120
    assert [tuple(x) for x in phrases.collocations(frame(spark, same)).collect()] == [("und", 1, "big deal", 120, 120, 120, 240, 2000)]
    with pytest.raises(ValueError):
        phrases.collocations(frame(spark, same), least=0)


def test_hashes_tell_pieces_lengths_and_languages_apart():
    data, off = _text.buffers(__import__("pyarrow").array(["a b. a b c", "a b"]))
    g = phrases.Grams.of(data, off, np.array([1, 2], np.uint64), np.array([5, 6]), 0)
    at, h = g.hashes(2)
    assert [g.phrase(i, 2) for i in at] == ["a b", "a b", "b c", "a b"] and h[0] == h[1] != h[3]
    assert len(set(g.hashes(1)[1].tolist()) & set(h.tolist())) == 0 and len(g.hashes(3)[0]) == 1 and len(g.hashes(9)[0]) == 0
