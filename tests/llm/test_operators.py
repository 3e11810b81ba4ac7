"""Corpus operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import base64
import hashlib
import random
import struct
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from shiftweight.llm import _graph, _text, bpe, ctph, decontam, jaccard, langid, linededup, quality, sharding, toxicity, warc
from shiftweight.llm.queries import tokenizer_path

WORDS = ["the", "cat", "Sat", "on", "a", "mat", "dog", "ran", "far", "Éa", "ñu", "x1", "zz"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, th string, key string, shard string, n_words string, component_id string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, None, "s", None, "th", "key", "shard", "w", "c") for i, t in rows], DOCS)


def corpus(seed, n=40, size=60):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, size)))) for i in range(n)]
    return rows + [(100, None), (101, ""), (None, "the cat sat on a mat"), (102, rows[3][1]), (3, rows[3][1]), (103, "a " * 3000), (104, ". , !")]


def words(t):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_contamination(spark):
    docs = corpus(1)
    r = random.Random(2)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(n))) for i, n in enumerate([4, 7, 9, 10, 12, 25, 1])] + [(50, None), (51, ""), (52, docs[5][1]), (52, docs[5][1])]
    got = decontam.find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, it in items:
            x = words(it)
            n = min(10, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
            for p in range(len(w) - n + 1 if x else 0):
                if tuple(w[p : p + n]) in wins:
                    hit.update(range(p, p + n))
                    found.add(str(i))
        want[d, t] = (len(w), len(hit), sorted(found))
    assert len(got) == len(want)  # equal rows give one row
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append((x.n_words, x.n_hit, x.item_ids))
        assert sum(s.end - s.start for s in x.spans) == x.n_hit
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v for (d, _), v in want.items() if d == k) for k, _ in want}
    assert any(v[1] for v in want.values())
    assert decontam.find_contamination(frame(spark, docs), spark.createDataFrame([], "item_id bigint, text string")).filter("n_hit > 0").isEmpty()
    assert decontam.find_contamination(frame(spark, []), spark.createDataFrame(items, "item_id bigint, text string")).isEmpty()


def reference_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_contamination_of_one_word_over_and_over(spark):
    """A word 20,000 times against an item of the same word 400 times: equal fingerprints join once."""
    docs = frame(spark, [(1, "ha " * 20000), (2, "ha " * 8), (3, "ha " * 11)])
    found = {x.doc_id: x for x in decontam.find_contamination(docs, spark.createDataFrame([("a", "ha " * 400), ("b", "ha ho")], "item_id string, text string")).collect()}
    assert {i: (x.n_hit, x.item_ids) for i, x in found.items()} == {1: (20000, ["a"]), 2: (0, []), 3: (11, ["a"])}


@pytest.mark.parametrize("shared", ["the", "one two three four five six seven eight nine ten"])
def test_contamination_by_many_items_with_one_window(spark, shared):
    """A thousand items share a window, and documents hold it again and again: rows don't multiply."""
    own = lambda i: "" if shared == "the" else f"a{i} b{i} c{i} d{i} e{i} " + shared + f" f{i} g{i} h{i} i{i} j{i}"
    items = [(i, own(i) or shared) for i in range(1000)] + [(5000, "far away")]
    docs = [(i, " ".join([f"start{i}", *[shared] * 60, "end"])) for i in range(150)] + [(900, "nothing here"), (901, own(7) or "x the"), (902, "it is far away")]
    began = time.time()
    got = {x.doc_id: x for x in decontam.find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert time.time() - began < 60
    size = len(shared.split())
    every = sorted(str(i) for i in range(1000))
    assert all(got[i].n_hit == 60 * size and got[i].item_ids == every and [(s.start, s.end) for s in got[i].spans] == [(1, 1 + 60 * size)] for i in range(150))
    assert got[900].n_hit == 0 and got[900].item_ids == [] and got[902].item_ids == ["5000"] and got[901].n_hit == (1 if shared == "the" else 20)


def test_jump_hash_and_sharding(spark):
    keys = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64)
    for n in (1, 2, 16, 17):
        assert sharding.jump_hash(keys, n).tolist() == [reference_jump(int(k), n) for k in keys]
    docs = corpus(3, 300) + [(3, corpus(3, 300)[3][1])] * 5
    rows = sharding.shard_documents(frame(spark, docs), 16).collect()
    assert len(rows) == len(docs)
    slots, placed = defaultdict(list), defaultdict(set)
    for x in rows:
        slots[x.shard].append(x.slot)
        placed[x.doc_id].add(x.shard)
        assert x.grown_shard in (x.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in placed.values())
    assert sorted((x.size, x.text_crc32) for x in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in docs)
    moved = sum(x.grown_shard == 16 for x in rows) / len(rows)
    assert moved < 0.15
    assert sharding.shard_documents(frame(spark, [])).isEmpty()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_sharding_of_hot_rows(spark):
    """A row 30,000 times, and one doc_id with as many texts: slots without gaps."""
    rows = spark.range(30000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.range(30000).select(F.lit(6).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")))
    out = sharding.shard_documents(rows, 2).toPandas()
    assert len(out) == 60000 and out.groupby("doc_id").shard.nunique().max() == 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_piecewise_fingerprints(spark):
    r = random.Random(5)
    sigs = ["".join(r.choice(ctph.ALPHABET[:4]) for _ in range(r.randint(0, 64))) for _ in range(80)]
    d = ctph.edit_distance(sigs[:40], sigs[40:])
    assert d.tolist() == [levenshtein(a, b) for a, b in zip(sigs[:40], sigs[40:])]
    docs = corpus(4, 60, 400)
    got = ctph.fingerprint_edits(frame(spark, docs), bucket_rows=9).collect()
    assert len(got) == len(docs)
    order = sorted((i for i, _ in docs if i is not None), reverse=True) + [None]
    text = {i: t or "" for i, t in docs}
    near = []
    for x in got:
        t = text[x.doc_id]
        k = order.index(x.doc_id) + (2 if x.doc_id == 3 else 1)
        following = text[order[k % len(order)]]
        h = len(t) // 2
        edited = {t[: len(t) - h] + n[:h] for n in ([following] if x.doc_id != 3 else [following, t])}
        assert x.edited_sha256 in {hashlib.sha256(e.encode()).hexdigest() for e in edited}
        assert x.n_chars == len(t) and x.fingerprint == ctph.fingerprints([t])[0] and 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        if len(t) > 200:
            near.append(x.near_edited - x.near_next)
    assert np.mean(near) > 0.2
    long = " ".join(r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(20000))
    a, b = ctph.fingerprints([long, long[:40_000] + "edit" + long[40_000:]])
    assert ctph.likeness([a], [b])[0] > 0.8 and ctph.likeness([a], [a]) == [1.0]
    one = ctph.fingerprint_edits(frame(spark, [(7, "abcdef")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert ctph.fingerprint_edits(frame(spark, [])).isEmpty()
    with pytest.raises(ValueError):
        ctph.fingerprint_edits(frame(spark, docs).withColumn("doc_id", F.col("doc_id").cast("string")))
    few = ctph.fingerprint_edits(frame(spark, docs), bucket_rows=3).collect()  # more buckets than eight for each shuffle partition
    assert sorted(map(tuple, few), key=repr) == sorted(map(tuple, got), key=repr)


def test_line_dedup(spark):
    r = random.Random(6)
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 10**6)) for _ in range(n)) + "."
    passage = [line(9) for _ in range(8)]
    short = ["Hi.", "Share this."]
    rows = []
    for i in range(12):
        own = [line(r.randint(3, 20)) for _ in range(6)]
        if i in (2, 5, 9):  # a passage of over 50 words, in the middle of a line in one case
            own[3:3] = [" ".join(passage)] if i == 5 else passage
        rows.append((i, "\n".join(own + short) if i != 5 else " ".join(own) + "\n" + short[0]))
    rows += [(20, rows[1][1]), (21, None), (22, ""), (23, "\n\n \n"), (4, rows[4][1]), (None, line(40))]
    out = {x.doc_id: x for x in linededup.dedup_lines(frame(spark, rows)).collect()}
    kept = {i: t for i, t in rows}
    for i in (5, 9):
        assert not any(p in out[i].text for p in passage) and out[i].n_removed >= 8
    for i in (0, 1, 2, 3, 4, 6, 7, 8, 10, 11, 21, 22, 23, None):
        assert out[i].text == kept[i] and out[i].n_removed == 0, i
    assert out[20].text == "" and out[21].n_lines == 0 and out[22].n_lines == 0
    assert set(out[5].asDict()) == {*DOCS.replace(",", "").split()[::2], "n_lines", "n_removed"}
    assert linededup.dedup_lines(frame(spark, [])).isEmpty()


def fingerprint_by_bytes(text):
    """One text, byte by byte, with Python's integers."""
    data, m32, m64 = text.encode(), (1 << 32) - 1, (1 << 64) - 1
    weights, base = [int(w) for w in ctph._WEIGHTS], 0x9E3779B97F4A7C15
    levels = []
    for i in range(len(data)):
        h = sum((data[i - j] + 1) * weights[j] for j in range(ctph.ROLL) if j <= i) & m32
        h ^= h >> 15
        h = h * 0x2C1B3C6D & m32
        h ^= h >> 13
        levels.append(next(k for k in range(32) if (h | 1 << 31) >> k & 1))
    own = next(k for k in range(32) if sum(x >= k for x in levels) < ctph.LONGEST)
    out = [str(own)]
    for level in range(own, own + ctph.LEVELS):
        ends = sorted({i + 1 for i, x in enumerate(levels) if x >= level} | {len(data)}) if data else []
        sign = ""
        for lo, hi in zip([0, *ends], ends, strict=False):
            h = sum((data[k] + 1) * pow(base, k - lo, 1 << 64) for k in range(lo, hi)) & m64
            h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & m64
            h = (h ^ h >> 29) * 0xC4CEB9FE1A85EC53 & m64
            sign += ctph.ALPHABET[(h ^ h >> 32) & 63]
        out.append(sign)
    return ":".join(out)


def test_fingerprints_by_bytes(spark):
    r = random.Random(12)
    texts = ["", "a", "é", "ab" * 300] + [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 500))) for _ in range(25)]
    assert ctph.fingerprints(texts) == [fingerprint_by_bytes(t) for t in texts]
    found = {x.doc_id: x.fingerprint for x in ctph.fingerprint_documents(frame(spark, [*enumerate(texts), (99, None)])).collect()}
    assert found == {**dict(enumerate(map(fingerprint_by_bytes, texts))), 99: fingerprint_by_bytes("")}


def lines_of(text):
    """Lines by a scan over characters."""
    out, begin = [], 0
    for i in range(1, len(text)):
        behind = text[i - 1] in "\n。！？" or (i > 1 and text[i - 1] == " " and text[i - 2] in ".!?")
        if behind and not text.startswith(("\n", "\r\n"), i):
            out.append(text[begin:i])
            begin = i
    return out + [text[begin:]] if text else []


def every_run(rows, least=12):
    """doc_id -> (number of lines, number deleted, text left): all runs of lines that are not blank are compared as strings."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, gone = lines_of(t or ""), set()
        bare = [x.strip(" \t\r\n") for x in lines]
        full = [k for k, x in enumerate(bare) if x]
        for lo in range(len(full)):
            for hi in range(lo, min(lo + least + 4, len(full))):
                run = tuple(bare[k] for k in full[lo : hi + 1])
                if sum(-(-len(x.encode()) // 6) for x in run) >= least:
                    if run in seen:
                        gone.update(full[lo : hi + 1])
                    seen.add(run)
        for k, x in enumerate(bare):
            before, after = [j for j in full if j < k][-1:], [j for j in full if j > k][:1]
            if not x and before and after and before[0] in gone and after[0] in gone:
                gone.add(k)
        out[i] = (len(lines), len(gone), t if t is None else "".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def same_lines(spark, rows):
    found = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in linededup.dedup_lines(frame(spark, rows)).collect()}
    want = every_run(rows)
    assert found == want
    return found


def test_line_dedup_finds_every_run(spark):
    """Random documents of few lines against brute force: fragments stand alone before the passages that hold them."""
    r = random.Random(8)
    pool = [" ".join(f"{c}word{k}" for k in range(n)) + "." for c, n in zip("abcdefgh", (20, 8, 20, 4, 15, 5, 3, 11), strict=True)]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.7 else f"own {i} {k}." for k in range(r.randint(1, 9)))) for i in range(40)]
    rows += [(40, "\n".join(pool[:3])), (41, "\n".join(pool[:3])), (42, "x.\n" * 40), (43, None), (44, ""), (45, "\n".join(pool)), (None, pool[1] + "\n" + pool[4])]
    same_lines(spark, rows)


def test_line_dedup_of_short_lines_spaces_and_ties(spark):
    """Lines lighter than a window, blank lines, equal lines in a row, sentences without spaces, cut marks in texts."""
    r = random.Random(9)
    ends = [". ", "! ", "? ", "\n", "\r\n", "\n\n", "。", "！", " ", "\n \n", ".", "  ", "\x1f", "\r\n\r\n", "\t\n"]
    words = ["a", "ab", "abcdefg", "abcdefghijklmnop", "語言語言", "é" * 5, "x" * 60, ""]
    rows = [(i, "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(100, "z. " * 50), (101, "z. " * 50), (102, "\n \n" * 30), (103, "\n \n" * 30), (104, " lead. tail"), (105, "天" * 30 + "。" + "地" * 30 + "。"), (106, "天" * 30 + "。" + "人" * 30 + "。")]
    found = same_lines(spark, rows)
    assert found[102][1] == found[103][1] == 0 and found[106][2] == "人" * 30 + "。" and found[101][2] == ""


def test_line_dedup_of_lines_with_blank_ones_between(spark):
    """Forty short lines, each followed by lines of space, repeated whole with other space: all go, the space around them stays."""
    rows = [(0, "".join(f"s{k}\n \n\t\n" for k in range(40))), (1, "own line\n\n" + "".join(f"s{k}\n \n  \n \n" for k in range(40)) + "the end of it"), (2, "\n".join(f"s{k}" for k in range(39, -1, -1)))]
    found = same_lines(spark, rows)
    assert found[1][1] == 40 + 39 * 3 and found[1][2].startswith("own line") and found[1][2].endswith("the end of it") and "s7" not in found[1][2] and found[2][1] == 0


def test_line_dedup_where_pairs_of_lines_stood_before(spark):
    """A passage of 96 words whose pairs of lines stand in eleven earlier documents: the second whole copy goes whole."""
    passage = [" ".join(f"w{k}x{j}" for j in range(8)) + "." for k in range(12)]
    rows = [(k, f"only {k}.\n{passage[k]}\n{passage[k + 1]}\nlast {k}.") for k in range(11)]
    rows += [(50, "one.\n" + "\n".join(passage)), (51, "two.\n" + "\n".join(passage) + "\nend.")]
    assert same_lines(spark, rows)[51][2] == "two.\nend."


def test_line_dedup_of_a_frequent_line_and_a_long_text(spark):
    """A line of half of all documents, and one text of 60,000 lines that repeats another."""
    hot = " ".join(f"common{k}" for k in range(15)) + "."
    rows = [(i, f"document {i}.\n{hot}\nsome own words {i}.") for i in range(3000)]
    long = "\n".join(f"line {k} has its number {k * 7}." for k in range(60000))
    out = {x.doc_id: x for x in linededup.dedup_lines(frame(spark, [*rows, (5000, long), (5001, "new.\n" + long)])).collect()}
    assert out[0].text == rows[0][1] and all(out[i].text == f"document {i}.\nsome own words {i}." for i in range(1, 3000))
    assert out[5000].text == long and out[5001].text == "new.\n"


def test_line_dedup_keeps_columns(spark):
    """Names used inside, repeated rows with and without doc_id, and counts under other names."""
    t = " ".join(f"t{k}" for k in range(40)) + "."
    rows = [(1, t, 7, "k", 1), (1, t, 7, "k", 1), (None, t, 8, "m", 2), (None, t, 9, "m", 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_removed int, key string, ranges int")
    docs = docs.withColumns({c: F.lit(c) for c in ("doc", "th", "units", "n_lines", "_key", "_units", "_starts", "_ranges", "h", "row")})
    out = linededup.dedup_lines(docs, into=("lines out", "lines gone"))
    assert out.columns == [*docs.columns, "lines out", "lines gone"]
    assert sorted((x.doc_id or 0, x.text, x.n_removed, x["lines gone"], x["_key"]) for x in out.collect()) == [(0, t, 8, 0, "_key"), (0, t, 9, 0, "_key"), (1, "", 7, 1, "_key"), (1, "", 7, 1, "_key")]
    assert set(linededup.dedup_lines(docs).columns) == set(docs.columns)


@pytest.mark.parametrize("shingle,percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components(spark, shingle, percent):
    r = random.Random(shingle)
    rows = []
    for g in range(12):
        base = [r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 7)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                t[r.randrange(len(t))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(t)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE\ttwo"), (204, "one two three"), (205, rows[0][1]), (2, rows[2][1]), (206, " \n"), (207, "q " * 2000)]

    def sets(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)]) if w else frozenset()

    s = [sets(t) for _, t in rows]
    up, n_links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                up[find(i)] = find(j)
                n_links[i] += 1
                n_links[j] += 1
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    want = sorted((d, len(s[i]), low[find(i)] if s[i] else d) for i, (d, _) in enumerate(rows))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.similar_components(frame(spark, rows), shingle, percent).collect())
    assert got == want
    counted, links = jaccard.similar_links(frame(spark, rows), shingle, percent)
    found = counted.collect()
    assert sorted((x.doc_id, x.n_shingles, x.n_links) for x in found) == sorted((d, len(s[i]), n_links[i]) for i, (d, _) in enumerate(rows))
    of = {x.set_id: s[k] for x in found for k, (d, t) in enumerate(rows) if d == x.doc_id and x.set_id is not None and len(s[k]) == x.n_shingles}
    assert len(links.distinct().collect()) == links.count() and all(x.a < x.b for x in links.collect())
    assert {x.set_id for x in found if x.n_shingles} == set(of) and {x.set_id for x in found if not x.n_shingles} == {None}


def test_index_keys_share_one(spark):
    """Any two sets that reach the threshold share an index key, whatever is frequent."""
    rng = np.random.default_rng(0)
    for n in (2, 3, 8, 31, 33, 120, 300):
        for _ in range(10):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            gone = int(rng.integers(0, max(1, len(x) // 12) + 1))
            y = np.unique(np.r_[x[rng.permutation(len(x))[gone:]], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 20) + 1)), dtype=np.uint64)])
            both = len(np.intersect1d(x, y))
            if 100 * both < 85 * (len(x) + len(y) - both):
                continue
            for share in (0, 0.5, 1):
                frequent = np.sort(x[rng.random(len(x)) < share])
                assert len(np.intersect1d(jaccard.index_keys(x, frequent, 85), jaccard.index_keys(y, frequent, 85))) or np.array_equal(x, y)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 200), (200, 150)], "a bigint, b bigint")
    got = {x.node: x.component for x in _graph.components(links).collect()}
    assert all(got[i] == 0 for i in range(31)) and {got[i] for i in (100, 150, 200)} == {100}
    assert _graph.components(links.limit(0)).isEmpty()


def test_bpe_equals_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    r = random.Random(8)
    letters = [chr(c) for c in [*range(32, 0x180), 0x3A3, 0x130, 0x1C89, 0x3000, 0x85, 0x1F600, 0x4E2D, 0x301, 0xB2, 0x323B0, 9, 10, 0x1C]]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(300)] + ["aaaaaaaaaaaaaaaa" * 40, "it's <|endoftext|>they'll", "", None, "ΑΣ ΑΣΑ"]
    rows = bpe.encode_documents(frame(spark, list(enumerate(texts))), path, ["doc_id"]).collect()
    assert len(rows) == len(texts)
    for x in rows:
        e = t.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        assert x.ids == e and x.n_tokens == len(e) and x.ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()
    coded = spark.createDataFrame([(1, rows[0].ids), (2, None)], "doc_id int, ids array<int>")
    back = {x.doc_id: x.text for x in bpe.decode_documents(coded, path, ["doc_id"]).collect()}
    assert back == {1: t.decode(rows[0].ids, skip_special_tokens=False), 2: None}


def test_bpe_of_long_words_and_odd_tables(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    r = random.Random(15)
    long = "".join(r.choice("etaoinshrdlu") for _ in range(20_000))
    docs = frame(spark, [(1, long), (1, long), (2, "a" * 5000), (None, None)]).withColumn("n_tokens", F.lit("x"))
    rows = bpe.encode_documents(docs, path, ["doc_id"]).collect()
    assert sorted(len(x.ids) for x in rows) == sorted(len(t.encode(s, add_special_tokens=False).ids) for s in (long, long, "a" * 5000, ""))
    assert next(x.ids for x in rows if x.doc_id == 1) == t.encode(long, add_special_tokens=False).ids
    assert bpe.encode_documents(docs.limit(0), path, ["doc_id"]).isEmpty()


def auc(y, s):
    order = np.argsort(np.argsort(s)) + 1
    pos = y.sum()
    return (order[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_bpe_of_a_very_long_word():
    """A word of 200,000 letters in seconds, as the library encodes it."""
    from tokenizers import Tokenizer

    path = tokenizer_path()
    v, library, r = bpe.Vocabulary.read(path), Tokenizer.from_file(path), random.Random(4)
    for word in ("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "a" * 50_001, "ab" * 20_000 + "é" * 3001):
        began = time.time()
        got = bpe.encode_words([b"x", word.encode(), b"yz"], v)
        assert time.time() - began < 20 and got[1].tolist() == library.encode(word, add_special_tokens=False).ids
        assert got[0].tolist() == library.encode("x", add_special_tokens=False).ids and got[2].tolist() == library.encode("yz", add_special_tokens=False).ids
    assert bpe.Vocabulary.read(path) is v
    for size in (1, 2, 3, 50, 400):
        word = "".join(r.choices("abé's", k=size)).encode()
        data = np.frombuffer(word, np.uint8)
        sym = v.inner[data]
        sym[-1] = v.final[data[-1]]
        assert bpe.merge_long(sym.tolist(), v) == bpe.encode_words([word], v)[0].tolist()


def test_bpe_columns_of_any_name(spark):
    names = ["_text", "_ids", "text", "beside x", "token", "doc"]
    docs = spark.createDataFrame([("Hello world", 1)], "body string, doc_id int").withColumns({n: F.lit(f"v {n}") for n in names})
    out = bpe.encode_documents(docs, tokenizer_path(), ["doc_id", *names], text="body")
    assert out.columns == ["doc_id", *names, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    row = out.first()
    assert all(row[n] == f"v {n}" for n in names) and row.n_tokens == 2
    back = bpe.decode_documents(out, tokenizer_path(), ["_text", "_ids"], into="again").first()
    assert back._text == "v _text" and back.again.replace("</w>", "") == "hello world"
    with pytest.raises(ValueError):
        bpe.encode_documents(docs.withColumn("n_tokens", F.lit(1)), tokenizer_path(), ["n_tokens"], text="body")


def test_language(spark):
    r = random.Random(9)
    sound = {"aa": "kalomi", "bb": "strend", "cc": "üßöchw"}
    say = lambda lang, n: " ".join("".join(r.choice(sound[lang]) for _ in range(r.randint(2, 7))) for _ in range(n))
    rows = [(i, say(lang, r.randint(2, 40)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    train = spark.createDataFrame(rows[:120] + [(900, None, "aa"), (901, "x", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(train)
    test = spark.createDataFrame([*[(i, t) for i, t, _ in rows[120:]], (500, None), (501, "123 !?"), (502, "")], "doc_id bigint, text string")
    got = {x.doc_id: x for x in langid.identify(test, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[120:]]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502)) and all(0 <= x.score <= 1 for x in got.values())
    for k in (2, 4, 9):
        code = langid.codewords(k)
        assert len({tuple(c) for c in code}) == k
    empty = langid.fit(train.limit(0))
    assert {x.lang_pred for x in langid.identify(test, empty).collect()} == {"und"}


def test_sample_of_a_key_that_repeats(spark):
    """One doc_id in all rows: the sample is limited, and texts are no part of what is limited."""
    from shiftweight.llm import _features

    rows = spark.range(3000).select(F.lit(5).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    chosen, bound = _features.sampled(rows, "lang", 3000, "doc_id")
    x, names = _features.collect_features(chosen, "lang", _features.letter_grams, 64, 100)
    assert bound == 6000 and x.shape == (100, 64) and names == ["en"] * 100 and np.isfinite(x).all()


def test_language_decoding_by_loops(spark):
    """Nearest codeword by plain loops; codes tell all languages apart by many bits; odd tables."""
    r = np.random.default_rng(13)
    for k in range(2, 8):
        code = langid.codewords(k)
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) == max(1, 2 ** (k - 2))
    k, dims = 4, 12
    m = langid.LanguageModel(list("abcd"), langid.codewords(k), r.normal(size=(dims, 7)), r.normal(size=7), r.uniform(0.2, 1, 7))
    x = r.normal(size=(40, dims))
    best, score, lead = m.decode(x)
    for i in range(40):
        margin = [sum(x[i, d] * m.weights[d, b] for d in range(dims)) + m.bias[b] for b in range(7)]
        loss = [sum(m.trust[b] * np.log1p(np.exp(-m.code[c, b] * margin[b])) for b in range(7)) for c in range(k)]
        p = sorted(np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum())
        assert best[i] == int(np.argmin(loss)) and np.isclose(score[i], p[-1]) and np.isclose(lead[i], p[-1] - p[-2])
    docs = frame(spark, [(1, "kalomi kalomi"), (1, "kalomi kalomi"), (2, "strend"), (None, None)]).withColumn("lang", F.when(F.col("doc_id") == 1, "aa").when(F.col("doc_id") == 2, "bb")).withColumn("lang_pred", F.lit("x"))
    model = langid.fit(docs)
    assert sorted(x.lang_pred for x in langid.identify(docs, model).collect()) == ["aa", "aa", "bb", "und"]
    assert langid.identify(docs.limit(0), model).isEmpty() and langid.fit(docs.limit(0)).languages == []


def test_quality_by_loops(spark):
    """Tails by plain loops; thresholds that fit make mean tails the shares of the grades; odd tables."""
    r = random.Random(14)
    make = lambda g: " ".join(r.choice(WORDS) + "!" * (r.random() < (0.5, 0.3, 0.1)[g]) for _ in range(30))
    rows = [(i, make(i % 3), i % 3) for i in range(300)]
    docs, ratings = frame(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id bigint, grade int")
    model = quality.fit(docs, ratings, steps=400)
    data, off = _text.buffers(pa.array([t for _, t, _ in rows]))
    x = quality.shapes_and_words(data, off, quality.DIMS)
    tails = [[1 / (1 + np.exp(-(sum(float(a) * float(b) for a, b in zip(row, model.weights, strict=True) if a) - t))) for t in model.thresholds] for row in x]
    assert np.abs(np.mean(tails, axis=0) - [2 / 3, 1 / 3]).max() < 0.02
    got = {q.doc_id: q for q in quality.rate(docs.withColumn("selected", F.lit(1)), model, least_grade=2).collect()}
    assert all(np.isclose(got[i].expected_grade, sum(tails[i]), atol=1e-4) and np.isclose(got[i].tail_probability, tails[i][1], atol=1e-4) for i in range(300))
    hot = docs.filter("doc_id < 30").unionByName(spark.range(5000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("so! hot!").alias("text")), allowMissingColumns=True)
    assert quality.rate(hot, quality.fit(hot, ratings, most_per_grade=50)).count() == 5030
    assert quality.rate(docs.limit(0), model).isEmpty() and not quality.fit(docs.limit(0), ratings).weights.any()


def test_quality_is_ordinal(spark):
    r = random.Random(10)
    junk = ["%s!!!", "%s | x", "%s###"]
    make = lambda g: " ".join((r.choice(junk) % r.choice(WORDS)) if r.random() < (0.6, 0.3, 0.02)[g] else r.choice(WORDS) for _ in range(60))
    rows = [(i, make(i % 3), i % 3) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id bigint, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows[:150]] + [(None, 1), (5, None)], "doc_id bigint, grade int")
    model = quality.fit(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 2
    got = {x.doc_id: x for x in quality.rate(docs, model).collect()}
    e = [np.mean([got[i].expected_grade for i, _, g in rows[150:] if g == k]) for k in range(3)]
    assert e[0] < e[1] < e[2] and len(got) == 242
    assert auc(np.array([int(g >= 1) for _, _, g in rows[150:]]), np.array([got[i].tail_probability for i, _, _ in rows[150:]])) > 0.9
    assert quality.fit(docs, ratings.filter("grade = 1")).tails(np.zeros((1, quality.DIMS))).tolist() == [[0.5]]


def test_toxicity(spark):
    r = random.Random(11)
    bad = ["vile", "rotten", "nasty"]

    def make(toxic):
        w = [r.choice(WORDS) + r.choice("abcdef") for _ in range(r.randint(10, 60))]
        for _ in range(r.randint(1, 3) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        return " ".join(w)

    rows = [(i, make(i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:250]] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert 3 <= len(model.lexicon.hashes) < 30 and len(toxicity.fit(docs, labels, most_words=2).lexicon.hashes) == 2
    got = {x.doc_id: x.score for x in toxicity.score(docs, model, ["doc_id"]).collect()}
    y, s = np.array([y for _, _, y in rows[250:]]), np.array([got[i] for i, _, _ in rows[250:]])
    assert auc(y, s) > 0.97 and ((s >= 0.5) == y).mean() > 0.95 and got[900] < 0.5 and got[901] < 0.5 and len(got) == 402
    one_class = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert max(x.score for x in toxicity.score(docs, one_class, ["doc_id"]).collect()) < 0.5


def planted_votes(r, n=20000):
    """Class and votes: five independent voters of known rates, and three copies of the first one."""
    rates = np.array([[0.02, 0.6], [0.05, 0.5], [0.1, 0.7], [0.2, 0.45], [0.01, 0.3]])
    y = r.random(n) < 0.2
    v = (r.random((n, 5)) < rates[:, 1] * y[:, None] + rates[:, 0] * ~y[:, None]).astype(float)
    return y, rates, np.hstack([v, np.repeat(v[:, :1], 3, axis=1)])


def test_label_model_finds_accuracies_and_correlations():
    """EM from ten labelled rows of a class recovers planted rates; copies of a voter share its weight."""
    y, rates, v = planted_votes(np.random.default_rng(4))
    some = np.r_[np.flatnonzero(y)[:10], np.flatnonzero(~y)[:40]]
    gold, ones = toxicity.class_sums(v[some], np.ones(len(some)), y[some].astype(float)), np.ones(len(v))
    model = toxicity.estimate(gold, lambda m: toxicity.class_sums(v, ones, m.posterior(v)), lambda m: toxicity.pair_sums(v, ones, m.posterior(v)), rounds=20)
    start = np.abs(toxicity.rates_of(gold)[:5] - rates).max()
    assert np.abs(model.rates[:5] - rates).max() < 0.75 * start
    assert model.share[0] < 0.3 and (model.share[5:] < 0.3).all() and (model.share[1:5] > 0.7).all()
    assert auc(y.astype(int), model.posterior(v)) > 0.8
    # Gradual counting: equal rows counted once give the same sums.
    rows, n = np.unique(v, axis=0, return_counts=True)
    assert np.allclose(toxicity.class_sums(rows, n, model.posterior(rows)), toxicity.class_sums(v, ones, model.posterior(v)))


def test_label_model_sums_in_spark(spark):
    y, _, v = planted_votes(np.random.default_rng(5), 500)
    packed = [(np.packbits(row.astype(bool)).tobytes(), 1) for row in v]
    table = spark.createDataFrame(packed, "v binary, n bigint").groupBy("v").agg(F.sum("n").alias("n"))
    model = toxicity.LabelModel(np.full((8, 2), (0.1, 0.4)), np.ones(8), 0.3)
    ones, p = np.ones(len(v)), model.posterior(v)
    assert np.allclose(toxicity._summed(table, model, False), toxicity.class_sums(v, ones, p))
    assert np.allclose(toxicity._summed(table, model, True), toxicity.pair_sums(v, ones, p))


def scores_by_loops(docs, labels):
    """Scores by the rules, in loops and dense arrays: lexicon, votes, label model and classifier over all documents."""
    texts = dict(docs)
    rated = {i: y for i, y in labels if y is not None and i in texts}
    toxic = [i for i in rated if rated[i]]
    have = defaultdict(lambda: [0, 0])
    for i, y in rated.items():
        for x in set(words(texts[i])):
            have[x][y] += 1
    base, support, lexicon = len(toxic) / len(rated), max(2, min(5, len(toxic) // 10)), []
    for x, (c, t) in have.items():
        g = 2 * sum(k * np.log(k / ((c + t) * p)) for k, p in ((t, base), (c, 1 - base)) if k)
        if t >= support and t >= 3 * c and g >= toxicity.LEAST_RATIO:
            lexicon.append((-(t + 0.1) / (t + c + 1) * np.log1p(t), x))
    lexicon = [x for _, x in sorted(lexicon)]

    def row(t):
        t = t or ""
        w = words(t)
        found = [w.count(x) for x in lexicon]
        total, kinds, size = sum(found), sum(k > 0 for k in found), max(len(w), 1)
        upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
        patterns = [kinds >= 2, kinds >= 4, total > 0 and total * 50 >= size, total > 0 and total * 200 >= size, upper > lower, t.count("!") * 10 > size]
        return [*(k > 0 for k in found), *patterns, kinds == 0], [np.log1p(kinds), np.floor(16 * min(10, 100 * total / size)) / 16]

    v, c = (np.array(x, float) for x in zip(*(row(t) for t in texts.values()), strict=True))
    of = {i: k for k, i in enumerate(texts)}
    at, gold, one = [of[i] for i in rated], np.array(list(rated.values()), float), np.ones(len(v))
    model = toxicity.estimate(toxicity.class_sums(v[at], np.ones(len(at)), gold), lambda m: toxicity.class_sums(v, one, m.posterior(v)), lambda m: toxicity.pair_sums(v, one, m.posterior(v)))
    want, x = model.posterior(v), np.hstack([v, c, one[:, None]])
    pull, w = np.r_[np.full(x.shape[1] - 1, toxicity.RIDGE), 1e-9], np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(pull), x.T @ (p - want) / len(x) + pull * w)
        w -= step * min(1, 4 / np.abs(step).max())
    slope, shift = toxicity.calibration((x @ w)[at], gold, np.ones(len(at)))
    return lexicon, dict(zip(texts, 1 / (1 + np.exp(-(slope * (x @ w) + shift))), strict=True))


def test_toxicity_by_loops(spark):
    r = random.Random(21)
    bad = ["vile", "Rotten", "nasty", "FOUL"]
    make = lambda toxic: " ".join([r.choice(WORDS) + r.choice("abcd") for _ in range(r.randint(1, 50))] + ["!" * r.randint(0, 4)] + [r.choice(bad) for _ in range(r.randint(1, 4) if toxic and r.random() < 0.9 else 0)])
    docs = [(i, make(i % 4 == 0)) for i in range(300)] + [(800, None), (801, ""), (802, "VILE !!!"), (803, "word " * 3000 + "nasty")]
    labels = [(i, int(i % 4 == 0)) for i in range(160)] + [(5, None), (9999, 1)]
    model = toxicity.fit(frame(spark, docs).repartition(5), spark.createDataFrame(labels, "doc_id bigint, toxic int").dropDuplicates(["doc_id"]))
    got = {x.doc_id: x.score for x in toxicity.score(frame(spark, docs), model, ["doc_id"]).collect()}
    lexicon, want = scores_by_loops(docs, labels[:160])
    assert len(lexicon) == len(model.lexicon.hashes) >= 4 and got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in got) < 2e-3
    w = _text.words(*_text.buffers(pa.array([" ".join(lexicon)])), _text.WORD_ALNUM)
    assert model.lexicon.voters[np.searchsorted(model.lexicon.hashes, w.hashes)].tolist() == list(range(len(lexicon)))


def test_toxicity_pools_words_and_keeps_odd_tables(spark):
    """Words behind the first 512 vote in pools; empty tables, repeated rows and clashing names are no trouble."""
    words = np.random.default_rng(1).integers(1, 1 << 63, 2000).astype(np.uint64)
    lexicon = toxicity.lexicon_of(words)
    assert lexicon.size <= toxicity.LEXICON + toxicity.POOLS and sorted(set(lexicon.voters)) == list(range(lexicon.size))
    docs = frame(spark, [(i, "vile words here" if i % 3 == 0 else "the cat sat down") for i in range(60)] + [(3, "vile words here")] * 3 + [(None, None), (61, "")])
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(50)], "doc_id bigint, toxic int"))
    out = toxicity.score(docs, model, docs.columns, into="a score").collect()
    assert len(out) == 65 and all((x["a score"] >= 0.5) == ("vile" in (x.text or "")) and x.key == "key" for x in out)
    none = toxicity.fit(docs.limit(0), spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, toxic int"))
    assert toxicity.score(docs.limit(0), none, ["doc_id"]).count() == 0 and toxicity.score(docs, none, ["doc_id"]).count() == 65


def test_warc(spark, tmp_path):
    pages = [(0, "http://a.example/ä b", "<p>x</p>"), (1, None, None), (2, "http://b.example/\r\nX: y", ""), (3, "u", "<p>x</p>"), (4, "u", "é" * 70_000), (3, "u", "<p>x</p>"), (None, "n", "<p>x</p>"), (5, "z", "\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(2)
    rows = warc.round_trip(df).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    assert len(rows) == len(pages)
    for x in rows:
        h = next((h or "") for i, _, h in pages if i == x.page_id)
        assert x.payload_bytes == len(h.encode())
        assert x.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert (x.record_type, x.refers_to) == (("response", None) if x.page_id == first[h] else ("revisit", first[h]))
        assert x.payload is None if x.record_type == "revisit" else bytes(x.payload) == h.encode()
    folder = str(tmp_path / "w")
    made = warc.write_archives(df, folder)
    assert made.agg(F.sum("records")).first()[0] == len(pages)
    name = next((tmp_path / "w").glob("*.warc.zst"))
    raw = name.read_bytes()
    assert struct.unpack_from("<I", raw)[0] == warc.DICTIONARY_MAGIC and len(list(warc.frames(raw))) >= 1
    with pytest.raises(ValueError):
        list(warc.frames(raw[:-5]))
    good = warc.record("response", "1", "u", b"abc", "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5", None, "1970-01-01T00:00:00Z", 3)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good.replace(b"abc", b"abd"), good[:-1], good.replace(b"WARC-Date", b"WARC-Data"), b"junk"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    plain = zstandard.ZstdCompressor().compress(good) * 2  # archives without dictionary are read too
    assert list(warc.frames(plain)) == [good, good]
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(empty).isEmpty()


def test_warc_of_a_shared_payload_and_archives_left_behind(spark, tmp_path):
    """Half of the pages are empty; what a lost attempt has written is not read."""
    rows = [(i, f"http://x/{i}", None if i % 4 == 0 else "" if i % 2 == 0 else f"<p>{i}</p>") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(c) for c in ("sha1", "n", "first", "copy", "payload", "uri")})
    folder = str(tmp_path / "w")
    listed = warc.write_archives(pages, folder)
    name = listed.first().archive
    (tmp_path / "w" / ("part-000099-000000007-" + name[-18:])).write_bytes((tmp_path / "w" / name).read_bytes())
    back = warc.read_listed(listed, folder).collect()
    assert sorted(int(x.page) for x in back) == list(range(400)) and warc.read_archives(spark, folder).count() > 400
    assert sum(x.record_type == "revisit" for x in back) == 199 and {x.refers_to for x in back if x.record_type == "revisit"} == {"0"}


def test_window_lengths_are_those_of_a_plain_sum(spark):
    from shiftweight.llm import linededup

    rng = np.random.default_rng(5)
    weights = [[int(v) for v in rng.integers(1, 13, n)] for n in (0, 1, 2, 3, 4, 9, 40)] + [[1] * 30, [12, 1], [1, 1, 10], [1, 1, 9]]
    length = lambda w, i: next((j - i + 1 for j in range(i, len(w)) if sum(w[i : j + 1]) >= 12), None)
    column = linededup._lengths(F.col("w"), 12)
    rows = spark.createDataFrame([(w,) for w in weights], "w array<int>").select("w", column.alias("n")).collect()
    assert all(r.n == [length(r.w, i) for i in range(len(r.w))] for r in rows)
    # Windows of two and three lines are found without folding a slice: 'get' was not in the expression before.
    assert str(column._jc.toString()).count("get(") >= 3
