"""The pipeline's stages on planted cases."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents: clean ones, toxic ones, a passage of over 50 words in three, near copies, one benchmark leak."""
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    line = lambda n=12: " ".join(word() for _ in range(n)) + "."
    text = lambda k=8: "\n".join(line() for _ in range(k))
    docs = {i: text() for i in range(120)}
    for i in range(0, 40):
        docs[i] += " vile rotten"
    item = " ".join(word() for _ in range(30))
    docs[60] += "\n" + item[: len(item)] + "\n" + line()
    passage = " ".join(line(14) for _ in range(4))
    for i in (70, 80, 90):
        docs[i] += "\n" + passage
    docs[101] = docs[100]
    near = docs[110].split(" ")
    # Words change often enough that no run of 12 words is left, rarely enough for a shingle similarity near zero: kept.
    docs[111] = " ".join(w if k % 6 else word() for k, w in enumerate(near))
    d = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(500, None, None, None, None), (501, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 40)) for i in range(0, 120, 1) if i not in (2, 5)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, passage


def test_stages(spark, folder):
    d, docs, passage = folder
    found = {}
    rows = corpus_pipeline.table(spark, d, "documents")
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.written(stage(spark, rows, d))
        found[name] = {x.doc_id: x for x in rows.collect()}
        if name != "bpe":
            assert rows.columns == columns
    clean = set(range(40, 120)) | {500, 501}
    assert set(found["toxicity"]) == clean
    lines = found["line_dedup"]
    assert set(lines) == clean - {101}
    assert passage in lines[70].text and passage not in lines[80].text and passage not in lines[90].text
    assert all(lines[i].text == docs[i] for i in range(40, 120) if i not in (80, 90, 101)) and lines[80].n_chars == len(lines[80].text)
    assert set(found["near_duplicates"]) == clean - {101}
    assert set(found["decontamination"]) == clean - {101, 60}
    assert set(found["bpe"]) == set(found["decontamination"]) and found["bpe"][501].ids == []


def test_lines_whose_parts_stood_alone_before(spark):
    """A passage of lines of 20, 8 and 20 words whose long lines stand alone in earlier documents: all of the second copy goes."""
    rows = []
    for k in range(12):
        a, b, c = (" ".join(f"{x}{k}w{i}" for i in range(n)) + "." for x, n in (("a", 20), ("b", 8), ("c", 20)))
        rows += [(k, f"{a}\nalone {k}."), (100 + k, f"{c}\nalone {k}."), (200 + k, f"start {k}.\n{a}\n{b}\n{c}\nend {k}."), (300 + k, f"first {k}.\n{a}\n{b}\n{c}\nlast {k}.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {x.doc_id: x.text for x in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    for k in range(12):
        assert found[300 + k] == f"first {k}.\nlast {k}." and f"\nb{k}w0 " in found[200 + k] and found[k] == rows[4 * k][1]


def test_near_duplicates_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(3, base), (1, base.replace("w7 ", "x ")), (2, base), (9, "other words that stand alone here"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 4, 5, 9]


def test_near_duplicates_tell_groups_apart_without_doc_ids(spark):
    """Null doc_ids and a doc_id that stands on unlike texts: only documents that link make a group."""
    base, lone = " ".join(f"w{i}" for i in range(300)), [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, lone[0]), (None, lone[1]), (None, lone[1]), (None, base), (7, base), (None, base.replace("w7 ", "x ")), (8, lone[2]), (8, lone[3]), (8, lone[3] + " z"), (None, lone[4]), (None, lone[4] + " z"), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [(x.doc_id, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    whole = [(7, base), (8, lone[2]), (8, ""), (None, lone[0]), (None, lone[1]), (None, None)]
    assert len(found) == len(whole) + 2 and set(whole) < set(found)
    assert sum(i == 8 and t.startswith("d0 ") for i, t in found) == 1 and sum(i is None and (t or "").startswith("e0 ") for i, t in found) == 1


def test_run_equals_the_stages(spark, folder):
    d, docs, _ = folder
    assert {x.doc_id for x in corpus_pipeline.run(spark, d).collect()} == (set(range(40, 120)) | {500, 501}) - {101, 60}


def test_stages_on_odd_tables(spark, folder):
    """Columns called as what stages use inside, null and repeated doc_ids, repeated rows, empty tables."""
    d, docs, passage = folder
    names = "toxicity n_lines n_removed key units ranges doc i h th k_id k_th h_id h_th component scored n_tokens ids ids_sha256 decoded_sha256 n_words spans _key _th _text _ids".split()
    kept = docs[100].split(" ", 1)[1]
    rows = [(7, docs[50]), (7, docs[51]), (7, docs[51]), (None, docs[52]), (None, kept), (None, None), (8, ""), (8, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit(f"x {n}") for n in names})
    have = table
    for name, stage in corpus_pipeline.STAGES:
        have = corpus_pipeline.written(stage(spark, have, d))
        got = have.collect()
        assert all(x[n] == f"x {n}" for x in got for n in names if name != "bpe" or n in ("toxicity", "n_removed", "component", "_key", "_text", "_ids")), name
        if name != "bpe":
            assert have.columns == table.columns
            # Repeated rows are one document for line dedup and one row behind near duplicates.
            want = [r for r in rows if r != (7, docs[51])] + [(7, docs[51])] * (2 if name in ("toxicity", "line_dedup") else 1)
            assert sorted((x.doc_id or -1, x.text or "") for x in got) == sorted((i or -1, t or "") for i, t in want), name
    assert len(got) == 7
    none = table.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = corpus_pipeline.written(stage(spark, none, d))
        assert none.isEmpty(), name


def test_texts_are_cut_once_for_the_result(spark, folder):
    """The filter on what is left must not be moved below the place where texts are put together, which would make its lines again."""
    d, docs, _ = folder
    table = spark.createDataFrame([(i, t, None) for i, t in sorted(docs.items())], "doc_id bigint, text string, n_chars bigint")
    plan = dict(corpus_pipeline.STAGES)["line_dedup"](spark, table, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "Filter ((made" in plan
