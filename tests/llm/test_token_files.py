"""Token-id files: encoding against the tokenizers library, grammar and files by round trips."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiftweight.llm import pretokens, repair
from shiftweight.llm._store import shared_folder
from shiftweight.llm.queries import BYTE_TOKENIZER, tokenizer_path

PATH = tokenizer_path(BYTE_TOKENIZER)
LETTERS = list("  \t\n'''stmdrevlabAB12.,!éñß中　²½Ⅷ🙂́​\x1c\x85\x00") + ["<|", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return pretokens.Encoder(pretokens.read_tokenizer(PATH), pretokens.character_classes())


def test_encoding_equals_the_library(library, encoder):
    r = random.Random(0)
    for _ in range(150):
        texts = ["".join(r.choices(LETTERS, k=r.randint(0, 40))) for _ in range(20)] + ["", None]
        got = []
        for _, _, ids, sizes in encoder.encode_column(pa.array(texts)):
            got += np.split(ids, np.cumsum(sizes)[:-1])
        for t, ids in zip(texts, got, strict=True):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_encoding_with_little_memory(library, encoder, monkeypatch):
    monkeypatch.setattr(pretokens, "MEMORY", 50)
    monkeypatch.setattr(pretokens, "BATCH", 64)
    texts = [f"word{i} of text {i * 7919}" for i in range(60)]
    got = [x for _, _, ids, sizes in encoder.encode_column(pa.array(texts)) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        pretokens.read_tokenizer(tokenizer_path())


@pytest.mark.parametrize("vocabulary", [300, 50_257, 70_000])
def test_grammar_gives_all_ids_back(vocabulary):
    r = np.random.default_rng(vocabulary)
    cases = [r.integers(0, 7, 5000), np.zeros(1001, int), np.tile([5, 6, 7, 5], 900), r.integers(0, vocabulary, 3000), np.array([], int), np.array([3]), np.r_[np.zeros(40, int), np.tile([vocabulary - 1, 0], 300)]]
    for ids in cases:
        s = repair.compress(ids.astype(np.int32), vocabulary)
        back = repair.Shard.frombytes(s.tobytes(), vocabulary, len(s.rules), len(s.symbols))
        assert (back.expand(back.symbols) == ids).all() and len(back.expand(back.symbols)) == len(ids)
        # Each rule's length is what it expands to, and each rule pays.
        assert all(len(back.expand(np.array([vocabulary + k]))) == n for k, n in enumerate(back.lengths))
        for _ in range(20 if len(ids) else 0):
            a, b = sorted(r.integers(0, len(ids) + 1, 2))
            assert (back.read(a, b) == ids[a:b]).all() and len(back.read(a, b)) == b - a
    assert len(repair.compress(cases[2], vocabulary).symbols) < 230 and len(repair.compress(cases[1], vocabulary).symbols) < 80
    with pytest.raises(ValueError):
        repair.Shard.frombytes(s.tobytes()[:-1], vocabulary, len(s.rules), len(s.symbols))


def test_rules_replace_pairs_one_after_the_other():
    """By loops: undoing the rules, last one first, gives the ids; no rule is made for rare pairs."""
    ids = np.random.default_rng(3).integers(0, 5, 2000)
    s = repair.compress(ids, 100)
    out = s.symbols.tolist()
    for k in reversed(range(len(s.rules))):
        out = [x for y in out for x in (s.rules[k].tolist() if y == 100 + k else [y])]
    assert out == ids.tolist() and (s.rules < 100 + np.arange(len(s.rules))[:, None]).all()
    assert len(repair.compress(np.arange(90), 100).rules) == 0


def frame(spark, rows, kind="bigint"):
    return spark.createDataFrame([(i, t, 1, 2, 3, "f") for i, t in rows], f"doc_id {kind}, text string, part int, place int, start int, file string")


def wanted(library, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]
    start = np.r_[0, np.cumsum([len(x) for x in ids])][:-1]
    return rows, ids, start


def test_files_round_trip(spark, library, monkeypatch):
    r = random.Random(1)
    rows = [(r.randrange(-500, 500) * 3, "".join(r.choices(LETTERS, k=r.randint(0, 200)))) for _ in range(120)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(None, "no name"), (2000, None), (2001, ""), (2002, "long words and " * 4000)]
    _, ids, start = wanted(library, rows)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    for shard, file in ((1 << 20, 1 << 25), (500, 900)):
        monkeypatch.setattr(repair, "SHARD_IDS", shard)
        monkeypatch.setattr(repair, "FILE_IDS", file)
        monkeypatch.setattr(repair, "TASK_BYTES", 20_000)
        folder = shared_folder(spark)
        files = repair.write_token_files(frame(spark, rows).repartition(4), folder, PATH)
        got = sorted(repair.read_token_files(files, folder, frame(spark, rows).schema["doc_id"].dataType).collect(), key=lambda x: x.start)
        assert [x.doc_id for x in got] == [i for i, _ in order] and [x.start for x in got] == start.tolist()
        assert [x.n_tokens for x in got] == [len(x) for x in ids] and [x.ids_crc32 for x in got] == [zlib.crc32(x.tobytes()) for x in ids]
        assert all(bytes(x.ids) == y.tobytes() for x, y in zip(got, ids, strict=True))
        assert files.agg(F.sum("ids"), F.sum("docs")).first() == (sum(map(len, ids)), len(rows))


def test_random_access_and_damaged_files(monkeypatch, tmp_path):
    monkeypatch.setattr(repair, "SHARD_IDS", 100)
    r = np.random.default_rng(2)
    docs = [np.r_[r.integers(1, 9, n), 0] for n in (5, 0, 350, 40, 199, 1)]
    writer = repair.Writer(f"file://{tmp_path}", "t", 50)
    assert not list(writer.add(pa.array(["a", None, "c", "d", "e", "f"]), np.array([len(d) for d in docs]), np.concatenate(docs)))
    known = writer.close()
    raw = (tmp_path / known["file"]).read_bytes()
    assert len(raw) == known["bytes"] and known["docs"] == 6 and known["ids"] == sum(map(len, docs))
    reader = repair.Reader(pa.BufferReader(raw))
    assert all((reader.document(i) == d).all() for i, d in enumerate(docs)) and len(reader.shards) == 7
    whole = np.concatenate(docs)
    assert (reader.ids(90, 310) == whole[90:310]).all() and len(reader.ids(5, 5)) == 0
    assert reader.documents.column("doc_id").to_pylist() == ["a", None, "c", "d", "e", "f"]
    for bad in (raw[:-1], raw[:40], b"", raw[:-8] + b"RPAIRIDX"):
        with pytest.raises(ValueError):
            repair.Reader(pa.BufferReader(bad))
    assert isinstance(io.BytesIO(raw).read(8), bytes) and raw[:8] == repair.MAGIC


@pytest.mark.parametrize("kind", ["string", "int"])
def test_files_of_odd_tables(spark, library, kind):
    """Text doc_ids, repeated rows and doc_ids, nulls, no rows."""
    ids = ["b", "a", "a", None, None, "b"] if kind == "string" else [2, 1, 1, None, None, 2]
    rows = list(zip(ids, ["x y", "same", "same", None, "z", "other"], strict=True))
    got = sorted(repair.round_trip(frame(spark, rows, kind), PATH).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == [None, None, *sorted(i for i in ids if i is not None)]
    assert sorted((x.doc_id is None, x.doc_id, x.ids_crc32) for x in got if x.doc_id) == sorted((False, i, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in rows if i)
    assert [x.start for x in got] == np.r_[0, np.cumsum([x.n_tokens for x in got])][:-1].tolist()
    empty = repair.round_trip(frame(spark, [], kind).limit(0), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_one_doc_id_for_all_rows_is_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(repair, "TASK_BYTES", 4_000)
    folder = shared_folder(spark)
    docs = spark.range(400).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    files = repair.write_token_files(docs.repartition(3), folder, PATH)
    assert files.select("part").distinct().count() > 4 and files.agg(F.max("docs")).first()[0] < 200
    out = repair.read_token_files(files, folder, docs.schema["doc_id"].dataType, ids=False)
    assert out.agg(F.count("*"), F.countDistinct("start"), F.min("start")).first() == (400, 400, 0)
