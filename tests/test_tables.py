"""Sources, sinks, manifests, text functions and run tables."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftweight.functions import text as S
from shiftweight.functions import vectors as V
from shiftweight.operators import prep, runs
from shiftweight.sources import files


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_manifest_and_mismatch(spark, tmp_path):
    for dom, classes in {"Clipart": ["bike", "sofa"], "Product": ["bike", "oven"]}.items():
        for c in classes:
            (tmp_path / dom / c).mkdir(parents=True)
            for i in range(4):
                (tmp_path / dom / c / f"img_{i}.jpg").write_bytes(b"x" * (i + 1))
            (tmp_path / dom / c / "notes.txt").write_text("no image")
    m = files.read_image_manifest(spark, str(tmp_path))
    assert m.count() == 16 and m.select("domain").distinct().count() == 2
    bad = {(r.class_name, r.missing_in) for r in prep.class_mismatch(m.filter("domain = 'Clipart'"), m.filter("domain = 'Product'")).collect()}
    assert bad == {("sofa", "target"), ("oven", "source")}
    with pytest.raises(ValueError):
        prep.assert_same_classes(m.filter("domain = 'Clipart'"), m.filter("domain = 'Product'"))
    prep.assert_same_classes(m, m)
    ids = prep.sample_index(m.select("path")).orderBy("path").collect()
    assert [r.sample_id for r in ids] == list(range(16))


def test_labels(spark):
    df = spark.createDataFrame([(0,), (2,), (-100,), (1,), (5,)], "label int")
    assert [r.label for r in prep.label_violations(df, 3, -100).collect()] == [5]
    prep.assert_labels_dropped(prep.drop_labels(df))
    prep.assert_labels_dropped(df.limit(0))
    with pytest.raises(ValueError):
        prep.assert_labels_dropped(df)
    logits = spark.createDataFrame([([1.0, 2.0, 3.0], y) for y in (0, 2, -100, 1)], "x array<double>, y int")
    r = logits.select(V.cross_entropy(F.col("x"), F.col("y"), -100).alias("c")).agg(F.count("c").alias("n"), F.avg("c").alias("m")).first()
    assert r.n == 3 and 0 < r.m < 10


def test_run_files(spark, tmp_path):
    root = tmp_path / "runs"
    for run, ok in (("r1", True), ("r2", False)):
        d = root / "office" / "Ar2Cl" / "dann" / run
        (d / "logs").mkdir(parents=True)
        (d / "state.json").write_text(json.dumps({"completed": ok, "run_id": run}) if ok else "{broken")
        (d / "logs" / "stderr.txt").write_text("" if ok else "x" * 1000 + "boom")
        if ok:
            (d / "metrics.csv").write_text("dataset,src,tgt,method,run_id,seed,source_acc,target_acc\noffice,Ar,Cl,dann,r1,0,80.5,33.1\noffice,Ar,Cl,dann,r1,0,81.5,34.1\n")
    first, last = (files.read_metrics_csv(spark, str(root), pick).collect() for pick in ("first", "last"))
    assert first[0].target_acc == 33.1 and last[0].target_acc == 34.1 and first[0].dir_run_id == "r1" and first[0].dir_method == "dann"
    assert [r.run_id for r in files.read_run_json(spark, str(root)).collect()] == ["r1"]
    tails = {r.file.split("/")[-3]: r.tail for r in files.read_log_tail(spark, f"{root}/*/*/*/*/logs/stderr.txt").collect()}
    assert len(tails["r2"]) == 800 and tails["r2"].endswith("boom")
    expected = spark.createDataFrame([("office", "Ar", "Cl", "dann", r) for r in ("r1", "r2", "r3")], "dataset string, src string, tgt string, method string, run_id string")
    art = spark.createDataFrame([("office", "Ar", "Cl", "dann", "r1", True, True, True, True, ""), ("office", "Ar", "Cl", "dann", "r2", False, False, False, True, "boom")], "dataset string, src string, tgt string, method string, run_id string, has_metrics boolean, completed boolean, has_state boolean, dir_exists boolean, stderr_tail string")
    assert {r.run_id: r.run_status for r in runs.collect_expected_runs(expected, art).collect()} == {"r1": "OK", "r2": "FAILED", "r3": "NOT RUN"}


def test_write_and_read(spark, tmp_path):
    w = spark.createDataFrame([(1, 0.5)], "sample_id int, w double")
    files.write_weights(w, w, str(tmp_path / "w"))
    assert files.read_weights(spark, str(tmp_path / "w"))[0].count() == 1
    files.write_features(w.withColumn("domain", F.lit("a")), str(tmp_path / "f"))
    assert files.read_features(spark, str(tmp_path / "f")).count() == 1
    with pytest.raises(ValueError):
        files.write_features(w.limit(0), str(tmp_path / "g"))
    files.write_summary(w, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 1


def test_upsert(spark):
    new = spark.createDataFrame([("a", 2, 1)], "run_id string, v int, row_no int")
    old = spark.createDataFrame([("a", 1, 0), (None, 7, 1), ("", 7, 2), (" ", 8, 3), (" a", 9, 4), ("b\t", 5, 5), ("b", 6, 6)], "run_id string, v int, row_no int")
    out = runs.upsert_rows(old, new).collect()
    assert sorted(r.v for r in out) == [2, 6, 7, 8] and all(r.run_id.strip() for r in out)
    again = runs.upsert_rows(runs.upsert_rows(old, new), new).collect()
    assert sorted(r.run_id for r in again) == sorted(r.run_id for r in out)
    with pytest.raises(Exception, match="without key"):
        runs.upsert_rows(old, spark.createDataFrame([("", 2, 1)], "run_id string, v int, row_no int")).collect()


def test_upsert_into_a_table_without_key(spark):
    """Rows get the hash of their JSON; columns of the new side come first."""
    old = spark.createDataFrame([("é", "1", 0), ("é", "1", 1), (None, "2", 2)], "z string, b string, row_no int")
    out = runs.upsert_rows(old, spark.createDataFrame([("k", "3", 0)], "run_id string, b string, row_no int"))
    assert out.columns == ["run_id", "b", "row_no", "z"]
    key = lambda row: hashlib.sha1(json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:10]
    assert sorted((r.run_id, r.row_no) for r in out.collect()) == sorted([(key({"z": "é", "b": "1"}), 1), (key({"z": "", "b": "2"}), 2), ("k", 0)])


def test_run_ids(spark):
    made = lambda config: one(spark, S.encode_run_id(F.lit(json.dumps(config))).alias("x")).x
    a = {"dataset": "office home", "algorithm": "a/b", "lr": 0.001, "seed": 1}
    assert made(a) == made(dict(reversed(a.items())))
    assert made(a).startswith("ds=officehome__alg=a-b__seed=1__lr=0.001__h=") and len(made(a).split("h=")[1]) == 8
    full = {"meiis_K": 5, "weight_decay": 0.0, "lr": 0.001, "pretrained": True, "seed": 0, "algorithm": "ME_IIS", "eval_split": "test", "split_mode": "uda_target", "dataset": "camelyon17", "meiis_tau": None, "other": "x"}
    assert made(full).startswith("ds=camelyon17__split=uda_target__eval=test__alg=ME_IIS__seed=0__pt=1__lr=0.001__wd=0__K=5__h=")
    odd = {"algorithm": "  é ü  ", "lr": 1e-7, "weight_decay": 123456789.0, "optimizer": "a\\b+c=d", "pretrained": False}
    assert made(odd).startswith("alg=-__pt=0__opt=a\\b-c=d__lr=1e-07__wd=1.23457e08__h=")
    h = one(spark, S.run_hash(F.lit(json.dumps(a))).alias("h")).h
    assert h == hashlib.sha1(S.canonical_json(a).encode()).hexdigest()[:10]
    m = one(spark, S.decode_run_id(F.lit(made(full))).alias("m")).m
    assert m["split_mode"] == "uda_target" and m["pretrained"] == "1" and m["meiis_K"] == "5" and "meiis_tau" not in m


def test_checkpoint_names(spark):
    part = lambda v: F.lit(v)
    name = lambda method, adapted: one(spark, S.make_ckpt_name(part(method), part("d"), part("Ar"), part("Rw"), part(3), part(50), part(10), part(32), adapted).alias("n")).n
    adapted = {"layers": F.array(part("layer3"), part("layer4")), "gmm_max": part(6), "iis_tol": part("1e-05")}
    assert name("dann", adapted) == name("dann", None) == "dann__d__Ar2Rw__seed3__Esrc50__Ead10__bs32.pt"
    long = name("me_iis", adapted)
    assert long == "me_iis__d__Ar2Rw__seed3__Esrc50__Ead10__bs32__layerslayer3-layer4__gmm2-6__iis15-1e-05.pt"
    c = one(spark, S.decode_ckpt_name(F.lit("some/where/" + long)).alias("c")).c
    assert (c.raw, c.method, c.src, c.tgt, c.seed, c.epochs_source, c.batch_size) == (long[:-3], "me_iis", "Ar", "Rw", 3, "50", "32")
    assert (c.gmm_min, c.gmm_max, c.iis_iters, c.iis_tol, c.error) == (2, 6, 15, 1e-05, None)
    for bad in ("x.pt", "a__b__ArCl__seed1__Esrc1__Ead1__bs1.pt", "a__b__A2B__seedx__Esrc1__Ead1__bs1.pt", None):
        assert one(spark, S.decode_ckpt_name(F.lit(bad).cast("string")).alias("c")).c.error == "unable to decode"


def test_shared_class_index(spark):
    rows = [(d, c) for d in ("A", "D", "W") for c in ("mug", "bike", "pen")] + [("X", "mug")]
    m = spark.createDataFrame(rows, "domain string, class_name string")
    for pair in (("D", "A"), ("W", "D")):
        assert {r.class_name: r.idx for r in prep.shared_class_index(m, *pair).collect()} == {"bike": 0, "mug": 1, "pen": 2}
    with pytest.raises(ValueError):
        prep.shared_class_index(m, "X", "D")


def test_sample_index_of_ties_and_nulls(spark):
    rows = [(None,)] * 3 + [("m",)] * 50 + [(f"k{i:04d}",) for i in range(500)]
    out = prep.sample_index(spark.createDataFrame(rows, "path string").repartition(7), range_rows=2).collect()
    assert sorted(r.sample_id for r in out) == list(range(553))
    assert [r.path for r in sorted(out, key=lambda r: r.sample_id)] == sorted((r[0] for r in rows), key=lambda v: (v is not None, v or ""))
    assert prep.sample_index(spark.createDataFrame([], "path string")).count() == 0


def test_components_map(spark):
    layers = F.array(*map(F.lit, ["layer3", "layer4", "avgpool"]))
    get = lambda over: one(spark, S.components_map(layers, 5, F.lit(over)).alias("m")).m
    assert get("") == {"layer3": 5, "layer4": 5, "avgpool": 5}
    assert get(" avgpool: 2 ,layer3:11") == {"layer3": 11, "layer4": 5, "avgpool": 2}
    assert get("4, 6,12") == {"layer3": 4, "layer4": 6, "avgpool": 12}
    for bad in ("4,6,12,1", "stem:3", "avgpool:-1"):
        with pytest.raises(Exception):
            get(bad)


def test_vectors(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, V.entropy_weight(a(0.99, 0.005, 0.005)).alias("sure"), V.entropy_weight(a(0.34, 0.33, 0.33)).alias("unsure"), V.l2_normalize(a(0, 0)).alias("z"), V.is_finite(a(1, "nan")).alias("f"))
    assert r.sure > r.unsure and r.z == [0.0, 0.0] and not r.f
    with pytest.raises(Exception, match="negative"):
        one(spark, V.row_normalize(a(-1, 2)).alias("x"))
    with pytest.raises(Exception, match="unknown domain"):
        one(spark, S.normalize_domain_code(F.lit("Sketch")).alias("x"))


def test_registered_queries_have_their_sql():
    from shiftweight import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_broken_optional_parts_are_not_hidden(monkeypatch):
    """Without the corpus operators the entry imports; if one of them cannot be imported for another reason, it fails."""
    import importlib
    import sys

    import __spark_entry__ as E

    def without(name, missing):
        with monkeypatch.context() as m:
            for k in [k for k in sys.modules if k.startswith(("shiftweight.llm", "corpus_pipeline", "__spark_entry__"))]:
                m.delitem(sys.modules, k)

            class Finder:
                @staticmethod
                def find_spec(full, path=None, target=None):
                    if full.startswith(name):
                        raise ModuleNotFoundError(f"no {missing}", name=missing)

            m.setattr(sys, "meta_path", [Finder, *sys.meta_path])
            return importlib.import_module("__spark_entry__")

    found = without(("shiftweight.llm", "corpus_pipeline"), "shiftweight.llm")
    assert found.llm is None and found.corpus_pipeline is None and "t1_low_entropy_keep" in found.queries() and "pipeline" not in found.queries()
    with pytest.raises(ModuleNotFoundError):
        without("shiftweight.llm", "some_library")
    assert E.queries().keys() >= found.queries().keys()


def test_dry_runs_of_scoring(spark):
    from shiftweight.operators import scoring

    df = spark.range(100).select("id", F.array(F.col("id").cast("double")).alias("x"))
    scorer = scoring.LinearScorer(np.array([[2.0]]), np.array([1.0]))
    assert scoring.score(df, scorer, "x").count() == 100 and scoring.score(df, scorer, "x", max_batches=3, batch_rows=4).count() == 12
    with pytest.raises(ValueError):
        scoring.score(df.limit(0), scorer, "x", max_batches=1)


def test_experiment_tables_write_the_best_runs(spark, tmp_path):
    from shiftweight.plans import jobs

    expected = spark.createDataFrame([("d", "a", "b", m, f"{m}{k}", 0, "f") for m in ("source_only", "y") for k in range(3)], "dataset string, src string, tgt string, method string, run_id string, seed int, fingerprint string")
    metrics = lambda m, k: {"val": {"acc_avg": str(k / 10)}, "test": {"acc": "0.5"}} if (m, k) != ("y", 2) else {"val": {"loss": "9"}}
    rows = [("d", "a", "b", m, f"{m}{k}", True, True, True, True, None, 50.0 + k, metrics(m, k)) for m in ("source_only", "y") for k in range(3)]
    artifacts = spark.createDataFrame(rows, "dataset string, src string, tgt string, method string, run_id string, has_metrics boolean, completed boolean, has_state boolean, dir_exists boolean, stderr_tail string, target_acc double, metrics map<string,map<string,string>>")
    out = jobs.experiment_tables(expected, artifacts, ["source_only", "y"], str(tmp_path / "best"))
    assert {r.method: (r.run_id, r.val_score, r.val_metric_key, r.test_score) for r in out["best"].collect()} == {"source_only": ("source_only2", 0.2, "acc_avg", 0.5), "y": ("y1", 0.1, "acc_avg", 0.5)}
    text = spark.read.text(str(tmp_path / "best"), wholetext=True).first().value
    assert '"SOURCE_ONLY": {' in text and '"val_metric_key":"acc_avg"' in text and out["status"].count() >= 1


def test_checkpoint_names_are_decoded_once_a_row(spark, data):
    from shiftweight.plans import check_runs

    plan = check_runs.QUERIES["f16_decode_ckpt_name"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    # Ten results of one name: its splits stood 139 times in the plan, anew in each result.
    assert plan.count("split(") <= 2 and plan.count("filter(") <= 3
