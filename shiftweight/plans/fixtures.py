"""Views of the given tables as operator inputs: features from embeddings, runs from events, manifests from documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import one_hot
from ..operators.iis import Constraints
from ..operators.latent import SphereModel, all_responsibilities, responsibilities
from ..operators.prep import sample_index

KAPPA = 20.0
CLASSES = 10
CONSTRAINTS = Constraints({"l0": 4, "l1": 3}, CLASSES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, domain, label, feat (64) and the two layers l0, l1 (32 each); the target lacks half the high labels."""
    e = table(spark, d, "embeddings").filter((F.col("vec_id") % 3 != 0) | (F.col("label") < 5) | (F.col("vec_id") % 2 == 0))
    feat = F.col("embedding").cast("array<double>")
    domain = F.when(F.col("vec_id") % 3 != 0, "source").otherwise("target")
    return e.select(F.col("vec_id").alias("sample_id"), domain.alias("domain"), "label", feat.alias("feat"), F.slice(feat, 1, 32).alias("l0"), F.slice(feat, 33, 32).alias("l1"))


def centroids(rows: DataFrame) -> np.ndarray:
    """Mean source vector per class (10 x 64 numbers)."""
    d = 64
    means = rows.filter("domain = 'source'").groupBy("label").agg(F.array(*[F.avg(F.get("feat", i)) for i in range(d)]).alias("mu")).orderBy("label")
    return np.array([r.mu for r in means.collect()])


def with_probs(rows: DataFrame) -> DataFrame:
    return responsibilities(rows, SphereModel(centroids(rows), KAPPA), "feat", "probs")


def prototypes(rows: DataFrame) -> dict[str, SphereModel]:
    """First target rows by sample_id as prototypes of each layer."""
    first = rows.filter("domain = 'target'").orderBy("sample_id").limit(4).collect()
    return {name: SphereModel(np.array([r[name] for r in first[:k]]), KAPPA) for name, k in CONSTRAINTS.layers.items()}


def scored(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, domain, label, feat, probs, and the responsibilities as l0 (4) and l1 (3)."""
    rows = samples(spark, d)
    layers = {name: (name, model) for name, model in prototypes(rows).items()}
    return all_responsibilities(rows, {"probs": ("feat", SphereModel(centroids(rows), KAPPA))} | layers)


def source_target(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Source rows with one-hot labels as probs, target rows with their softmax."""
    rows = scored(spark, d)
    return rows.filter("domain = 'source'").withColumn("probs", one_hot(F.col("label"), CLASSES)), rows.filter("domain = 'target'")


def batches(rows: DataFrame, size: int = 32) -> DataFrame:
    """batch_no within each domain by sample_id; ids are numbered by ranges."""
    ids = [sample_index(rows.filter(F.col("domain") == d).select("sample_id"), "sample_id", "no") for d in ("source", "target")]
    return rows.join(ids[0].unionByName(ids[1]).select("sample_id", F.floor(F.col("no") / size).cast("long").alias("batch_no")), "sample_id")


FEATURES_SQL = """
WITH s AS (SELECT vec_id AS sample_id, CASE WHEN vec_id % 3 <> 0 THEN 'source' ELSE 'target' END AS domain, label, [v::DOUBLE FOR v IN embedding] AS feat FROM embeddings WHERE vec_id % 3 <> 0 OR label < 5 OR vec_id % 2 = 0),
cent AS (SELECT class, list(m ORDER BY i) AS mu FROM (SELECT class, i, avg(v) AS m FROM (SELECT label AS class, unnest(feat) AS v, generate_subscripts(feat, 1) AS i FROM s WHERE domain = 'source') GROUP BY class, i) GROUP BY class),
pz AS (SELECT sample_id, domain, label, class, 20::DOUBLE * list_inner_product(feat, mu) / sqrt(list_inner_product(feat, feat) * list_inner_product(mu, mu)) AS z FROM s, cent),
pe AS (SELECT *, exp(z - max(z) OVER (PARTITION BY sample_id)) AS e FROM pz),
probs AS (SELECT sample_id, domain, label, class, e / sum(e) OVER (PARTITION BY sample_id) AS p FROM pe),
pl AS (SELECT sample_id, domain, label, list(p ORDER BY class) AS probs, max(p) AS conf, arg_max(class, p) AS pred, -sum(p * ln(greatest(p, 1e-12))) AS h FROM probs GROUP BY sample_id, domain, label),
tr AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS k FROM s WHERE domain = 'target'),
proto AS (SELECT 'l0' AS layer, k AS component, feat[1:32] AS mu FROM tr WHERE k < 4 UNION ALL SELECT 'l1', k, feat[33:64] FROM tr WHERE k < 3),
lv AS (SELECT sample_id, domain, label, 'l0' AS layer, feat[1:32] AS x FROM s UNION ALL SELECT sample_id, domain, label, 'l1', feat[33:64] FROM s),
gz AS (SELECT sample_id, domain, label, lv.layer, component, 20::DOUBLE * list_inner_product(x, mu) / sqrt(list_inner_product(x, x) * list_inner_product(mu, mu)) AS z FROM lv JOIN proto ON lv.layer = proto.layer),
ge AS (SELECT *, exp(z - max(z) OVER (PARTITION BY sample_id, layer)) AS e FROM gz),
gamma AS (SELECT sample_id, domain, label, layer, component, e / sum(e) OVER (PARTITION BY sample_id, layer) AS g FROM ge),
pg AS (SELECT layer, component, class, avg(g * p) AS pg FROM gamma JOIN probs USING (sample_id) WHERE gamma.domain = 'target' GROUP BY ALL),
f AS (SELECT sample_id, layer, component, label AS class, g FROM gamma WHERE domain = 'source'),
w0 AS (SELECT sample_id, 1.0::DOUBLE / count(*) OVER () AS w FROM s WHERE domain = 'source'),
b AS (SELECT s.*, (row_number() OVER (PARTITION BY domain ORDER BY sample_id) - 1) // 32 AS batch_no FROM s)
"""


def iis_sql(iterations: int) -> str:
    """CTEs w1, w2, ...: source weights after each unrolled iteration (two layers)."""
    out = []
    for i in range(iterations):
        out.append(f"m{i} AS (SELECT layer, component, class, sum(w * g) AS pm FROM f JOIN w{i} USING (sample_id) GROUP BY ALL)")
        out.append(f"d{i} AS (SELECT layer, component, class, ln(greatest(pg, 1e-12) / greatest(coalesce(pm, 0), 1e-12)) / 2 AS d FROM pg LEFT JOIN m{i} USING (layer, component, class))")
        out.append(f"u{i} AS (SELECT sample_id, any_value(w) * exp(sum(g * d)) AS w FROM f JOIN d{i} USING (layer, component, class) JOIN w{i} USING (sample_id) GROUP BY sample_id)")
        out.append(f"w{i + 1} AS (SELECT sample_id, w / sum(w) OVER () AS w FROM u{i})")
    return ",\n".join(out)


def features_sql(select: str, ctes: str = "") -> str:
    return FEATURES_SQL + (",\n" + ctes if ctes else "") + "\n" + select


DOMAINS = ["Ar", "Cl", "Pr", "Rw"]


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One row per event with two different domains: run_id, method, scores, status and fingerprint."""
    e = table(spark, d, "events")
    code = lambda c: F.get(F.array(*map(F.lit, DOMAINS)), (c % 4).cast("int"))
    i = F.col("event_id")
    status = F.get(F.array(*map(F.lit, ["OK", "done", "FAILED", "trained", "skipped", "INCOMPLETE", "failed: oom"])), (i % 7).cast("int"))
    rows = e.select(
        (i % 4000).cast("string").alias("run_id"), F.lit("office-home").alias("dataset"), code(F.col("user_id")).alias("src"), code(F.floor(F.col("user_id") / 4)).alias("tgt"),
        F.when(F.col("event_type") == "signup", "source_only").otherwise(F.col("event_type")).alias("method"), (i % 3).cast("int").alias("seed"), F.when(i % 17 != 0, F.least("value", F.lit(100.0))).alias("target_acc"),
        (F.col("value") / 500).alias("val_acc"), status.alias("status"), F.when(i % 5 == 0, "").otherwise((F.col("user_id") % 6).cast("string")).alias("fingerprint"), i.alias("row_no"),
    )
    return rows.filter(F.col("src") != F.col("tgt"))


RUNS_SQL = """
WITH ev AS (SELECT *, ['Ar', 'Cl', 'Pr', 'Rw'][user_id % 4 + 1] AS src, ['Ar', 'Cl', 'Pr', 'Rw'][(user_id // 4) % 4 + 1] AS tgt FROM events),
runs AS (SELECT CAST(event_id % 4000 AS VARCHAR) AS run_id, 'office-home' AS dataset, src, tgt, CASE WHEN event_type = 'signup' THEN 'source_only' ELSE event_type END AS method, (event_id % 3)::INTEGER AS seed,
 CASE WHEN event_id % 17 <> 0 THEN least(value, 100::DOUBLE) END AS target_acc, value / 500 AS val_acc,
 ['OK', 'done', 'FAILED', 'trained', 'skipped', 'INCOMPLETE', 'failed: oom'][event_id % 7 + 1] AS status, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id % 6 AS VARCHAR) END AS fingerprint, event_id AS row_no FROM ev WHERE src <> tgt)
"""


def runs_sql(select: str, ctes: str = "") -> str:
    return RUNS_SQL + (",\n" + ctes if ctes else "") + "\n" + select


def manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "lang", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return docs.select(path.alias("path"), F.col("lang").alias("domain"), F.col("source").alias("class_name"), "doc_id")


def splits(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ["train", "val", "test", "val_unlabeled", "test_unlabeled", "id_val"]))
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select(F.col("doc_id").alias("sample_id"), F.get(names, (F.col("doc_id") % 6).cast("int")).alias("split"), F.coalesce("quality", F.lit(-100)).alias("label"), F.col("toxic").cast("long").alias("metadata"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") > 500).cast("int").alias("pred"), F.col("lang").alias("grp"))


MANIFEST_SQL = """
WITH manifest AS (SELECT lang || '/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, lang AS domain, source AS class_name, doc_id FROM documents),
splits AS (SELECT d.doc_id AS sample_id, ['train', 'val', 'test', 'val_unlabeled', 'test_unlabeled', 'id_val'][d.doc_id % 6 + 1] AS split, coalesce(quality, -100) AS label, toxic::BIGINT AS metadata FROM documents d LEFT JOIN labels USING (doc_id)),
predictions AS (SELECT doc_id, quality AS label, (n_chars > 500)::INTEGER AS pred, lang AS grp FROM labels JOIN documents USING (doc_id))
"""


def manifest_sql(select: str) -> str:
    return MANIFEST_SQL + select
