"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctph, decontam, jaccard, langid, linededup, phrases, quality, repair, sharding, toxicity, warc, whitening

#: Where the public tokenizer files are; only the driver opens them.
TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS t, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, t, array_to_string(w[p:p + t - 1], ' ') AS g FROM iw),
dw AS (SELECT doc_id, t, unnest(generate_series(1, len(w) - t + 1)) AS p, w FROM d, (SELECT DISTINCT t FROM win) WHERE len(w) >= t),
dg AS (SELECT doc_id, t, p, array_to_string(w[p:p + t - 1], ' ') AS g FROM dw),
hit AS (SELECT doc_id, item_id, p, t FROM dg JOIN win USING (t, g)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + t - 1)) AS q FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


#: By definition, with whole strings: every run of lines that weighs 12 is looked up among all runs of the corpus. Lines of space
#: weigh nothing and are not numbered (j); each other line weighs one at least, so a window has 12 of them at most, and a longer
#: run is made of windows. A line of space goes if the numbered lines on both sides of it go.
OP4_SQL = r"""
WITH m AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text, chr(10), chr(10) || chr(31)), '. ', '. ' || chr(31)), '! ', '! ' || chr(31)), '? ', '? ' || chr(31)), '。', '。' || chr(31)), '！', '！' || chr(31)), '？', '？' || chr(31)) AS t FROM documents),
u AS (SELECT doc_id, list_filter(string_split(replace(replace(t, chr(31) || chr(10), chr(10)), chr(31) || chr(13) || chr(10), chr(13) || chr(10)), chr(31)), lambda s: s <> '') AS us FROM m),
l AS (SELECT doc_id, unnest(generate_series(1, len(us))) AS i, unnest(us) AS raw FROM u WHERE len(us) > 0),
y AS (SELECT doc_id, i, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS s, (strlen(trim(raw, ' ' || chr(9) || chr(10) || chr(13))) + 5) // 6 AS w FROM l),
x AS (SELECT *, count(*) FILTER (w > 0) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM y),
v AS (SELECT * FROM x WHERE w > 0),
r AS (SELECT a.doc_id, a.j AS lo, b.j AS hi, string_agg(c.s, chr(10) ORDER BY c.j) AS run FROM v a JOIN v b ON b.doc_id = a.doc_id AND b.j BETWEEN a.j AND a.j + 11 JOIN v c ON c.doc_id = a.doc_id AND c.j BETWEEN a.j AND b.j GROUP BY 1, 2, 3 HAVING sum(c.w) >= 12),
f AS (SELECT *, min((doc_id, lo)) OVER (PARTITION BY run) AS first FROM r),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(lo, hi)) AS j FROM f WHERE (doc_id, lo) > first),
z AS (SELECT x.*, g.j IS NOT NULL AND (x.w > 0 OR h.j IS NOT NULL) AS gone FROM x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.j = x.j LEFT JOIN gone h ON h.doc_id = x.doc_id AND h.j = x.j + 1),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, coalesce(string_agg(raw, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM z GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(removed, 0)::BIGINT AS n_removed, CASE WHEN text IS NOT NULL THEN strlen(coalesce(kept, ''))::BIGINT END AS kept_bytes, CASE WHEN text IS NOT NULL THEN md5(coalesce(kept, '')) END AS kept_md5
FROM documents LEFT JOIN k USING (doc_id)
"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"), shingle=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM t WHERE t.a = documents.doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id)
"""


def remainder(divisor: int):
    """crc32 of doc_id as text, modulo a number: the folds of the held-out queries."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 for low quality, 1 for good quality but toxic, 2 for good and clean; a fifth is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2))
    rated = labels.filter(remainder(5) != 0).select("doc_id", grade.alias("grade")).filter("grade IS NOT NULL")
    # Before the join with texts: the fit needs no more than 2,000 rows of a grade.
    model = quality.fit(docs, rated)
    return quality.rate(docs, model).withColumn("held_out", remainder(5) == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(F.col("doc_id").isNull() | (remainder(4) != 2)))
    return langid.identify(docs, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"], ids=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * k.a * n.n // (x.a::HUGEINT * y.a))::BIGINT AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT lang, array_to_string(w[j:j + q - 1], ' ') AS phrase, a FROM (SELECT *, unnest(generate_series(1, m - q + 1)) AS j FROM c, (SELECT unnest([2, 3, 4]) AS q) WHERE q < m)),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000
"""


def op12_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": OP1_SQL, "op4_line_dedup": OP4_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op10_warc": OP10_SQL, "op11_phrase_collocations": OP11_SQL}
