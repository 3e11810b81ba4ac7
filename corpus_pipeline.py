"""Training-data pipeline over ``documents``: each stage applies one operator of shiftweight.llm.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents`` (the last one
returns token ids). Its result is written as Parquet in the shared folder and read again for the next stage.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftweight.llm import bpe, decontam, jaccard, linededup, toxicity
from shiftweight.llm._store import written
from shiftweight.llm.queries import remainder, table, tokenizer_path

#: The toxicity stage learns from labelled rows, which SQL cannot express.
ORACLE_SQL = None
#: Score from which a document is rejected.
TOXIC_FROM = 0.5
#: Near duplicates: word shingles and similarity in percent.
SHINGLE, PERCENT = 5, 80
WINDOW = 10


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for k in itertools.count() if (n := name + "_" * k) not in taken) for name in names]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, i, h): whole rows as one struct, so that no column clashes, with doc_id and a hash of the text."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("i"), F.xxhash64(docs["text"].cast("string")).alias("h"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects; it learns from labels outside the held-out fifth.

    Null and empty texts are scored as texts without toxic words. Repeated rows are scored alike.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0))
    (score,) = _unused(docs, "toxicity")
    return toxicity.score(docs, model, docs.columns, into=score).filter(F.col(score) < TOXIC_FROM).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated runs of lines from later documents; drop documents of which nothing is left.

    Null, empty and blank texts lose nothing and stay. Rows equal in doc_id and text are one document and stay together.
    ``n_chars`` is that of the text left.
    """
    lines, removed = _unused(docs, "n_lines", "n_removed")
    out = linededup.dedup_lines(docs, into=(lines, removed)).filter((F.col(removed) == 0) | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group (null ones last); documents without words all stay.

    Groups are told apart by what links, so null and repeated doc_ids merge nothing. Of rows equal in doc_id and text one
    stays.
    """
    found = jaccard.similar_components(docs, SHINGLE, PERCENT)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th"))
    kept = found.filter("n_shingles > 0").groupBy("component").agg(first.alias("k")).select(F.col("k.doc_id").alias("k_id"), F.col("k.th").alias("k_th"))
    blank = F.btrim(F.coalesce(F.col("doc")["text"].cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    rows = _keyed(docs)
    words = rows.filter(~blank).join(kept, F.col("i").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_th"))).dropDuplicates(["i", "h"])
    return words.select("doc.*").unionByName(rows.filter(blank).select("doc.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of ``WINDOW`` words of a benchmark item; texts without words stay."""
    hits = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), WINDOW).filter("n_hit > 0").select(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th"))
    return _keyed(docs).join(hits, F.col("i").eqNullSafe(F.col("h_id")) & F.col("h").eqNullSafe(F.col("h_th")), "left_anti").select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the text decoded from them; columns of these names are replaced."""
    made = ("text", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    return bpe.encode_documents(docs, tokenizer_path(), [c for c in docs.columns if c not in made])


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; the result of each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
