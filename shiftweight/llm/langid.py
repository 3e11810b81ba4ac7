"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit predicts it from hashed runs of one to three bytes.
Decoding takes the codeword with the least loss, each bit weighted by how much its classifier can be trusted.
Up to seven languages get the exhaustive code; more get a random one of 15 log2(K) bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._features import adam, sampled, collect_features, feature_blocks, letter_grams, sigmoid

DIMS = 2048
UNDETERMINED = "und"


def codewords(k: int) -> np.ndarray:
    """(k, bits) of -1 and +1; distinct rows, no constant and no repeated column."""
    if k == 1:
        return np.ones((1, 1), np.float32)
    if k <= 7:
        bits = np.array([[(c >> (k - 1 - i)) & 1 for c in range(1, 1 << (k - 1))] for i in range(k)])
    else:
        draw = np.random.default_rng(k)
        bits = max((draw.integers(0, 2, (k, int(np.ceil(15 * np.log2(k))))) for _ in range(200)), key=lambda b: min((b[i] != b[j]).sum() for i in range(k) for j in range(i)))
    return (2.0 * bits - 1).astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (dims, bits)
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability-like score, and the lead over the second."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -c * margin) * self.trust).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        ranked = np.sort(p, axis=1)
        second = ranked[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return p.argmax(axis=1), ranked[:, -1], ranked[:, -1] - second


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most_per_language: int = 1000, steps: int = 150) -> LanguageModel:
    """Fit on about ``most_per_language`` rows of each language (chosen by hash of doc_id), whole texts.

    Rows without text or language teach nothing. Without any row the model has no language.
    """
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    chosen, bound = sampled(rows, "lang", most_per_language, "doc_id")
    x, names = collect_features(chosen, "lang", letter_grams, DIMS, bound)
    languages = sorted(set(names))
    if not languages:
        return LanguageModel([], np.zeros((0, 1), np.float32), np.zeros((DIMS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    code = codewords(len(languages))
    of = np.array([languages.index(s) for s in names])
    want = (code[of] + 1) / 2
    weight = (len(of) / (len(languages) * np.bincount(of, minlength=len(languages))))[of].astype(np.float32)[:, None]
    scale = 1 / (x.std(axis=0) + 0.01)

    def gradient(p: list[np.ndarray]) -> list[np.ndarray]:
        error = weight * (sigmoid((x * scale) @ p[0] + p[1]) - want) / len(x)
        return [scale[:, None] * (x.T @ error) + 2e-4 * p[0], error.sum(axis=0)]

    bits = code.shape[1]
    w, b = adam(gradient, [np.zeros((DIMS, bits), np.float32), np.zeros(bits, np.float32)], steps, 0.05)
    right = ((((x * scale) @ w + b) > 0) == (want > 0.5)).mean(axis=0)
    right = np.clip(right, 0.55, 0.999)
    return LanguageModel(languages, code, (w * scale[:, None]).astype(np.float32), b, np.log(right / (1 - right)).astype(np.float32) / np.log(999))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id", ambiguous_below: float = 0.2) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every whole text, one row per input row.

    A text that is null or has no letter is ``und`` with score 0, as is everything if the model has no language.
    ``ambiguous`` marks a lead of less than ``ambiguous_below`` over the second language. Only the text is used;
    other columns are ignored, whatever their names, and repeated rows give a row each.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            best, score, lead = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            if m.languages:
                for a, b, x in feature_blocks(batch.column("text"), letter_grams, DIMS):
                    best[a:b], score[a:b], lead[a:b] = m.decode(x)
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False)) & bool(m.languages)
            names = [m.languages[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(~letters | (lead < ambiguous_below))], ["doc_id", "lang_pred", "score", "ambiguous"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]))
