"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; every run of non-letters is one space. Its 2- and 3-grams are
hashed to ``2**bits`` buckets. Counts per language come from Spark and have at most
languages x buckets rows; the log-probability matrix is broadcast and each batch is
scored by row look-ups and segment sums.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import in_training_fold, map_arrow, table

BITS = 15
TRAIN_ROWS = 20_000
CHARS = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text of each, and whether a text has a letter."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) + 1 for t in low])
    owner = np.r_[0, np.repeat(np.arange(len(low)), size)]
    letter = _letters()[code]
    has = np.zeros(len(low), bool)
    has[owner[letter]] = True
    keep = letter | np.r_[True, letter[:-1]]  # one space after each run of letters
    keep |= np.r_[True, owner[1:] != owner[:-1]]
    c, own = np.where(letter, code, 32)[keep].astype(np.uint64), owner[keep]
    two = c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] + c[2:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(17)

    def bucket(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    whose2, whose3 = own[1:], own[2:]
    ok2, ok3 = (c[:-1] != 32) | (c[1:] != 32), (c[1:-1] != 32)
    at = np.r_[bucket(two)[ok2], bucket(three)[ok3]]
    return at, np.r_[whose2[ok2], whose3[ok3]], has


def _parts(texts: list[str | None], limit: int = CHARS):
    a = n = 0
    for b, t in enumerate(texts, 1):
        n += len(t or "") + 1
        if n >= limit or b == len(texts):
            yield a, b
            a, n = b, 0


def train(rows: DataFrame, bits: int = BITS, max_rows: int = TRAIN_ROWS, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix) of rows (doc_id, text, lang).

    Rows without text or lang are left out. At most about ``max_rows`` rows, chosen by a hash
    of doc_id, are used; the prior is uniform. No rows give no languages.
    """
    rows = rows.where("text is not null and lang is not null")
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))

    def count(batch: pa.RecordBatch) -> dict:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names, which = np.unique(np.array(langs, dtype=str), return_inverse=True)
        sums = np.zeros((len(names), 1 << bits), np.int64)
        for a, b in _parts(texts):
            at, own, _ = grams(texts[a:b], bits)
            np.add.at(sums, (which[a:b][own], at), 1)
        i, j = np.nonzero(sums)
        return {"lang": names[i], "bucket": j.astype(np.int32), "n": sums[i, j]}

    counts = map_arrow(rows.select("text", "lang"), count, "lang string, bucket int, n long")
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    langs = sorted(got["lang"].unique())
    matrix = np.full((1 << bits, len(langs)), alpha)
    if len(got):
        matrix[got["bucket"].to_numpy(), np.searchsorted(np.array(langs), got["lang"].to_numpy(str))] += got["n"].to_numpy()
    return langs, np.log(matrix / matrix.sum(0)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of lang_pred) of every row.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Ties go to
    the first language by code point. Texts of any length are read whole. Repeated rows give repeated results, an empty
    table none; other columns are ignored, those named like a result too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        langs, matrix = sent.value
        texts = batch.column(1).to_pylist()
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        for a, b in _parts(texts, max(1 << 16, CHARS // max(1, len(langs) // 4))) if langs else ():
            at, own, has = grams(texts[a:b], matrix.shape[0].bit_length() - 1)
            total = np.stack([np.bincount(own, matrix[:, k][at], b - a) for k in range(len(langs))], axis=1)
            best = total.argmax(1)
            post = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for i in np.flatnonzero(has):
                pred[a + i], score[a + i] = langs[best[i]], float(post[i])
        return {"doc_id": batch.column(0), "lang_pred": pred, "score": score}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(in_training_fold(F.col("doc_id"))).select("doc_id", "text", "lang"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
