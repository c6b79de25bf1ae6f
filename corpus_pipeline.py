"""Corpus pipeline: toxicity, near-duplicates, decontamination, secrets, source mix.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's ``docs``. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontam, jaccard, mixing, secret_scan, toxicity
from linkloom.llm.common import table
from linkloom.operators.components import remove, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7. The lexicon is learned from ``labels``.

    Rows that share a doc_id go together if one of them is toxic; a null doc_id stays. Null and empty
    texts are clean unless an empty text scores 0.7; texts of any length are read whole; repeated rows stay
    repeated. An empty table gives no rows; columns other than those of documents are left out.
    """
    rejected = toxicity.score(docs, toxicity.fit(spark, sf_dir)).where("score >= 0.7").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each near-duplicate class.

    Rows with a null doc_id stay, as do null texts and texts without words; rows that repeat a doc_id with
    the same text are one document, of which any row stays. Texts of any length are compared whole; of equal
    texts the least doc_id stays. An empty table gives no rows; columns other than those of documents are left out.
    """
    kept = jaccard.near_duplicates(docs).where("kept").select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``.

    Null and empty texts hold none. Rows that share a doc_id go together if one of them holds a passage; a
    null doc_id stays. Texts and passages of any length are compared whole; repeated rows stay repeated. An
    empty table on either side drops nothing; columns other than those of documents are left out.
    """
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the new text.

    A null text stays null; an empty one stays empty. Texts of any length are read whole; of overlapping
    secrets one mark stays. Repeated rows stay repeated, an empty table gives no rows, and columns other
    than those of documents are left out.
    """
    return secret_scan.redact(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, target (of the source), copies and taken words of the mix.

    Every row of the input has one, whatever its nulls; null and empty texts have size 0 and take nothing.
    Which of equal rows at the border of a source is taken once more is arbitrary. An empty table gives no rows.
    """
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

#: The stages learn models and compare sets of hashes: no SQL; the operators have brute-force tests, the whole has tests of what must hold.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``; each stage is written to the shared folder, and removed when the next one is."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            remove(spark, before)
        before = f"{at}/{name}"
    return docs
