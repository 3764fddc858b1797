"""From raw documents to packed training sequences: five stages, each written and read again by the next.

Toxic documents go, of near-duplicates one stays, documents that hold benchmark passages go, secrets in
the texts are blacked out, and what is left is encoded and packed into sequences.

In all stages, rows stand for themselves: ids may repeat or be null, and no other column than doc_id and text
decides anything. Columns of any name and their nulls are carried as they are by all stages but the last. Texts are read whole,
however long. A stage of an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexaloom.llm.decontaminate import mark_benchmark
from hexaloom.llm.neardup import drop_near_duplicates
from hexaloom.llm.packing import pack_documents
from hexaloom.llm.queries import table
from hexaloom.llm.secrets import redact_secrets
from hexaloom.llm.state import col, drop, materialise, scratch
from hexaloom.llm.toxicity import fit_toxicity, score_toxicity


def _whole(docs: DataFrame) -> DataFrame:
    """The row as one column beside its text, so that no operator's column takes the place of one of its own."""
    return docs.select(F.struct(*map(col, docs.columns)).alias("__row"), col("text"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold. The model is fitted on the labelled ones outside the held-out fold. Null and empty texts
    have the score of a text without known words and stay; equal rows have equal scores."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = fit_toxicity(docs, labels)
    return score_toxicity(_whole(docs), model).where("NOT toxic").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of least doc_id (null ids last). Null texts are duplicates of nothing and all stay; of
    empty ones, and of rows equal in id and text, one stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts have none and stay, and so do repeated rows."""
    return mark_benchmark(_whole(docs), table(spark, sf_dir, "benchmark")).where("NOT contaminated").select("__row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars, where it is there, counts the new text (null: null). Null, empty and clean texts
    stay as they are; repeated rows are all kept."""
    clean = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 ids. A null or empty text is its end id; repeated rows are packed
    each for itself."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=0, capacity=2048)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Near-duplicates, learnt scores and token ids are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, past = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as tables:
            docs = materialise(stage(spark, docs, sf_dir), name)
            tables.keep(docs)
        if past is not None:
            drop(past)
        past = docs
    return STAGES[-1][1](spark, docs, sf_dir)
