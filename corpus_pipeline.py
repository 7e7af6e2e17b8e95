"""Corpus pipeline over documents: quality, exact copies, near copies, secrets, packing.

Every stage takes what its predecessor kept, with the columns of documents; the last returns the
packed pieces. Stages are written as Parquet and read again, so a lost executor costs its tasks only.
Each stage bounds the session's Arrow batches by bytes, so that what a task holds does not follow the length of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rastertables.llm import exact_dedup, packing, prob_minhash, quality_gam, secret_scan
from rastertables.llm.common import bound_batches, drop_rows, table
from rastertables.llm.tokens import EncoderMemory
from rastertables.storage import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored like others, long ones whole; rows that repeat an id or text are judged each; columns that clash with
    the score's own keep their values; an empty table stays empty.
    """
    bound_batches(spark)
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.score(docs, model).filter("predicted = 1").select(docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id.

    A null text equals an empty one; of rows that are equal in id and text all stay; a null id is below every other; other columns
    stay as they are; an empty table stays empty.
    """
    bound_batches(spark)
    groups = materialize(exact_dedup.exact_groups(docs), "exact-groups")
    return drop_rows(docs, groups.filter("not kept").select("doc_id", "text_key"))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the row with the smallest doc_id.

    Texts without words (null ones too) and rows with a null id stay; of rows that are equal in id and text all stay; long texts are
    compared whole; other columns stay as they are; an empty table stays empty.
    """
    bound_batches(spark)
    classes = materialize(prob_minhash.near_classes(docs), "near-classes")
    return drop_rows(docs, classes.filter("not kept").select("doc_id", "text_key"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced and n_chars counted anew where there was one.

    Null texts stay null; rows that repeat an id are all searched; other columns, clashing names among them, keep their values.
    """
    bound_batches(spark)
    found = secret_scan.redact(docs)
    return found.withColumn("n_chars", F.when(F.col("redacted"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left; workers that have done four other stages remember fewer words."""
    bound_batches(spark)
    return packing.pack(docs, block_tokens=1 << 18, memory=EncoderMemory(pieces=40_000, looked_up_bytes=1 << 20, slice_bytes=1 << 19))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("secret scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Tokenising and the fitted model are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all documents that stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
