"""A corpus pipeline of five stages over ``documents``: quality, near-duplicates, decontamination, PII, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm import decontam, minhash, packing, pii, quality
from drawlake.llm.common import materialize

#: SQL can't express learned models, signatures or a tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group with five-word shingle similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, words=5, percent=80, rows=3, bands=24)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, copied or with other numbers and names."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    path = public_tokenizers.path
    return packing.pack(docs, (path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("pii", pii_stage), ("pack", pack_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is written to the shared folder and read again.

    Rows are judged each by their own text, whatever their ids. Null and empty texts have the quality prior, are no
    copies, hold nothing, and are packed as a separator alone. Null ids are kept by every stage; repeated rows of one id
    stay or go together; very long texts are treated whole. Columns beyond those of ``documents`` pass to the last
    stage; no rows give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
