"""The training-data pipeline over `documents`: what each stage keeps is what the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scorewright.llm.cluster import Scratch
from scorewright.llm.language import keep_languages
from scorewright.llm.neardup import keep_one
from scorewright.llm.packing import pack_documents
from scorewright.llm.passages import cut_passages
from scorewright.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, learnt from `labels`, scores 0.5 or more go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language at 40 % of their mixture, go."""
    return keep_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked at 75 % of shared shingles stays, that with the smallest doc_id."""
    return keep_one(docs, 75)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut; a document with no word left goes."""
    return cut_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left in sequences of at most 2048 tokens."""
    return pack_documents(docs, *(public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken")))


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of what the stages before packing keep of `documents`; each stage's rows are written and read again.

    Null and empty texts go with language_id, rows without doc_id stay up to packing, other columns of `documents`, whatever their names, are kept
    up to there, and an empty table gives no rows.
    """
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.table(docs)
    return scratch.finish(docs)
