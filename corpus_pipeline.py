"""The corpus pipeline: quality, near-duplicates, personal data, mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineward.llm import byte_bpe, minhash, mixing, privacy, quality
from lineward.llm.common import written
from lineward.llm.queries import BYTE_RANKS, table

#: Words of a shingle in the near-duplicates stage; op10_minhash alone has four.
SHINGLE = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their columns."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return minhash.deduplicated(docs, SHINGLE)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts sanitised."""
    return privacy.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as it takes them."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and the digest of what they decode to."""
    return byte_bpe.round_trip(docs, BYTE_RANKS)


STAGES = [("quality", keep_good), ("near-duplicates", keep_distinct), ("personal data", without_personal_data),
          ("mix", mixed), ("token ids", encoded)]

#: A trained classifier and byte-pair merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
