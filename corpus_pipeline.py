"""The corpus pipeline: STAGES over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mailsieve.llm import decontam, mixing, neardup, rules, shards
from mailsieve.llm.storage import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep."""
    return rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies."""
    return neardup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in curriculum order, once for each pass that the mix takes them in."""
    return mixing.sequence(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot; equal texts in one shard, shards of near equal bytes."""
    return shards.shards(docs)


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing", mixture), ("sharding", sharding)]
#: Near-duplicate and leak decisions can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What lies between them is written to the shared folder in spark.checkpoint.dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
