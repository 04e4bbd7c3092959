"""The operators as queries over whole tables: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chains, decontam, licenses, lines, mixing, neardup, puquality, rules, shards, sql, toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir)).drop("matches")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.near_lines(documents(spark, sf_dir))


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op4_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return shards.shards(documents(spark, sf_dir).select("doc_id", "text")).select(*cols)


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.repeated_passages(documents(spark, sf_dir))


def op7_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir)).drop("clean_text")


def op8_curriculum_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op9_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return puquality.quality(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
