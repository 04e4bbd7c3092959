"""Topics as streams: envelopes from JSON, and back. The connector package must be on the cluster's class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "struct<email_id:string,org_id:bigint,fetched_at:timestamp,timestamp:timestamp,trace_id:string,span_id:string,schema_version:string>"
#: Topic -> schema of its value.
TOPICS = {
    "emails.raw": f"meta {META}, fetched_at timestamp, source_adapter string, message_id string, raw_rfc822 string, headers map<string,string>",
    "analysis.plans": f"meta {META}, expected_scores array<string>, url_count int, attachment_count int, has_body boolean, created_at bigint",
    "scores.url": f"meta {META}, component string, score double, details map<string,string>",
    "scores.header": f"meta {META}, component string, score double, details map<string,string>",
    "scores.nlp": f"meta {META}, component string, score double, details map<string,string>",
    "scores.attachment": f"meta {META}, component string, score double, details map<string,string>",
    "emails.scored": f"meta {META}, url_score int, header_score int, nlp_score int, attachment_score int, missing_components array<string>, degraded_components array<string>, partial_analysis boolean, timeout_triggered boolean",
    "emails.verdict": f"meta {META}, risk_score int, verdict_label string, confidence double, source string, fired_rules array<struct<rule_id:bigint,name:string,version:string,score_impact:int>>",
}


def topic(spark: SparkSession, servers: str, name: str, per_trigger: int = 100000) -> DataFrame:
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    return decoded(raw, name)


def decoded(raw: DataFrame, name: str) -> DataFrame:
    """key and value columns to fields; `poison` holds the text of values that can't be read."""
    v = F.from_json(F.col("value").cast("string"), TOPICS[name], {"mode": "PERMISSIVE"})
    out = raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("_text"), v.alias("_v"))
    bad = F.col("_v").isNull() | F.col("_v.meta").isNull()
    return out.select("key", "_v.*", F.when(bad, F.col("_text")).alias("poison"))


def encoded(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("value"))


def publish(df: DataFrame, key: str, servers: str, name: str, checkpoint: str):
    return encoded(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).option("checkpointLocation", checkpoint).start()
