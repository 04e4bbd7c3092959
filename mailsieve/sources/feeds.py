"""Threat-intelligence feeds as indicator DataFrames with one schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attachments import is_hex_hash
from ..functions.urls import host, normalize_domain, normalize_url

#: indicator_type, indicator_value, threat_type, risk_score, confidence, tags, source_id
COLUMNS = ["indicator_type", "indicator_value", "threat_type", "risk_score", "confidence", "tags", "source_id"]
URLHAUS = ["id", "dateadded", "url", "url_status", "last_online", "threat", "tags", "urlhaus_link", "reporter"]


class FeedError(RuntimeError):
    """A feed that can't be read; other feeds go on."""


def _indicators(df: DataFrame, kind, value: Column, threat, risk, confidence, tags: Column | None, source: Column) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    empty = F.array().cast("array<string>")
    out = df.select(lit(kind).alias("indicator_type"), value.alias("indicator_value"), lit(threat).alias("threat_type"), lit(risk).cast("int").alias("risk_score"), lit(confidence).cast("double").alias("confidence"), F.coalesce(tags, empty).alias("tags") if tags is not None else empty.alias("tags"), source.cast("string").alias("source_id"))
    return out.where("indicator_value IS NOT NULL AND indicator_value <> ''")


def split_tags(c: Column) -> Column:
    """Tags of a JSON array's text or of comma-separated text."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r'[\[\]"]', ""), ","), lambda x: F.trim(x)), lambda x: x != "")


def truthy(c: Column) -> Column:
    """JSON booleans, numbers and texts that mean yes."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y")


def openphish(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; # begins a comment."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#"))
    return _indicators(lines, "url", normalize_url(F.col("value")), "phishing", 85, 0.9, None, F.sha1("value"))


def phishtank(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array; verified entries only."""
    rows = spark.read.schema("phish_id string, url string, verified string").option("multiLine", True).json(path)
    return _indicators(rows.where(truthy(F.col("verified"))), "url", normalize_url(F.col("url")), "phishing", 90, 0.95, None, F.col("phish_id"))


def urlhaus(spark: SparkSession, path: str) -> DataFrame:
    """CSV with # comments; columns by the header if there is one, else by place."""
    raw = spark.read.option("comment", "#").csv(path)
    first = raw.limit(1).collect()
    names = [str(x).strip().lower() for x in first[0]] if first else []
    if "url" in names:
        rows = raw.toDF(*[f"{n}" for n in names]).where(F.lower(F.trim("url")) != "url")
    elif len(raw.columns) >= 7:
        rows = raw.toDF(*URLHAUS[: len(raw.columns)], *[f"c{i}" for i in range(len(raw.columns) - len(URLHAUS))])
    else:
        raise FeedError(f"no header and {len(raw.columns)} columns: {path}")
    online = F.lower(F.col("url_status")) == "online" if "url_status" in rows.columns else F.lit(True)
    threat = F.coalesce(F.col("threat"), F.lit("malware")) if "threat" in rows.columns else F.lit("malware")
    tags = split_tags(F.col("tags")) if "tags" in rows.columns else None
    return _indicators(rows, "url", normalize_url(F.col("url")), threat, F.when(online, 90).otherwise(60), 0.9, tags, F.col("id") if "id" in rows.columns else F.sha1("url"))


def threatfox(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {query_status, data}; a status other than ok or no_result is an error."""
    item = "struct<id:string,ioc_type:string,ioc:string,threat_type:string,tags:string,confidence_level:double>"
    root = spark.read.schema(f"query_status string, data array<{item}>").option("multiLine", True).json(path)
    bad = [r.query_status for r in root.select("query_status").limit(1).collect() if r.query_status not in ("ok", "no_result")]
    if bad:
        raise FeedError(f"query_status {bad[0]}: {path}")
    x = root.select(F.explode("data").alias("x")).select("x.*")
    kind = F.when(F.col("ioc_type").isin("ip:port", "ip"), "ip").when(F.col("ioc_type").isin("url", "domain"), F.col("ioc_type")).when(F.col("ioc_type").rlike("hash"), "hash")
    value = F.when(kind == "ip", F.substring_index("ioc", ":", 1)).when(kind == "url", normalize_url(F.col("ioc"))).when(kind == "domain", normalize_domain(F.col("ioc"))).otherwise(F.lower("ioc"))
    level = F.coalesce(F.col("confidence_level"), F.lit(50.0)) / 100
    return _indicators(x.where(kind.isNotNull()), kind, value, F.col("threat_type"), F.round(level * 100), level, split_tags(F.col("tags")), F.col("id"))


def malwarebazaar(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {query_status, data} of hashes, at fixed risk 90 and confidence 0.95."""
    item = "struct<sha256_hash:string,md5_hash:string,sha1_hash:string,file_type:string,signature:string,tags:string,reporter:string>"
    root = spark.read.schema(f"query_status string, data array<{item}>").option("multiLine", True).json(path)
    x = root.select(F.explode("data").alias("x")).select("x.*")
    sha = F.lower(F.trim("sha256_hash"))
    return _indicators(x.where(is_hex_hash(sha)), "hash", sha, "malware", 90, 0.95, split_tags(F.col("tags")), sha)


FEEDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"openphish": openphish, "phishtank": phishtank, "urlhaus": urlhaus, "threatfox": threatfox, "malwarebazaar": malwarebazaar}


def sync(spark: SparkSession, feeds: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """All feeds' indicators with a feed column, and the errors of those that failed; it is an error if all fail."""
    out, errors = None, {}
    for name, path in feeds.items():
        try:
            df = FEEDS[name](spark, path).withColumn("feed", F.lit(name))
            df.limit(1).collect()
            out = df if out is None else out.unionByName(df)
        except Exception as e:  # noqa: BLE001  one feed's failure is reported, not raised
            errors[name] = str(e).splitlines()[0][:300]
    if out is None:
        raise FeedError(f"all feeds failed: {errors}")
    return out, errors


def domains(indicators: DataFrame) -> DataFrame:
    """The host of each URL and each domain, with its highest risk: the lookup table of the URL check."""
    d = F.when(F.col("indicator_type") == "url", host(F.col("indicator_value"))).when(F.col("indicator_type") == "domain", F.col("indicator_value"))
    return indicators.select(d.alias("domain"), "risk_score", "threat_type").where("domain IS NOT NULL").groupBy("domain").agg(F.max("risk_score").alias("risk_score"), F.max_by("threat_type", "risk_score").alias("threat_type"))
