"""Stream operators run over the events table as a stream that ends, and feeds over small files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..session import shared_folder, table
from ..sources import feeds, kafka, mime, sinks
from ..streaming import stateful


def drained(spark: SparkSession, sf_dir: str, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stream over the events gives, written to the shared folder and read again."""
    folder = shared_folder(spark, name)
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    out = make(source)
    # a stream with processing-time time-outs would otherwise run empty batches for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    q = out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/out").start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("X12_claim_stream", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, 1 AS one FROM events) GROUP BY user_id, event_type")
def x12(spark: SparkSession, d: str) -> DataFrame:
    """Claims last a year here, so that each key is claimed once; within shorter times the batch form W10 is exact."""
    claim = lambda s: stateful.claimed(s.withColumn("at", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "at", 365).select("user_id", "event_type")
    return drained(spark, d, "claims", claim).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("X13_quota_stream", "SELECT user_id % 5 AS org, count(*) AS n, least(count(*), 50) AS accepted FROM events GROUP BY user_id % 5, date_trunc('month', ts)")
def x13(spark: SparkSession, d: str) -> DataFrame:
    out = drained(spark, d, "quota", lambda s: stateful.quota(s.withColumn("org", F.col("user_id") % 5), "org", "ts", "event_id", 50))
    return out.groupBy("org", "month").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted")).drop("month")


FOLD = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f(user_id, event_id, n, opened, allowed) AS (SELECT user_id, event_id, n, t, TRUE FROM e WHERE n = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - f.opened >= 3600 THEN e.t ELSE f.opened END, e.t - f.opened >= 3600 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, allowed FROM f"""


@query("X15_rate_limit_stream", FOLD)
def x15(spark: SparkSession, d: str) -> DataFrame:
    return drained(spark, d, "alerts", lambda s: stateful.rate_limited(s, ["user_id"], "ts", "event_id")).select("event_id", "allowed")


COMPONENT = "CASE event_type WHEN 'signup' THEN 'plan' WHEN 'click' THEN 'url' WHEN 'view' THEN 'header' WHEN 'purchase' THEN 'nlp' ELSE 'attachment' END"


def _messages(s: DataFrame, *more: str) -> DataFrame:
    kind = F.expr(COMPONENT)
    return s.select((F.col("user_id") % 5).alias("org_id"), F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("email_id"), kind.alias("component"), F.floor("value").alias("score"), F.when(kind == "plan", F.lit('["url", "header"]')).alias("payload"), F.lit(False).alias("degraded"), *more)


@query("X03_aggregator_stream", "SELECT org_id, email_id, 'complete' AS status FROM (SELECT user_id % 5 AS org_id, user_id || '-' || strftime(ts, '%Y%m%d') AS email_id, list(event_type) AS k FROM events GROUP BY 1, 2) WHERE list_contains(k, 'signup') AND list_contains(k, 'click') AND list_contains(k, 'view')")
def x03(spark: SparkSession, d: str) -> DataFrame:
    return drained(spark, d, "aggregate", lambda s: stateful.aggregated(_messages(s))).where("status = 'complete'").select("org_id", "email_id", "status")


def packaged_batch(messages: DataFrame, *order: str) -> DataFrame:
    """The package of each email with a plan from a batch of messages: the first score of each component in the order given, and what is missing."""
    first = lambda c: F.min_by("score", F.when((F.col("component") == c) & F.col("score").isNotNull(), F.struct(*order))).alias(f"{c}_score")
    m = messages.groupBy("org_id", "email_id").agg(F.collect_set("component").alias("got"), *map(first, ("url", "header", "nlp", "attachment")))
    return m.where(F.array_contains("got", "plan")).withColumn("missing", F.array_sort(F.array_except(F.array(F.lit("url"), F.lit("header")), "got"))).withColumn("partial", F.size("missing") > 0).drop("got")


FIRST = "arg_min(floor(value), (ts, event_id)) FILTER (WHERE component = '{0}')"


@query("X10_packaged_batch", f"""SELECT org_id, email_id, {', '.join(f"CAST({FIRST.format(c)} AS BIGINT) AS {c}_score" for c in ('url', 'header', 'nlp', 'attachment'))},
    list_filter(['header', 'url'], lambda x: NOT list_contains(list(component), x)) AS missing, len(list_filter(['header', 'url'], lambda x: NOT list_contains(list(component), x))) > 0 AS partial
    FROM (SELECT *, user_id % 5 AS org_id, user_id || '-' || strftime(ts, '%Y%m%d') AS email_id, {COMPONENT} AS component FROM events) t GROUP BY org_id, email_id HAVING list_contains(list(component), 'plan')""")
def x10(spark: SparkSession, d: str) -> DataFrame:
    return packaged_batch(_messages(table(spark, d, "events"), "ts", "event_id"), "ts", "event_id")


CLOSED = f"""WITH m AS (SELECT user_id % 5 AS org_id, user_id || '-' || strftime(ts, '%Y%m%d') AS email_id, ts, {COMPONENT} AS component FROM events),
    o AS (SELECT org_id, email_id, min(ts) + INTERVAL 6 HOUR AS finish FROM m GROUP BY ALL),
    f AS (SELECT m.org_id, m.email_id, o.finish, {', '.join(f"min(ts) FILTER (WHERE component = '{c}' AND ts <= finish) AS {c}" for c in ('plan', 'url', 'header'))} FROM m JOIN o ON m.org_id = o.org_id AND m.email_id = o.email_id GROUP BY ALL),
    c AS (SELECT org_id, email_id, CASE WHEN plan IS NULL THEN [] ELSE list_filter([CASE WHEN header IS NULL THEN 'header' END, CASE WHEN url IS NULL THEN 'url' END], lambda x: x IS NOT NULL) END AS missing,
        CASE WHEN plan IS NULL THEN 'dropped' WHEN url IS NULL OR header IS NULL THEN 'partial' ELSE 'complete' END AS status, CASE WHEN plan IS NULL OR url IS NULL OR header IS NULL THEN finish ELSE greatest(plan, url, header) END AS closed FROM f)"""


def _closed(spark: SparkSession, d: str) -> DataFrame:
    return stateful.closed_buckets(_messages(table(spark, d, "events"), "ts"), "ts", 6 * 3600)


query("X05_timed_out", f"{CLOSED} SELECT c.org_id, c.email_id, c.status, c.missing, count(*) FILTER (WHERE m.ts > c.closed) AS late FROM c JOIN m ON m.org_id = c.org_id AND m.email_id = c.email_id GROUP BY ALL")(_closed)


@query("X06_one_emission", f"{CLOSED} SELECT org_id, email_id, status, 1 AS copies FROM c WHERE status <> 'dropped'")
def x06(spark: SparkSession, d: str) -> DataFrame:
    """Emails that were complete or late, sent out twice as after a restart; the idempotent sink keeps one of each."""
    folder = f"{shared_folder(spark, 'emitted')}/scored"
    out = _closed(spark, d).where("status <> 'dropped'").select("org_id", "email_id", "status")
    for delivery in range(2):
        sinks.append_unseen(folder, ["org_id", "email_id"])(out, delivery)
    return spark.read.parquet(folder).groupBy("org_id", "email_id", "status").agg(F.count("*").cast("int").alias("copies"))


def _file(spark: SparkSession, name: str, text: str) -> str:
    folder = shared_folder(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder)
    return folder


OPENPHISH = "# feed\nhttp://Bad.example.COM/\nhttps://evil.test/login\n\n"
PHISHTANK = json.dumps([{"phish_id": 1, "url": "http://a.test/x", "verified": "yes"}, {"phish_id": "2", "url": "http://b.test/", "verified": False}, {"phish_id": 3, "url": "http://c.test", "verified": 1}])
URLHAUS = "# comment\n1,2024-01-01,http://m.test/a.exe,online,2024,malware_download,\"exe,loader\",x,y\n2,2024-01-01,http://n.test/b,offline,2024,malware_download,,x,y\n"
THREATFOX = json.dumps({"query_status": "ok", "data": [{"id": "9", "ioc_type": "ip:port", "ioc": "8.8.8.8:80", "threat_type": "botnet_cc", "tags": ["a", "b"], "confidence_level": 75}, {"id": "10", "ioc_type": "domain", "ioc": "Evil.TEST.", "threat_type": "payload", "tags": "x, y", "confidence_level": None}]})
BAZAAR = json.dumps({"query_status": "ok", "data": [{"sha256_hash": "AB" * 32, "file_type": "exe", "signature": "s", "tags": ["t"]}, {"sha256_hash": "nope"}]})
CASES = {
    "S09_openphish": (feeds.openphish, OPENPHISH, [("http://bad.example.com", 85), ("https://evil.test/login", 85)]), "S10_phishtank": (feeds.phishtank, PHISHTANK, [("http://a.test/x", 90), ("http://c.test", 90)]),
    "S11_urlhaus": (feeds.urlhaus, URLHAUS, [("http://m.test/a.exe", 90), ("http://n.test/b", 60)]), "S12_threatfox": (feeds.threatfox, THREATFOX, [("8.8.8.8", 75), ("evil.test", 50)]), "S13_malwarebazaar": (feeds.malwarebazaar, BAZAAR, [("ab" * 32, 90)]),
}
for _name, (_feed, _text, _rows) in CASES.items():
    _values = ", ".join(f"('{v}', {r})" for v, r in _rows)
    query(_name, f"SELECT * FROM (VALUES {_values}) t(indicator_value, risk_score)")(lambda spark, d, n=_name, f=_feed, t=_text: f(spark, _file(spark, n, t)).select("indicator_value", "risk_score"))


@query("S14_feed_sync", "SELECT * FROM (VALUES ('openphish', 2), ('phishtank', 2)) t(feed, n)")
def s14(spark: SparkSession, d: str) -> DataFrame:
    every, errors = feeds.sync(spark, {"openphish": _file(spark, "a", OPENPHISH), "phishtank": _file(spark, "b", PHISHTANK), "urlhaus": "/nowhere/at/all"})
    if list(errors) != ["urlhaus"]:
        raise AssertionError(errors)
    return every.groupBy("feed").agg(F.count("*").alias("n"))


MAIL = b"From: Bob <bob@Example.com>\r\nTo: a@b.c, d@e.f\r\nSubject: Re: Invoice 1234\r\nMessage-ID: <m1@x>\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\nReceived: from a.test by b.test\r\nAuthentication-Results: mx; spf=fail\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=XX\r\n\r\n--XX\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nhello\r\n--XX\r\nContent-Type: application/pdf; name=a.pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nJVBERi0=\r\n--XX--\r\n"


@query("S08_mime_parse", "SELECT '1' AS id, 'm1@x' AS message_id, 2 AS n_recipients, CAST(1704103200 AS BIGINT) AS sent_timestamp, 'hello' AS body, 'a.pdf' AS filename, CAST(5 AS BIGINT) AS size_bytes")
def s08(spark: SparkSession, d: str) -> DataFrame:
    m = mime.parse(spark.createDataFrame([("1", bytearray(MAIL))], "id string, raw binary"))
    return m.select("id", "message_id", F.size("recipients").alias("n_recipients"), "sent_timestamp", F.trim(F.regexp_replace("plain", r"\s+", " ")).alias("body"), F.col("attachments")[0]["filename"].alias("filename"), F.col("attachments")[0]["size_bytes"].alias("size_bytes"))


@query("S03_envelope_decode", "SELECT CAST(event_id AS VARCHAR) AS key, event_type AS component, value AS score, event_id % 10 = 0 AS poisoned FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events)")
def s03(spark: SparkSession, d: str) -> DataFrame:
    good = F.to_json(F.struct(F.struct(F.col("event_id").cast("string").alias("email_id")).alias("meta"), F.col("event_type").alias("component"), F.col("value").alias("score")))
    raw = table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(good).alias("value"))
    return kafka.decoded(raw, "scores.url").select("key", "component", "score", F.col("poison").isNotNull().alias("poisoned"))
