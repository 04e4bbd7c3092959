"""Relational queries by their operator ids: projections, filters, joins, aggregates, latest rows, sorts, merges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as r
from ..registry import ORACLES, QUERIES, query
from ..session import table as frame_table
from ..session import shared_folder, views
from ..sources.sinks import refreshed
from .projection import CTES, with_ctes


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame."""
    views(spark, sf_dir)
    return spark.sql(CTES[name])


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a Spark SQL statement over the tables and projections; oracle only where DuckDB needs other words."""
    spark_text = with_ctes(text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return spark.sql(spark_text)

    query(name, with_ctes(oracle or text))(run)


def on(name: str, oracle: str) -> Callable:
    """Registers a DataFrame query with its SQL."""
    return query(name, with_ctes(oracle))


E = "emails"
# scans
sql("S01_typed_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
sql("S02_partition_lookup", "SELECT internal_id, fetched_at, risk_score FROM emails WHERE internal_id = 77 AND fetched_at >= TIMESTAMP '2024-01-01 00:00:00' AND fetched_at < TIMESTAMP '2024-02-01 00:00:00'")
# projections and filters
sql("P01_coalesce_cast", "SELECT id, COALESCE(threat_type, '') AS threat_type, CAST(COALESCE(asn, -1) AS DOUBLE) AS asn, CAST(risk_score AS DOUBLE) AS risk FROM threats")
sql("P02_soft_delete", "SELECT internal_id, org_id FROM emails WHERE org_id = 2 AND NOT is_deleted AND label IS NOT NULL")
sql("P03_tenant_or_global", "SELECT id, org_id, is_global FROM threats WHERE org_id = 1 OR is_global")
sql("P04_null_tolerant_tenant", "SELECT id, asn FROM threats WHERE asn = 2 OR asn IS NULL")
sql("P05_membership", "SELECT internal_id, event_type FROM emails WHERE event_type IN ('click', 'signup')")
sql("P06_staleness", "SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE created_at END AS seen FROM verdicts WHERE id % 4 = 0 OR created_at < TIMESTAMP '2024-01-10 00:00:00'")
sql("P07_ttl_fresh", "SELECT id, created_at FROM verdicts WHERE (id % 6 = 0 OR created_at + INTERVAL '7' DAY > TIMESTAMP '2024-01-30 00:00:00')")
sql("P08_month_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-03-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-04-01 00:00:00' AND l_quantity BETWEEN 10 AND 20")
sql("P09_null_aware_greatest", "SELECT id, GREATEST(asn, risk_score, CASE WHEN online THEN 50 END) AS top FROM threats")


@on("P10_regex_filter", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)^https://[^/]+/.*\\?')")
def p10(spark, d):
    return frame_table(spark, d, "pages").where(F.col("url").rlike(r"(?i)^https://[^/]+/.*\?")).select("page_id", "url")


@on("P11_range_checks", """SELECT o_orderkey, list_sort(list_filter([CASE WHEN o_totalprice > 200000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-') THEN 'priority' END], lambda x: x IS NOT NULL)) AS violations
    FROM orders WHERE o_totalprice > 200000 OR o_orderstatus NOT IN ('O', 'F') OR NOT regexp_matches(o_orderpriority, '^[1-3]-')""")  # fmt: skip
def p11(spark, d):
    checks = {"price": F.col("o_totalprice") <= 200000, "status": F.col("o_orderstatus").isin("O", "F"), "priority": F.col("o_orderpriority").rlike("^[1-3]-")}
    return r.validated(frame_table(spark, d, "orders"), checks).where(F.size("violations") > 0).select("o_orderkey", F.array_sort("violations").alias("violations"))


@on("P12_tenant_view", "SELECT id, org_id, is_global, risk_score FROM threats WHERE org_id = 2 OR is_global")
def p12(spark, d):
    return r.tenant_view(frame(spark, d, "threats"), 2, shared="is_global").select("id", "org_id", "is_global", "risk_score")


sql("P13_wire_validation", "SELECT l_orderkey, l_linenumber, (url_score IS NULL OR url_score BETWEEN 0 AND 100) AND (header_score IS NULL OR header_score BETWEEN 0 AND 90) AND l_orderkey > 0 AS is_valid FROM scored")
sql("P14_url_shape", "SELECT page_id FROM pages WHERE length(url) >= 10 AND url LIKE '%.%'")
sql("P15_text_length", "SELECT doc_id FROM documents WHERE length(text) >= 20")
sql("P16_alert_gate", "SELECT internal_id, org_id, risk_score, label FROM emails WHERE risk_score >= 70 + org_id OR label IN ('phishing', 'malware')")
sql("P17_slice_rates", "SELECT lang, count(*) AS n, COUNT(*) FILTER (WHERE positive AND lang = 'en') AS in_house, round(avg(CASE WHEN positive AND score >= 50 THEN 1e0 ELSE 0e0 END), 6) AS hit_rate FROM judged GROUP BY lang")

# joins
sql("J01_three_key_left_join", """SELECT a.internal_id, a.org_id, b.id AS verdict_id, b.score FROM emails a
    LEFT JOIN verdicts b ON b.id = a.internal_id AND b.created_at = a.fetched_at AND b.entity_id % 5 = a.org_id AND b.entity_type = 'click'""")
sql("J02_dimension_left_join", "SELECT h.id, h.rule_id, x.name, x.status FROM rule_hits h LEFT JOIN rules x ON x.id = h.rule_id AND x.status = 'active'")
sql("J03_left_join_group", "SELECT c.id, c.name, count(e.internal_id) AS emails, max(e.risk_score) AS top FROM campaigns c LEFT JOIN emails e ON e.campaign_id = c.id AND NOT e.is_deleted GROUP BY c.id, c.name")
sql("J04_right_filter_in_on", "SELECT f.id, f.name, count(t.id) AS threats FROM feeds f LEFT JOIN threats t ON t.feed_id = f.id AND NOT t.is_deleted GROUP BY f.id, f.name")


@on("J05_lateral_latest", """SELECT c.id, v.id AS verdict_id, v.score FROM campaigns c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) AS n FROM verdicts) WHERE n = 1) v ON v.entity_id = c.id""")
def j05(spark, d):
    last = r.latest(frame(spark, d, "verdicts"), ["entity_id"], [F.desc("created_at"), F.desc("id")])
    return frame(spark, d, "campaigns").select("id").join(last.select("entity_id", F.col("id").alias("verdict_id"), "score"), F.col("id") == F.col("entity_id"), "left").drop("entity_id")


@on("J06_orphans", "SELECT h.id, h.rule_id FROM rule_hits h WHERE NOT EXISTS (SELECT 1 FROM rules x WHERE x.id = h.rule_id)")
def j06(spark, d):
    return r.orphans(frame(spark, d, "rule_hits").select("id", "rule_id"), frame(spark, d, "rules").select(F.col("id").alias("rule_id")), ["rule_id"]).select("id", "rule_id")


@on("J07_scope_validation", "SELECT DISTINCT e.event_type FROM emails e WHERE e.event_type NOT IN (SELECT x FROM (VALUES ('click'), ('view'), ('signup')) t(x))")
def j07(spark, d):
    valid = spark.createDataFrame([("click",), ("view",), ("signup",)], "event_type string")
    return frame(spark, d, "emails").select("event_type").distinct().join(valid, "event_type", "left_anti")


@on("J08_duplicate_probe", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1")
def j08(spark, d):
    return r.duplicates(frame_table(spark, d, "events"), ["user_id", "event_type"])


JOBS = "SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'in_progress' ELSE 'done' END AS status, o_orderkey % 4 AS attempts, 3 AS max_attempts FROM orders"


@on("J09_queue_pop", f"SELECT id, priority, status FROM ({JOBS}) WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 1")
def j09(spark, d):
    views(spark, d)
    return r.job_next(spark.sql(JOBS)).select("id", "priority", "status")


@on("J10_bridge_insert", "SELECT DISTINCT e.internal_id, t.id AS threat_id, t.org_id FROM emails e JOIN threats t ON e.campaign_id = t.id AND (t.org_id = e.org_id OR t.is_global)")
def j10(spark, d):
    e, t = frame(spark, d, "emails").select("internal_id", "campaign_id", F.col("org_id").alias("eo")), frame(spark, d, "threats")
    return e.join(t, (F.col("campaign_id") == t["id"]) & ((t["org_id"] == F.col("eo")) | t["is_global"])).select("internal_id", F.col("id").alias("threat_id"), "org_id").dropDuplicates()


IND = """SELECT page_id AS id, 'domain' AS indicator_type, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS indicator_value, (page_id * 7) % 101 AS risk_score,
    CASE WHEN page_id % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_seen, page_id % 4 <> 1 AS is_active, CASE WHEN page_id % 2 = 0 THEN 'phishing' ELSE 'malware' END AS threat_type FROM pages WHERE page_id % 3 <> 2"""


@on("J11_ti_domain_lookup", f"SELECT p.page_id, max(i.risk_score) AS risk FROM pages p JOIN ({IND}) i ON i.is_active AND regexp_extract(p.url, '^[a-z]+://([^/?#:]+)', 1) = i.indicator_value GROUP BY p.page_id")
def j11(spark, d):
    from ..functions.urls import host

    views(spark, d)
    best = spark.sql(IND).where("is_active").groupBy("indicator_value").agg(F.max("risk_score").alias("risk"))
    return frame_table(spark, d, "pages").select("page_id", host(F.col("url")).alias("indicator_value")).join(best, "indicator_value").select("page_id", "risk")


@on("J12_ti_best_row", f"""SELECT p.page_id, b.id IS NOT NULL AS ti_match, b.risk_score AS ti_risk, b.threat_type AS ti_type FROM pages p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indicator_type, indicator_value ORDER BY risk_score DESC, last_seen DESC NULLS LAST, id) AS n FROM ({IND}) WHERE is_active) WHERE n = 1) b
    ON b.indicator_value = regexp_extract(p.url, '^[a-z]+://([^/?#:]+)', 1)""")  # fmt: skip
def j12(spark, d):
    from ..functions.urls import host
    from ..operators.similarity import best_indicator

    views(spark, d)
    look = frame_table(spark, d, "pages").select("page_id", F.lit("domain").alias("kind"), host(F.col("url")).alias("value"))
    return best_indicator(look, spark.sql(IND)).select("page_id", "ti_match", "ti_risk", "ti_type")


sql("J13_cache_then_store", "SELECT e.internal_id, COALESCE(c.name, f.name, 'none') AS name FROM emails e LEFT JOIN campaigns c ON c.id = e.campaign_id LEFT JOIN feeds f ON f.id = e.org_id")
sql("J14_allowlist_match", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IN (SELECT id FROM feeds)")
sql("J21_campaign_history", "SELECT e.internal_id, h.n, h.mean FROM emails e LEFT JOIN (SELECT campaign_id, count(*) AS n, round(avg(risk_score), 6) AS mean FROM emails WHERE NOT is_deleted GROUP BY campaign_id) h ON h.campaign_id = e.campaign_id")
sql("J22_campaign_snapshot", "SELECT e.internal_id, c.id AS campaign, c.org_id AS campaign_org FROM emails e LEFT JOIN campaigns c ON c.id = e.campaign_id AND c.org_id = e.org_id")


@on("J23_detail_assembly", """SELECT c.id, list_sort(list(e.internal_id)) AS emails, list_sort(list_distinct(list(e.event_type))) AS kinds, count(*) AS n FROM campaigns c JOIN emails e ON e.campaign_id = c.id GROUP BY c.id""")
def j23(spark, d):
    e = frame(spark, d, "emails").groupBy("campaign_id").agg(F.array_sort(F.collect_list("internal_id")).alias("emails"), F.array_sort(F.collect_set("event_type")).alias("kinds"), F.count("*").alias("n"))
    return frame(spark, d, "campaigns").select("id").join(e, F.col("id") == F.col("campaign_id")).drop("campaign_id")


@on("J24_prior_enrichment", """SELECT id, prior FROM (SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events) WHERE prior IS NOT NULL""")
def j24(spark, d):
    from pyspark.sql.window import Window

    ev = frame_table(spark, d, "events")
    return ev.select(F.col("event_id").alias("id"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("prior")).where("prior IS NOT NULL")


sql("J25_id_intersection", "SELECT d.doc_id, b.positive FROM documents d JOIN judged b ON d.doc_id = b.doc_id JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = d.doc_id")

CIDRS = "SELECT CAST(n_nationkey AS BIGINT) * 167772160 / 10 AS low, CAST(n_nationkey AS BIGINT) * 167772160 / 10 + 4194303 AS high, n_name AS block FROM nation"
POINTS = "SELECT event_id, (event_id * 2654435761) % 419430400 AS ip FROM events"


@on("J26_cidr_containment", f"SELECT p.event_id, p.ip, c.block FROM ({POINTS}) p JOIN ({CIDRS.replace('/ 10', '// 10')}) c ON p.ip BETWEEN c.low AND c.high")
def j26(spark, d):
    views(spark, d)
    ranges = spark.sql(CIDRS.replace("* 167772160 / 10", "* 16777216"))
    return r.containment_join(spark.sql(POINTS), ranges, "ip", "low", "high").select("event_id", "ip", "block")


sql("J27_stream_to_rows", "SELECT v.id, e.risk_score, v.score FROM verdicts v JOIN emails e ON e.internal_id = v.id WHERE v.entity_type = 'purchase'")

# aggregates
sql("A01_threat_summary", """SELECT COALESCE(threat_type, '') AS threat_type, COALESCE(asn, -1) AS asn, is_global, org_id, count(*) AS total, count(*) FILTER (WHERE online = TRUE) AS online_count, count(*) FILTER (WHERE online = FALSE) AS offline_count,
    round(avg(risk_score), 6) AS avg_risk, max(risk_score) AS max_risk FROM threats WHERE NOT is_deleted GROUP BY COALESCE(threat_type, ''), COALESCE(asn, -1), is_global, org_id""")
sql("A02_campaign_summary", """SELECT c.id, c.org_id, count(DISTINCT e.internal_id) AS email_count, round(avg(e.risk_score), 6) AS avg_risk, count(e.internal_id) FILTER (WHERE e.label = 'phishing') AS phishing,
    count(e.internal_id) FILTER (WHERE e.label = 'malware') AS malware, count(e.internal_id) FILTER (WHERE e.label = 'suspicious') AS suspicious, count(e.internal_id) FILTER (WHERE e.label = 'benign') AS benign,
    count(e.internal_id) FILTER (WHERE e.label = 'spam') AS spam FROM campaigns c LEFT JOIN emails e ON e.campaign_id = c.id AND e.org_id = c.org_id AND NOT e.is_deleted GROUP BY c.id, c.org_id""")
sql("A03_feed_health", "SELECT f.id, f.name, f.enabled, count(t.id) AS threats, count(t.id) FILTER (WHERE t.online = TRUE) AS active, round(avg(t.risk_score), 6) AS avg_risk FROM feeds f LEFT JOIN threats t ON t.feed_id = f.id AND NOT t.is_deleted GROUP BY f.id, f.name, f.enabled")
sql("A04_rule_performance", """SELECT x.id, x.name, x.version, x.status, count(h.id) AS hits, count(h.id) FILTER (WHERE h.fired_at >= TIMESTAMP '1998-08-01 00:00:00' - INTERVAL '30' DAY) AS last_30d,
    count(h.id) FILTER (WHERE h.fired_at >= TIMESTAMP '1998-08-01 00:00:00' - INTERVAL '365' DAY) AS last_year, CAST(sum(h.score_impact) AS BIGINT) AS total_impact, max(h.fired_at) AS last_fired FROM rules x LEFT JOIN rule_hits h ON h.rule_id = x.id GROUP BY x.id, x.name, x.version, x.status""")
sql("A05_ingestion_summary", """SELECT org_id, count(*) AS total, count(*) FILTER (WHERE fetched_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '1' DAY) AS last_1d, count(*) FILTER (WHERE fetched_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '7' DAY) AS last_7d,
    round(avg(risk_score), 6) AS avg_risk, max(risk_score) AS max_risk, count(*) FILTER (WHERE risk_score >= 70) AS high, count(*) FILTER (WHERE risk_score BETWEEN 40 AND 69) AS medium, count(*) FILTER (WHERE risk_score < 40) AS low,
    count(*) FILTER (WHERE label = 'phishing') AS phishing, count(*) FILTER (WHERE label IS NULL) AS unclassified FROM emails WHERE NOT is_deleted GROUP BY org_id""")
SUMMARIES = {"threat_summary": "A01_threat_summary", "campaign_summary": "A02_campaign_summary", "feed_health": "A03_feed_health", "rule_performance": "A04_rule_performance", "ingestion_summary": "A05_ingestion_summary"}


@query("A06_refresh_all", " UNION ALL ".join(f"SELECT '{k}' AS summary, count(*) AS n FROM ({ORACLES[v]}) t" for k, v in SUMMARIES.items()))
def a06(spark: SparkSession, d: str) -> DataFrame:
    """All summary tables written over what a first refresh left, and counted as read again."""
    folder = shared_folder(spark, "summaries")
    for _ in range(2):
        refreshed({k: QUERIES[v](spark, d) for k, v in SUMMARIES.items()}, folder)
    return reduce(DataFrame.union, [spark.read.parquet(f"{folder}/{k}").agg(F.lit(k).alias("summary"), F.count("*").alias("n")) for k in SUMMARIES])




@on("A07_running_mean", """WITH RECURSIVE o AS (SELECT campaign_id, risk_score, row_number() OVER (PARTITION BY campaign_id ORDER BY fetched_at, internal_id) AS n FROM emails),
    m(campaign_id, n, mean) AS (SELECT campaign_id, n, risk_score FROM o WHERE n = 1 UNION ALL SELECT o.campaign_id, o.n, CAST(floor((m.mean * m.n + o.risk_score) / CAST(m.n + 1 AS DOUBLE) + 0.5) AS BIGINT) FROM m JOIN o ON o.campaign_id = m.campaign_id AND o.n = m.n + 1)
    SELECT campaign_id, max(n) AS emails, max_by(mean, n) AS mean FROM m GROUP BY campaign_id""")
def a07(spark, d):
    e = frame(spark, d, "emails").groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("fetched_at", "internal_id", "risk_score"))).alias("x"))
    return e.select("campaign_id", F.size("x").cast("long").alias("emails"), r.running_mean(F.transform("x", lambda v: v["risk_score"])).alias("mean"))


sql("A08_worst_label", "SELECT campaign_id, max(risk_score) AS score, max(CASE label WHEN 'malware' THEN 4 WHEN 'phishing' THEN 3 WHEN 'suspicious' THEN 2 WHEN 'benign' THEN 1 ELSE 0 END) AS worst FROM emails GROUP BY campaign_id")
sql("A09_attachment_pool", "SELECT l_orderkey, max(attachment_score) AS score, count(*) FILTER (WHERE attachment_score >= 76) AS malicious FROM scored GROUP BY l_orderkey")
sql("A10_any_degraded", "SELECT l_orderkey, bool_or(url_score IS NULL) AS degraded, bool_and(url_score IS NULL) AS all_degraded FROM scored GROUP BY l_orderkey")
sql("A11_category_impacts", "SELECT rule_id % 50 AS email, least(100, greatest(0, CAST(sum(CASE WHEN rule_id % 3 = 0 THEN score_impact ELSE 0 END) AS BIGINT))) AS auth, least(100, greatest(0, CAST(sum(CASE WHEN rule_id % 3 = 1 THEN score_impact ELSE 0 END) AS BIGINT))) AS reputation FROM rule_hits GROUP BY rule_id % 50")
sql("A12_total_impact", "SELECT rule_id % 50 AS email, CAST(sum(score_impact - 25) AS BIGINT) AS impact FROM rule_hits GROUP BY rule_id % 50")


@on("A13_tag_union", "SELECT user_id, list_sort(list_distinct(list(trim(event_type)))) AS tags FROM events GROUP BY user_id")
def a13(spark, d):
    return frame_table(spark, d, "events").groupBy("user_id").agg(r.tag_union(F.collect_set("event_type")).alias("tags"))


@on("A14_tag_dedupe", "SELECT * FROM (VALUES (1, ['Phish', 'kit', 'TROJAN']), (2, ['a']), (3, CAST([] AS VARCHAR[]))) t(id, tags)")
def a14(spark, d):
    df = spark.createDataFrame([(1, ["Phish", " phish", "kit", "KIT ", "", "TROJAN"]), (2, ["a", "A"]), (3, [])], "id int, tags array<string>")
    return df.select("id", r.tag_dedupe(F.col("tags")).alias("tags"))


A15_OLD, A15_NEW = "SELECT c_custkey AS id, c_nationkey AS risk FROM customer WHERE c_custkey % 3 <> 0", "SELECT c_custkey AS id, c_nationkey + 5 AS risk FROM customer WHERE c_custkey % 2 = 0"


@on("A15_merge_counters", f"SELECT CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS action, count(*) AS n FROM ({A15_OLD}) o FULL JOIN ({A15_NEW}) n ON o.id = n.id GROUP BY ALL")
def a15(spark, d):
    views(spark, d)
    return r.upsert(spark.sql(A15_OLD), spark.sql(A15_NEW), ["id"], {"risk": lambda o, n: F.greatest(o, n)}).groupBy("action").agg(F.count("*").alias("n"))


sql("A16_value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")


@on("A17_pivot", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) AS total FROM documents GROUP BY source")
def a17(spark, d):
    docs = frame_table(spark, d, "documents")
    pivot = docs.groupBy("source").pivot("lang", ["en", "de", "fr"]).agg(F.count(F.lit(1))).na.fill(0)
    return pivot.join(docs.groupBy("source").agg(F.count("*").alias("total")), "source")


sql("A20_family_recall", "SELECT source, count(*) AS n, round(avg(CASE WHEN score >= 50 THEN 1e0 ELSE 0e0 END), 6) AS recall FROM judged WHERE positive GROUP BY source")
sql("A21_reweighted_accuracy", "SELECT round(sum(w * acc) / sum(w), 6) AS accuracy FROM (SELECT lang, avg(CASE WHEN positive = (score >= 50) THEN 1e0 ELSE 0e0 END) AS acc, CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.3 ELSE 0.1 END AS w FROM judged GROUP BY lang) t")
sql("A22_quantiles", "SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS q1, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS q2, percentile_cont(0.75) WITHIN GROUP (ORDER BY o_totalprice) AS q3 FROM orders")
sql("A22b_outliers", "SELECT count(*) AS n FROM documents, (SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY n_chars) AS q1, percentile_cont(0.75) WITHIN GROUP (ORDER BY n_chars) AS q3 FROM documents) q WHERE n_chars > q3 + 1.5 * (q3 - q1) OR n_chars < q1 - 1.5 * (q3 - q1)")
sql("A23_describe", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
sql("A24_percentiles", "SELECT lang, percentile_cont(0.5) WITHIN GROUP (ORDER BY n_chars) AS p50, percentile_cont(0.9) WITHIN GROUP (ORDER BY n_chars) AS p90 FROM documents GROUP BY lang")
sql("A31_multi_seed", "SELECT round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std FROM (SELECT user_id % 5 AS seed, avg(value) AS m FROM events GROUP BY user_id % 5) t")
sql("A32_error_groups", "SELECT CASE WHEN positive AND score < 50 THEN 'fn' ELSE 'fp' END AS error, source, CASE WHEN score < 30 THEN 'low' WHEN score < 60 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n FROM judged WHERE positive <> (score >= 50) GROUP BY 1, 2, 3")
sql("A33_deviations", "SELECT source, round((m - t) / s, 4) AS z FROM (SELECT source, avg(score) AS m FROM judged GROUP BY source) a CROSS JOIN (SELECT avg(score) AS t, stddev_samp(score) AS s FROM judged) b")
sql("A34_mix", "SELECT positive, score >= 50 AS predicted, count(*) AS n FROM judged GROUP BY positive, score >= 50")
sql("A35_cardinality", "SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN lang END) + max(CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END) AS with_null FROM documents")
sql("A36_duplicate_groups", "SELECT count(*) AS groups FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) t")
sql("A37_run_agreement", "SELECT round(avg(CASE WHEN (a.risk_score >= 50) = (b.score >= 50) THEN 1e0 ELSE 0e0 END), 6) AS flagged, round(avg(CASE WHEN a.risk_score = b.score THEN 1e0 ELSE 0e0 END), 6) AS exact FROM emails a JOIN verdicts b ON a.internal_id = b.id")
sql("A38_share_of_total", "SELECT org_id, label, n, round(n / CAST(sum(n) OVER (PARTITION BY org_id) AS DOUBLE), 6) AS share FROM (SELECT org_id, label, count(*) AS n FROM emails WHERE label IS NOT NULL GROUP BY org_id, label) t")
sql("A39_score_buckets", "SELECT CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM emails GROUP BY 1")


# latest rows and windows
@on("W01_latest_verdict", "SELECT DISTINCT ON (entity_type, entity_id) entity_type, entity_id, id, score FROM verdicts ORDER BY entity_type, entity_id, created_at DESC, id DESC")
def w01(spark, d):
    return r.latest(frame(spark, d, "verdicts"), ["entity_type", "entity_id"], [F.desc("created_at"), F.desc("id")]).select("entity_type", "entity_id", "id", "score")


@on("W02_latest_per_key", "SELECT entity_id, max_by(id, (created_at, id)) AS id FROM verdicts GROUP BY entity_id")
def w02(spark, d):
    return frame(spark, d, "verdicts").groupBy("entity_id").agg(F.max(F.struct("created_at", "id")).alias("x")).select("entity_id", "x.id")


@on("W03_first_wins", "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, ts, event_id")
def w03(spark, d):
    return r.latest(frame_table(spark, d, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


@on("W04_dedupe_and_cap", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT DISTINCT ON (user_id, CAST(floor(value) AS BIGINT)) * FROM events ORDER BY user_id, CAST(floor(value) AS BIGINT), ts, event_id)) WHERE n <= 15")
def w04(spark, d):
    ev = frame_table(spark, d, "events").withColumn("k", F.floor("value").cast("long"))
    first = r.latest(ev, ["user_id", "k"], [F.asc("ts"), F.asc("event_id")])
    from pyspark.sql.window import Window

    return first.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("n <= 15").select("user_id", "event_id")


@on("W05_priority_dedupe", "SELECT DISTINCT ON (text) doc_id, source FROM documents ORDER BY text, source, doc_id")
def w05(spark, d):
    best = frame_table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.min(F.struct("source", "doc_id")).alias("x"))
    return best.select("x.doc_id", "x.source")


sql("W07_running_count", "SELECT internal_id, campaign_id, count(*) OVER (PARTITION BY campaign_id ORDER BY fetched_at, internal_id ROWS UNBOUNDED PRECEDING) AS n FROM emails")


@on("W08_monthly_quota", "SELECT event_id, n AS used, n <= 20 AS accepted FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 5, date_trunc('month', ts) ORDER BY ts, event_id) AS n FROM events)")
def w08(spark, d):
    ev = frame_table(spark, d, "events").withColumn("org", F.col("user_id") % 5)
    return r.quota(ev, ["org"], "ts", 20, ["event_id"]).select("event_id", F.col("used").cast("long").alias("used"), "accepted")


FOLD = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS n FROM events),
    f({keys}, event_id, n, opened, allowed) AS (SELECT {keys}, event_id, n, t, TRUE FROM e WHERE n = 1 UNION ALL
    SELECT {qual}, e.event_id, e.n, CASE WHEN e.t - f.opened >= {sec} THEN e.t ELSE f.opened END, e.t - f.opened >= {sec} FROM f JOIN e ON {on} AND e.n = f.n + 1) SELECT event_id, allowed FROM f"""


@on("W09_rate_limit", FOLD.format(keys="user_id", qual="e.user_id", on="e.user_id = f.user_id", sec=3600))
def w09(spark, d):
    return r.first_within(frame_table(spark, d, "events"), ["user_id"], "ts", 3600, ["ts", "event_id"]).select("event_id", "allowed")


@on("W10_claim_ttl", FOLD.format(keys="user_id, event_type", qual="e.user_id, e.event_type", on="e.user_id = f.user_id AND e.event_type = f.event_type", sec=7 * 86400))
def w10(spark, d):
    return r.first_within(frame_table(spark, d, "events"), ["user_id", "event_type"], "ts", 7 * 86400, ["ts", "event_id"]).select("event_id", "allowed")


sql("W11_child_numbers", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem")

# sorts
sql("T01_page", "SELECT internal_id, risk_score FROM emails ORDER BY fetched_at DESC, internal_id DESC LIMIT 50 OFFSET 100")
sql("T02_nulls_last", "SELECT id, asn FROM threats ORDER BY asn DESC NULLS LAST, id LIMIT 40")
sql("T03_queue", f"SELECT id, priority FROM ({JOBS}) j WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 10")


@on("T04_best_match", "SELECT feed_id, max_by(id, (risk_score, -id)) AS id FROM threats GROUP BY feed_id")
def t04(spark, d):
    return frame(spark, d, "threats").groupBy("feed_id").agg(F.max(F.struct("risk_score", (-F.col("id")).alias("neg"))).alias("x")).select("feed_id", (-F.col("x.neg")).alias("id"))


@on("T05_riskiest_url", "SELECT DISTINCT ON (org_id) org_id, url FROM threats WHERE url <> '' ORDER BY org_id, risk_score DESC, id")
def t05(spark, d):
    return frame(spark, d, "threats").where("url <> ''").groupBy("org_id").agg(F.max_by("url", F.struct("risk_score", -F.col("id"))).alias("url"))


sql("T06_distinct_sorted", "SELECT DISTINCT org_id, event_type FROM emails ORDER BY org_id, event_type")
sql("T07_recent_items", "SELECT internal_id FROM emails ORDER BY fetched_at DESC, internal_id DESC LIMIT 100")


@on("T08_pagination", "SELECT internal_id FROM emails ORDER BY internal_id LIMIT 25 OFFSET 50")
def t08(spark, d):
    return r.page(frame(spark, d, "emails").select("internal_id"), [F.asc("internal_id")], 25, 50)


# set operations and merges
sql("U01_concatenate", "SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey AS id, 'supplier' AS kind FROM supplier")
sql("U02_leakage", "SELECT count(*) AS shared FROM (SELECT text FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 3 <> 0) t")
sql("U03_disjoint_groups", "SELECT count(*) AS both_sides FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0) a WHERE source IN (SELECT source FROM documents WHERE doc_id % 2 = 1)")

OLD_TI = "SELECT p_partkey AS id, p_brand AS tag, p_size AS risk, p_partkey % 4 <> 0 AS is_active, 'old' AS threat_type, 1 AS seen FROM part WHERE p_partkey % 3 <> 0"
NEW_TI = "SELECT p_partkey AS id, p_type AS tag, (p_size * 7) % 60 AS risk, TRUE AS is_active, 'new' AS threat_type, 2 AS seen FROM part WHERE p_partkey % 2 = 0"


@on("U04_indicator_upsert", f"""SELECT COALESCE(o.id, n.id) AS id, list_sort(list_distinct(list_filter([o.tag, n.tag], lambda x: x IS NOT NULL))) AS tags, greatest(o.risk, n.risk) AS risk, CASE WHEN n.id IS NULL THEN o.is_active ELSE TRUE END AS is_active,
    COALESCE(o.threat_type, n.threat_type) AS threat_type, COALESCE(n.seen, o.seen) AS seen FROM ({OLD_TI}) o FULL JOIN ({NEW_TI}) n ON o.id = n.id""")
def u04(spark, d):
    views(spark, d)
    arr = lambda df: df.withColumn("tags", F.array(F.trim("tag"))).drop("tag")
    how = {"tags": r.tag_union, "risk": lambda o, n: F.greatest(o, n), "is_active": lambda o, n: F.lit(True), "seen": lambda o, n: n}
    return r.upsert(arr(spark.sql(OLD_TI)), arr(spark.sql(NEW_TI)), ["id"], how).select("id", "tags", "risk", "is_active", "threat_type", "seen")


@on("U05_deactivate_unseen", f"SELECT id, is_active AND seen >= 2 AS is_active FROM ({OLD_TI} UNION ALL {NEW_TI})")
def u05(spark, d):
    views(spark, d)
    return r.deactivate_unseen(spark.sql(f"{OLD_TI} UNION ALL {NEW_TI}"), F.lit(2), seen="seen").select("id", "is_active")


@on("U06_attachment_upsert", f"SELECT COALESCE(o.id, n.id) AS id, COALESCE(n.tag, o.tag) AS tag, COALESCE(n.risk, o.risk) AS risk FROM ({OLD_TI}) o FULL JOIN ({NEW_TI}) n ON o.id = n.id")
def u06(spark, d):
    views(spark, d)
    new = lambda o, n: F.coalesce(n, o)
    return r.upsert(spark.sql(OLD_TI), spark.sql(NEW_TI), ["id"], {"tag": new, "risk": new}).select("id", "tag", "risk")


@on("U07_malware_hash_upsert", f"SELECT COALESCE(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN TRUE ELSE o.risk > 25 END AS is_malicious, greatest(o.risk, n.risk) AS risk FROM ({OLD_TI}) o FULL JOIN ({NEW_TI}) n ON o.id = n.id")
def u07(spark, d):
    views(spark, d)
    old = spark.sql(OLD_TI).select("id", (F.col("risk") > 25).alias("is_malicious"), "risk")
    new = spark.sql(NEW_TI).select("id", F.lit(True).alias("is_malicious"), "risk")
    return r.upsert(old, new, ["id"], {"is_malicious": lambda o, n: F.lit(True), "risk": lambda o, n: F.greatest(o, n)}).select("id", "is_malicious", "risk")


@on("U08_heuristic_upsert", f"SELECT COALESCE(o.id, n.id) AS id, COALESCE(o.risk > 25, FALSE) AS is_malicious, greatest(o.risk, n.risk) AS risk FROM ({OLD_TI}) o FULL JOIN ({NEW_TI}) n ON o.id = n.id")
def u08(spark, d):
    views(spark, d)
    old = spark.sql(OLD_TI).select("id", (F.col("risk") > 25).alias("is_malicious"), "risk")
    new = spark.sql(NEW_TI).select("id", "risk")
    return r.upsert(old, new, ["id"], {"risk": lambda o, n: F.greatest(o, n)}, {"is_malicious": F.lit(False)}).select("id", "is_malicious", "risk")


@on("U09_insert_missing", f"SELECT id, tag, risk FROM ({OLD_TI}) UNION ALL SELECT id, tag, risk FROM ({NEW_TI}) n WHERE NOT EXISTS (SELECT 1 FROM ({OLD_TI}) o WHERE o.id = n.id)")
def u09(spark, d):
    views(spark, d)
    cols = ["id", "tag", "risk"]
    return r.insert_missing(spark.sql(OLD_TI).select(*cols), spark.sql(NEW_TI).select(*cols), ["id"])


STATE = "SELECT DISTINCT campaign_id AS id, CAST(campaign_id % 80 AS BIGINT) AS risk_score, CAST(campaign_id % 4 + 1 AS BIGINT) AS email_count FROM emails WHERE campaign_id % 3 <> 0"
GROWN = f"""WITH RECURSIVE s AS ({STATE}), o AS (SELECT campaign_id AS id, risk_score AS v, row_number() OVER (PARTITION BY campaign_id ORDER BY fetched_at, internal_id) AS k FROM emails),
    m(id, k, mean, n) AS (SELECT c.id, CAST(0 AS BIGINT), coalesce(s.risk_score, 0), coalesce(s.email_count, 0) FROM (SELECT id FROM s UNION SELECT id FROM o) c LEFT JOIN s ON s.id = c.id
    UNION ALL SELECT o.id, o.k, CAST(floor((m.mean * m.n + o.v) / CAST(m.n + 1 AS DOUBLE) + 0.5) AS BIGINT), m.n + 1 FROM m JOIN o ON o.id = m.id AND o.k = m.k + 1)"""


@on("U10_campaign_upsert", f"{GROWN} SELECT m.id, s.id IS NULL AS is_new, max_by(m.mean, m.k) AS risk_score, max(m.n) AS email_count FROM m LEFT JOIN s ON s.id = m.id GROUP BY m.id, s.id")
def u10(spark, d):
    views(spark, d)
    return r.campaign_upsert(spark.sql(with_ctes(STATE)), frame(spark, d, "emails").withColumnRenamed("campaign_id", "id").withColumnRenamed("risk_score", "v"), "id", "v", ["fetched_at", "internal_id"])


SIGHTS = "SELECT campaign_id AS id, max(fetched_at) AS last_seen FROM emails GROUP BY campaign_id"
SEEN = "SELECT id, risk_score, TIMESTAMP '2023-12-01 00:00:00' AS last_seen FROM threats"


@on("U11_touch", f"SELECT COALESCE(o.id, n.id) AS id, o.risk_score, COALESCE(n.last_seen, o.last_seen) AS last_seen FROM ({SEEN}) o FULL JOIN ({SIGHTS}) n ON o.id = n.id")
def u11(spark, d):
    views(spark, d)
    return r.upsert(spark.sql(with_ctes(SEEN)), spark.sql(with_ctes(SIGHTS)), ["id"], {"last_seen": lambda o, n: n}).drop("action")


CHANGES = "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_type END AS threat_type, CASE WHEN p_size % 3 = 0 THEN p_size END AS asn, CASE WHEN p_size % 5 = 0 THEN p_size % 6 END AS feed_id, CASE WHEN p_size % 7 = 0 THEN TRUE END AS online, CASE WHEN p_size % 4 = 0 THEN p_size END AS risk_score FROM part"
CHANGED = ["threat_type", "asn", "feed_id", "online", "risk_score"]


@on("U12_partial_update", "SELECT t.id, t.url, t.is_global, " + ", ".join(f"CASE WHEN t.is_global THEN t.{c} ELSE COALESCE(n.{c}, t.{c}) END AS {c}" for c in CHANGED) + f" FROM threats t LEFT JOIN ({CHANGES}) n ON n.id = t.id")
def u12(spark, d):
    t = frame(spark, d, "threats").select("id", "url", "is_global", *CHANGED)
    return r.partial_update(t, spark.sql(CHANGES), "id", ~F.col("is_global"))


OLD_RESULT, NEW_RESULT = ("SELECT id, score, created_at FROM (SELECT entity_id AS id, max(score) AS score, max(created_at) AS created_at FROM verdicts WHERE entity_type = '{}' GROUP BY entity_id) x".format(k) for k in ("view", "click"))


@on("U13_enrichment_ttl", f"SELECT COALESCE(o.id, n.id) AS id, COALESCE(n.score, o.score) AS score, COALESCE(n.created_at, o.created_at) + INTERVAL '7' DAY AS expires_at FROM ({OLD_RESULT}) o FULL JOIN ({NEW_RESULT}) n ON o.id = n.id")
def u13(spark, d):
    views(spark, d)
    kept = lambda q: spark.sql(with_ctes(q)).select("id", "score", (F.col("created_at") + F.expr("INTERVAL '7' DAY")).alias("expires_at"))
    return r.upsert(kept(OLD_RESULT), kept(NEW_RESULT), ["id"], {"score": lambda o, n: n, "expires_at": lambda o, n: n}).drop("action")


DETAILS = "SELECT internal_id AS id, risk_score, CASE WHEN internal_id % 4 = 0 THEN NULL ELSE concat('{\"old\":', CAST(internal_id AS VARCHAR(20)), '}') END AS details FROM emails"
SCORES = "SELECT id, score AS risk_score, CASE WHEN score % 2 = 0 THEN concat('{\"score\":', CAST(score AS VARCHAR(20)), '}') END AS details FROM verdicts WHERE entity_type = 'click'"


@on("U14_score_writeback", f"SELECT o.id, COALESCE(n.risk_score, o.risk_score) AS risk_score, COALESCE(n.details, o.details) AS details FROM ({DETAILS}) o LEFT JOIN ({SCORES}) n ON n.id = o.id")
def u14(spark, d):
    views(spark, d)
    return r.partial_update(spark.sql(with_ctes(DETAILS)), spark.sql(with_ctes(SCORES)), "id")


@on("U15_append_verdicts", "SELECT id, score FROM (SELECT id, score FROM verdicts WHERE entity_type = 'view' UNION ALL SELECT id, score FROM verdicts v WHERE v.entity_type IN ('view', 'click') AND v.id NOT IN (SELECT id FROM verdicts WHERE entity_type = 'view'))")
def u15(spark, d):
    v = frame(spark, d, "verdicts")
    stored, redelivered = v.where("entity_type = 'view'").select("id", "score"), v.where("entity_type IN ('view', 'click')").select("id", "score")
    return r.insert_missing(stored, redelivered, ["id"])


@on("U16_job_states", f"SELECT id, CASE WHEN status = 'in_progress' AND id IN (1, 2, 3, 5, 7, 33) AND attempts + 1 >= max_attempts THEN 'failed' WHEN status = 'in_progress' AND id IN (1, 2, 3, 5, 7, 33) THEN 'pending' ELSE status END AS status FROM ({JOBS})")
def u16(spark, d):
    views(spark, d)
    return r.job_failed(spark.sql(JOBS), [1, 2, 3, 5, 7, 33]).select("id", "status")


@on("U17_identity_claim", "SELECT user_id, event_type, min(event_id) AS winner, count(*) - 1 AS orphans FROM events GROUP BY user_id, event_type")
def u17(spark, d):
    return frame_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("winner"), (F.count("*") - 1).alias("orphans"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@on("U18_cascade_delete", "SELECT v.entity_type AS child, v.id FROM verdicts v WHERE v.entity_type IN ('click', 'error', 'purchase', 'signup', 'view') AND NOT EXISTS (SELECT 1 FROM threats t WHERE t.is_deleted AND t.id = v.entity_id)")
def u18(spark, d):
    v, gone = frame(spark, d, "verdicts"), frame(spark, d, "threats").where("is_deleted").select(F.col("id").alias("entity_id"))
    left = r.cascade_delete({k: v.where(F.col("entity_type") == k) for k in KINDS}, gone, "entity_id")
    return reduce(DataFrame.union, [df.select(F.lit(k).alias("child"), "id") for k, df in left.items()])


@on("U19_label_denorm", "SELECT e.internal_id, v.score AS latest FROM emails e LEFT JOIN (SELECT DISTINCT ON (entity_id) entity_id, score FROM verdicts ORDER BY entity_id, created_at DESC, id DESC) v ON v.entity_id = e.campaign_id")
def u19(spark, d):
    last = frame(spark, d, "verdicts").groupBy("entity_id").agg(F.max_by("score", F.struct("created_at", "id")).alias("latest"))
    e = frame(spark, d, "emails").select("internal_id", "campaign_id")
    return e.join(last, e["campaign_id"] == last["entity_id"], "left").select("internal_id", "latest")


@on("U20_type_normalised", "SELECT p_partkey, lower(p_type) AS kind, lower(p_type) NOT IN (SELECT lower(p_type) FROM part WHERE p_size = 1) AS refused FROM part")
def u20(spark, d):
    part = frame_table(spark, d, "part").select("p_partkey", F.col("p_type").alias("kind"), "p_size")
    return r.referenced(part.drop("p_size"), "kind", part.where("p_size = 1").select("kind"))


sql("U21_sent_at", "SELECT event_id, TIMESTAMP '1970-01-01 00:00:00' + INTERVAL '1' DAY * (event_id % 20000) AS sent_at FROM events")
RENAMED = "SELECT id, concat(name, ' v2') AS name FROM rules WHERE id % 2 = 0"


@on("U22_immutable_rules", f"SELECT x.id, CASE WHEN h.rule_id IS NULL THEN COALESCE(n.name, x.name) ELSE x.name END AS name, h.rule_id IS NOT NULL AND n.id IS NOT NULL AS refused FROM rules x LEFT JOIN (SELECT DISTINCT rule_id FROM rule_hits WHERE score_impact > 45) h ON h.rule_id = x.id LEFT JOIN ({RENAMED}) n ON n.id = x.id")
def u22(spark, d):
    x, hits = frame(spark, d, "rules").select("id", "name"), frame(spark, d, "rule_hits").where("score_impact > 45").select(F.col("rule_id").alias("id"))
    return r.refuse_locked(x, spark.sql(with_ctes(RENAMED)), hits, "id")


@on("U23_revoke_keys", "SELECT o.o_orderkey AS key_id, CASE WHEN o.o_orderkey % 7 = 0 THEN TIMESTAMP '2023-06-01 00:00:00' WHEN c.c_custkey IS NOT NULL THEN TIMESTAMP '2024-01-30 00:00:00' END AS revoked_at FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) c ON c.c_custkey = o.o_custkey")
def u23(spark, d):
    """Keys of users that are gone are revoked now; a key revoked before keeps its time."""
    keys = frame_table(spark, d, "orders").select(F.col("o_orderkey").alias("key_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("2023-06-01 00:00:00").cast("timestamp_ntz")).alias("before"))
    gone = frame_table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").alias("now"))
    return keys.join(gone, "user_id", "left").select("key_id", F.coalesce("before", "now").alias("revoked_at"))


@on("U24_archive_partitions", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CASE WHEN strftime(o_orderdate, '%Y-%m') < '1995-01' THEN 'archive' ELSE 'live' END AS place FROM orders GROUP BY ALL")
def u24(spark, d):
    """Orders written by month, the months before the cutoff apart; counted where they are now."""
    folder = shared_folder(spark, "partitions")
    months = frame_table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    old = F.col("month") < "1995-01"
    for place, rows in {"archive": months.where(old), "live": months.where(~old)}.items():
        rows.repartition("month").write.partitionBy("month").parquet(f"{folder}/{place}")
    count = lambda p: spark.read.schema("o_orderkey long, month string").parquet(f"{folder}/{p}").groupBy("month").agg(F.count("*").alias("n")).withColumn("place", F.lit(p))
    return count("archive").union(count("live"))


sql("U25_data_move", "SELECT id, CASE WHEN url LIKE 'https%' THEN 'url' ELSE 'domain' END AS kind, url AS value, risk_score FROM threats WHERE NOT is_deleted")
