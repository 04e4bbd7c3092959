"""Score algebra, rules, similarity, evaluation and metrics by their operator ids."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores, urls
from ..operators import evaluation as ev
from ..operators import metrics, relational, rules, similarity
from ..registry import query
from ..session import shared_folder, table
from .relational import frame, on, sql
from .scalars import H, literals, values

CH = {"url": "url_score", "header": "header_score", "nlp": "nlp_score", "attachment": "attachment_score"}
KEY = ["l_orderkey", "l_linenumber"]


def channels() -> dict:
    return {k: F.col(c) for k, c in CH.items()}


def scored(name: str, oracle: str, make) -> None:
    """A query over the projected channel scores."""
    on(name, f"SELECT l_orderkey, l_linenumber, {oracle} FROM scored")(lambda spark, d: frame(spark, d, "scored").select(*KEY, *make()))


def pwl(x: str, xs: list, ys: list) -> str:
    mid = " ".join(f"WHEN {x} <= {b!r} THEN {c!r} + ({x} - {a!r}) * ({e!r} - {c!r}) / ({b!r} - {a!r})".replace("e-", "e-") for a, b, c, e in zip(xs, xs[1:], ys, ys[1:], strict=False))
    return f"CASE WHEN {x} <= {xs[0]!r} THEN CAST({ys[0]!r} AS DOUBLE) {mid} ELSE CAST({ys[-1]!r} AS DOUBLE) END"


def dbl(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


W = scores.WEIGHTS
TOTAL = " + ".join(f"CASE WHEN {c} IS NULL THEN 0e0 ELSE CAST({W[k]} AS DOUBLE) * {c} END" for k, c in CH.items())
WSUM = " + ".join(f"CASE WHEN {c} IS NULL THEN 0e0 ELSE CAST({W[k]} AS DOUBLE) END" for k, c in CH.items())
AVG = f"(CASE WHEN ({WSUM}) > 0 THEN least(100e0, greatest(0e0, ({TOTAL}) / ({WSUM}))) ELSE 0e0 END)"
scored("F90_weighted_average", f"round({AVG}, 6) AS risk", lambda: [F.round(scores.weighted_average(channels()), 6).alias("risk")])
NOR = "100e0 * (1 - " + " * ".join(f"(CASE WHEN {c} IS NULL THEN 1e0 ELSE 1 - least(100e0, greatest(0e0, CAST({c} AS DOUBLE))) / 100 END)" for c in CH.values()) + ")"
scored("F91_noisy_or", f"round({NOR}, 6) AS risk", lambda: [F.round(scores.noisy_or(channels()), 6).alias("risk")])
COR = "100e0 * (1 - " + " * ".join(f"(CASE WHEN {c} IS NULL THEN 1e0 ELSE 1 - least(CAST(0.999 AS DOUBLE), {pwl(dbl(c), *scores.CURVES[k])}) END)" for k, c in CH.items()) + ")"
ANY = " OR ".join(f"{c} IS NOT NULL" for c in CH.values())
on("F92_calibrated_or", f"SELECT l_orderkey, l_linenumber, round(CASE WHEN present THEN 100 * ({pwl('raw', *scores.FINAL)}) ELSE 0e0 END, 4) AS risk FROM (SELECT l_orderkey, l_linenumber, {COR} AS raw, ({ANY}) AS present FROM scored) t")(lambda spark, d: frame(spark, d, "scored").select(*KEY, F.round(scores.calibrated_or(channels()), 4).alias("risk")))
scored("F93_piecewise", f"round({pwl('CAST(url_score AS DOUBLE)', *scores.CURVES['nlp'])}, 6) AS p", lambda: [F.when(F.col("url_score").isNull(), F.lit(scores.CURVES["nlp"][1][-1])).otherwise(F.round(scores.piecewise(F.col("url_score").cast("double"), *scores.CURVES["nlp"]), 6)).alias("p")])
scored("F94_nudge", "round(least(100e0, greatest(0e0, CASE WHEN nlp_score IS NULL OR l_linenumber = 1 THEN CAST(COALESCE(url_score, 0) AS DOUBLE) ELSE (1 - least((l_linenumber - 1) / CAST(l_linenumber + 4 AS DOUBLE), 3e-1)) * COALESCE(url_score, 0) + least((l_linenumber - 1) / CAST(l_linenumber + 4 AS DOUBLE), 3e-1) * nlp_score END)), 6) AS nudged",
       lambda: [F.round(scores.nudge(F.coalesce("url_score", F.lit(0)).cast("double"), F.col("l_linenumber") - 1, F.col("nlp_score")), 6).alias("nudged")])
LAB = "CASE WHEN {s} <= 25 THEN 'benign' WHEN {s} <= 50 THEN 'suspicious' WHEN {s} <= 75 THEN 'phishing' ELSE 'malware' END"
scored("F95_label", f"{LAB.format(s='url_score')} AS label", lambda: [scores.label(F.col("url_score")).alias("label")])
scored("F96_reconciled", "CASE WHEN url_score <= 25 THEN 'benign' WHEN url_score <= 50 THEN 'suspicious' WHEN url_score <= 75 THEN 'phishing' WHEN attachment_score >= 76 THEN 'malware' ELSE 'phishing' END AS label", lambda: [scores.reconciled(F.col("url_score"), F.col("attachment_score")).alias("label")])
CONF = "least(url_score - CASE WHEN url_score <= 25 THEN 0 WHEN url_score <= 50 THEN 26 WHEN url_score <= 75 THEN 51 ELSE 76 END, CASE WHEN url_score <= 25 THEN 25 WHEN url_score <= 50 THEN 50 WHEN url_score <= 75 THEN 75 ELSE 100 END - url_score)"
scored("F97_confidence", f"round(CASE WHEN url_score IS NULL THEN 0e0 ELSE {CONF} / 25e0 * CASE WHEN nlp_score IS NULL THEN 7e-1 ELSE 1e0 END * CASE WHEN header_score IS NULL THEN 5e-1 ELSE 1e0 END END, 6) AS conf", lambda: [F.round(scores.confidence(F.col("url_score"), F.col("nlp_score").isNull(), F.when(F.col("header_score").isNull(), "rule").otherwise("model")), 6).alias("conf")])
scored("F98_source", "CASE WHEN url_score IS NULL AND header_score IS NULL AND nlp_score IS NULL THEN 'rule' ELSE 'model' END AS source", lambda: [scores.source(F.col("url_score"), F.col("header_score"), F.col("nlp_score")).alias("source")])
scored("F99_degraded_nulled", "CASE WHEN l_linenumber % 2 = 0 THEN url_score END AS url_score", lambda: [F.when(~F.array_contains(F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("nlp"))).otherwise(F.array(F.lit("url"))), "url"), F.col("url_score")).alias("url_score")])
UL = "CASE WHEN l_linenumber = 1 AND header_score >= 80 THEN 'phishing' WHEN l_linenumber = 2 THEN 'phishing' WHEN l_linenumber = 3 AND nlp_score IS NOT NULL THEN 'legitimate' WHEN l_linenumber = 4 THEN 'suspicious' WHEN url_score >= 70 THEN 'phishing' WHEN url_score >= 40 THEN 'suspicious' ELSE 'legitimate' END"


def _url_label():
    n = F.col("l_linenumber")
    lab = scores.url_label(F.col("url_score"), n == 1, F.col("header_score"), n == 4, F.when(n == 2, "phishing").when(n == 3, "benign").otherwise("none"), F.col("nlp_score").isNull())
    return [lab.alias("label"), scores.envelope_score(lab, F.col("url_score"), F.when(n == 3, "benign").otherwise("none"), F.col("nlp_score").isNull(), F.lit(0.25)).alias("score")]


scored("F100_url_label", f"{UL} AS label, CASE WHEN {UL} = 'phishing' THEN 100 WHEN l_linenumber = 3 AND nlp_score IS NOT NULL AND 25 < url_score THEN 25 ELSE url_score END AS score", _url_label)
scored("F101_header_blend", "CASE WHEN COALESCE(url_score, header_score, nlp_score) IS NOT NULL THEN least(100, greatest(0, greatest(url_score, header_score, nlp_score))) END AS most, CAST(floor((COALESCE(url_score, 0) + COALESCE(header_score, 0) + COALESCE(nlp_score, 0)) / 3e0) AS INT) AS mean",
       lambda: [scores.header_score(F.col("url_score"), F.col("header_score"), F.col("nlp_score")).alias("most"), scores.header_score(*[F.coalesce(c, F.lit(0)) for c in CH.values() if c != "attachment_score"], "average").alias("mean")])
ZONE = "CASE WHEN o IS NULL THEN u WHEN s AND u <= 95e-2 THEN 1e-1 * u + 9e-1 * o WHEN o > 6e-1 AND u >= 5e-2 THEN 25e-2 * u + 75e-2 * o WHEN o < 1e-2 THEN 65e-2 * u + 35e-2 * o ELSE 6e-1 * u + 4e-1 * o END"
on("F102_url_fusion", f"SELECT l_orderkey, l_linenumber, round({ZONE}, 6) AS p FROM (SELECT l_orderkey, l_linenumber, COALESCE(url_score, 0) / 100e0 AS u, nlp_score / 100e0 AS o, l_linenumber = 2 AS s FROM scored) t")(lambda spark, d: frame(spark, d, "scored").select(*KEY, F.round(scores.url_fusion(F.coalesce("url_score", F.lit(0)) / 100.0, F.col("nlp_score") / 100.0, F.col("l_linenumber") == 2), 6).alias("p")))
sql("F103_rounding", "SELECT o_orderkey, CAST(floor(o_totalprice / 100 + 0.5) AS BIGINT) AS half_up FROM orders")
scored("F104_prior_adjusted", "round((u * 1e-1 / 5e-1) / (u * 1e-1 / 5e-1 + (1 - u) * 9e-1 / 5e-1), 6) AS p".replace("u ", "(COALESCE(url_score, 0) / 100e0) ").replace("- u)", "- COALESCE(url_score, 0) / 100e0)"), lambda: [F.round(scores.prior_adjusted(F.coalesce("url_score", F.lit(0)) / 100.0, 0.5, 0.1), 6).alias("p")])
on("F105_decode_score", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.signals.k"), F.get_json_object("props", "$.k")).cast("int").alias("k")))
IND = [(1, "url", " HTTP://A.com/ ", "http://a.com"), (2, "domain", "*.B.com.", "b.com"), (3, "hash", "ABC", "abc"), (4, "email_address", "X@Y.Z", "x@y.z"), (5, "other", " k ", "k"), (6, "url", "", None)]


def _indicator(df: DataFrame) -> DataFrame:
    v, k = F.trim("v"), F.col("kind")
    return df.select("id", F.when(v == "", None).when(k == "url", urls.normalize_url(v)).when(k == "domain", urls.normalize_domain(v)).when(k.isin("hash", "email_address"), F.lower(v)).otherwise(v).alias("n"))


literals("F106_indicator_value", "id int, kind string, v string", [x[:3] for x in IND], f"SELECT * FROM (VALUES {values([(x[0], x[3]) for x in IND])}) t(id, n)", _indicator)
literals("F107_lenient_json", "id int, j string", [(1, '{"v": true, "t": ["a", "b"]}'), (2, '{"v": "yes", "t": "a, b"}'), (3, '{"v": 1}'), (4, '{"v": "0"}')], "SELECT * FROM (VALUES (1, TRUE, ['a', 'b']), (2, TRUE, ['a', 'b']), (3, TRUE, NULL), (4, FALSE, NULL)) t(id, v, t)",
         lambda df: df.select("id", F.lower(F.get_json_object("j", "$.v")).isin("true", "1", "yes").alias("v"), F.transform(F.split(F.regexp_replace(F.get_json_object("j", "$.t"), r'[\[\]"]', ""), ","), lambda x: F.trim(x)).alias("t")))
literals("F82_impersonation", "id int, t string, d string", [(1, "your paypal account", "evil.ru"), (2, "your paypal account", "paypal.com"), (3, "lunch", "a.com")], "SELECT * FROM (VALUES (1, 'paypal', TRUE), (2, 'paypal', FALSE), (3, NULL, FALSE)) t(id, brand, off)",
         lambda df: df.select("id", urls.subdomain_brand(F.replace("t", F.lit(" "), F.lit("."))).alias("brand"), "d").select("id", "brand", F.coalesce(urls.registrable_label(F.col("d")) != F.col("brand"), F.lit(False)).alias("off")))
literals("F87_content_gate", "id int, h string, host string", [(1, "<form action='https://evil.ru/x'><input type=password>", "shop.com"), (2, "50% off 60% off 70% off sale 80% off add to cart", "a.com"), (3, "<p>hi", "b.com")], "SELECT * FROM (VALUES (1, TRUE, FALSE), (2, FALSE, TRUE), (3, FALSE, FALSE)) t(id, offsite, discounts)",
         lambda df: df.select("id", (F.lower("h").rlike("type=['\"]?password") & (urls.registrable_domain(urls.host(F.regexp_extract("h", r"(?i)action=['\"]([^'\"]+)", 1))) != urls.registrable_domain(F.col("host")))).alias("offsite"), (F.size(F.regexp_extract_all("h", F.lit(r"(\d+% off)"), 1)) >= 4).alias("discounts")))

# rules
RULES = [
    (1, None, "spf_fail", "1.0.0", "active", "header", 25, {"category": "auth", "expr": {"signal": "auth.spf", "op": "in", "value": ["click", "ERROR"]}}),
    (2, None, "two", "1.0.0", "active", "header", 35, {"category": "reputation", "expr": {"all": [{"signal": "score.url", "op": "gte", "value": 50}, {"not": {"signal": "auth.spf", "op": "eq", "value": "VIEW"}}]}}),
    (3, 2, "any", "1.1.0", "active", "header", 20, {"any": [{"signal": "score.url", "op": "lt", "value": 5}, {"signal": "no.such", "op": "missing"}, {"signal": "label", "op": "missing"}]}),
    (4, None, "text_as_number", "1.0.0", "active", "header", 10, {"signal": "label", "op": "gte", "value": 3}),
    (5, None, "broken", "1.0.0", "active", "header", 90, {"signal": "label", "op": "like", "value": 3}),
    (6, None, "off", "1.0.0", "archived", "header", 90, {"signal": "label", "op": "exists"}),
    (7, None, "has", "2.0.0", "active", "header", -15, {"category": "structural", "expr": {"signal": "label", "op": "contains", "value": "ISH"}}),
    (8, None, "flag", "1.0.0", "active", "header", 5, {"signal": "deleted", "op": "eq", "value": True}),
    (9, None, "neq", "1.0.0", "active", "header", 7, {"signal": "label", "op": "neq", "value": "Spam"}),
]
SIGNALS = {"auth.spf": "event_type", "score.url": "risk_score", "label": "label", "deleted": "is_deleted"}
FIRED = [
    (1, 25, "auth", "event_type IN ('click', 'error')"), (2, 35, "reputation", "risk_score >= 50 AND event_type <> 'view'"), (3, 20, "structural", "TRUE"), (4, 10, "structural", "label IS NOT NULL"),
    (7, -15, "structural", "COALESCE(contains(label, 'ish'), FALSE)"), (8, 5, "structural", "is_deleted"), (9, 7, "structural", "label IS NOT NULL AND label <> 'spam'"),
]


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(*r[:7], json.dumps(r[7])) for r in RULES]
    return spark.createDataFrame(rows, "id long, org_id long, name string, version string, status string, target string, score_impact int, logic string")


def fired(spark: SparkSession, d: str) -> DataFrame:
    active = rules.active_rules(rule_table(spark), ["header"], 2)
    return rules.evaluate(frame(spark, d, "emails"), active, SIGNALS)


HITS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {i} END" for i, _, _, c in FIRED) + "], lambda x: x IS NOT NULL)"
on("R01_rules_fired", f"SELECT internal_id, {HITS} AS rules FROM emails")(lambda spark, d: fired(spark, d).select("internal_id", F.transform("fired", lambda x: x["rule_id"]).alias("rules")))
SUMS = {k: " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for _, n, cat, c in FIRED if k in (cat, "all")) for k in ("auth", "reputation", "structural", "all")}
on("R07_category_scores", f"SELECT internal_id, {', '.join(f'least(100, greatest(0, {SUMS[k]})) AS {k}' for k in ('auth', 'reputation', 'structural'))} FROM emails")(lambda spark, d: fired(spark, d).select("internal_id", *[rules.category_score(F.col("fired"), k).alias(k) for k in ("auth", "reputation", "structural")]))
on("R09_total_impact", f"SELECT internal_id, {SUMS['all']} AS impact FROM emails")(lambda spark, d: fired(spark, d).select("internal_id", rules.total_impact(F.col("fired")).alias("impact")))
literals("R10_active_rules", "id int", [(1,)], "SELECT * FROM (VALUES (1), (2), (3), (4), (5), (7), (8), (9)) t(id)", lambda df: df.sparkSession.createDataFrame([(int(r["id"]),) for r in rules.active_rules(rule_table(df.sparkSession), ["header"], 2)], "id int"))
on("R12_rule_hits", " UNION ALL ".join(f"SELECT internal_id, {i} AS rule_id, {n} AS score_impact FROM emails WHERE {c}" for i, n, _, c in FIRED))(lambda spark, d: rules.rule_hits(fired(spark, d), ["internal_id"]).select("internal_id", "rule_id", "score_impact"))
HEADER_RULES = [
    (1, 25, {"category": "auth", "expr": {"signal": "auth.spf", "op": "in", "value": ["fail", "softfail"]}}), (2, 35, {"category": "auth", "expr": {"all": [{"signal": "auth.dkim", "op": "in", "value": ["fail", "none"]}, {"signal": "auth.dmarc", "op": "in", "value": ["fail", "softfail"]}]}}),
    (3, 35, {"category": "reputation", "expr": {"all": [{"signal": "reputation.typosquat_distance", "op": "gte", "value": 1}, {"signal": "reputation.typosquat_distance", "op": "lte", "value": 2}]}}), (4, 15, {"category": "structural", "expr": {"signal": "structural.hop_count_above_threshold", "op": "eq", "value": True}}),
]
MAILS = [(1, "fail", "none", "fail", 1, False), (2, "pass", "pass", "pass", 0, True), (3, "softfail", "pass", "none", 3, None)]


def _seed_rules(df: DataFrame) -> DataFrame:
    rows = [{"id": i, "name": f"r{i}", "version": "1.0.0", "score_impact": n, "target": "header", "logic": json.dumps(x)} for i, n, x in HEADER_RULES]
    out = rules.evaluate(df, rows, {"auth.spf": "spf", "auth.dkim": "dkim", "auth.dmarc": "dmarc", "reputation.typosquat_distance": "typo", "structural.hop_count_above_threshold": "hops"})
    return out.select("id", *[rules.category_score(F.col("fired"), c).alias(c) for c in rules.CATEGORIES])


literals("R11_seed_rules", "id int, spf string, dkim string, dmarc string, typo int, hops boolean", MAILS, "SELECT * FROM (VALUES (1, 60, 35, 0), (2, 0, 0, 15), (3, 25, 0, 0)) t(id, auth, reputation, structural)", _seed_rules)

# similarity
ALLOW = "SELECT * FROM (VALUES ('example.com', 1), ('exampl.org', 2), ('example.ne', 3)) t(domain, rank)"
literals("F09_domain_guard", "apex string", [("example.com",), ("example.org",), ("example.net",), ("examplecom",), ("other.io",)], "SELECT * FROM (VALUES ('example.com', 'real', 'example.com'), ('example.org', 'typosquat', 'exampl.org'), ('example.net', 'typosquat', 'example.ne'), ('examplecom', 'typosquat', 'example.com'), ('other.io', 'unknown', NULL)) t(apex, verdict, brand)",
         lambda df: similarity.domain_guard(df, df.sparkSession.createDataFrame([("example.com", 1), ("exampl.org", 2), ("example.ne", 3)], "domain string, rank int")))


@on("J15_typosquat_join", f"SELECT page_id, (SELECT arg_min(domain, rank) FROM ({ALLOW}) WHERE levenshtein(domain, array_to_string(string_split({H}, '.')[-2:], '.')) = 1) AS brand, array_to_string(string_split({H}, '.')[-2:], '.') AS apex FROM pages WHERE array_to_string(string_split({H}, '.')[-2:], '.') <> 'example.com'")
def j15(spark, d):
    apex = table(spark, d, "pages").select("page_id", urls.registrable_domain(urls.host(F.col("url"))).alias("apex")).where("apex <> 'example.com'")
    allow = spark.createDataFrame([("example.com", 1), ("exampl.org", 2), ("example.ne", 3)], "domain string, rank int")
    return similarity.domain_guard(apex, allow).select("page_id", "brand", "apex")


literals("J16_brand_typosquat", "domain string", [("paypa1.com",), ("secure-paypla.com",), ("paypal.com",), ("www.gogle.com",), ("nothing-like.io",)], "SELECT * FROM (VALUES ('paypa1.com', 'paypal.com', 1), ('secure-paypla.com', 'paypal.com', 1), ('paypal.com', NULL, 0), ('www.gogle.com', 'google.com', 1), ('nothing-like.io', NULL, 0)) t(domain, target, distance)", lambda df: similarity.brand_typosquat(df))
on("J17_min_brand_distance", f"SELECT n_nationkey, list_min(list_transform([{', '.join(repr(b) for b in urls.BRAND_SUBSTRINGS)}], lambda b: levenshtein(lower(n_name), b))) AS brand_distance FROM nation")(lambda spark, d: similarity.min_brand_distance(table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("l")), "l", urls.BRAND_SUBSTRINGS).drop("l"))
literals("J18_brand_substring", "id int, h string", [(1, "paypal-security.verify.com"), (2, "www.chase-apple.net"), (3, "cdn.x.io")], "SELECT * FROM (VALUES (1, 'paypal'), (2, 'apple'), (3, NULL)) t(id, b)", lambda df: df.select("id", urls.subdomain_brand(F.col("h")).alias("b")))
@query("J19_simhash_pairs")
def j19(spark, d):
    """Orders whose 64-bit hashes, one of the customer's with one bit changed, are near each other."""
    h = F.xxhash64("o_custkey").bitwiseXOR(F.expr("shiftleft(1L, cast(o_orderkey % 64 AS int))"))
    return similarity.simhash_pairs(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("org"), h.alias("h")), "id", "org", "h")


query("J19b_simhash_documents")(lambda spark, d: _simhash_docs(spark, d))


def _simhash_docs(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.distance import simhash_text

    folder = shared_folder(spark, "simhash")  # hashed once, read twice
    table(spark, d, "documents").select("doc_id", "source", simhash_text(F.lower(F.trim("text"))).alias("h")).write.parquet(folder)
    docs = spark.read.parquet(folder)
    return similarity.simhash_pairs(docs, "doc_id", "source", "h")


PLAN = "SELECT user_id, date_trunc('day', ts) AS day, event_type FROM events"
on("J20_plan_join", f"SELECT user_id, day, list_sort(list_distinct(list(event_type))) AS got, list_sort(list_filter(['click', 'error', 'purchase', 'view'], lambda c: NOT list_contains(list(event_type), c))) AS missing, bool_or(event_type = 'signup') AS planned FROM ({PLAN}) GROUP BY user_id, day")(
    lambda spark, d: table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("got")).select("user_id", "day", "got", F.array_sort(F.array_except(F.array(*[F.lit(c) for c in ("click", "error", "purchase", "view")]), "got")).alias("missing"), F.array_contains("got", "signup").alias("planned"))
)
literals("J28_link_brand", "id int, p string, l string", [(1, "your paypal", "paypal.com"), (2, "hello", "paypal.com"), (3, "paypal", "")], "SELECT * FROM (VALUES (1, FALSE), (2, TRUE), (3, FALSE)) t(id, link_only)", lambda df: df.select("id", (F.coalesce(urls.subdomain_brand(F.col("l")), F.lit("")) != "").alias("x"), F.coalesce(urls.subdomain_brand(F.replace("p", F.lit(" "), F.lit("."))), F.lit("")).alias("y")).select("id", (F.col("x") & (F.col("y") == "")).alias("link_only")))

# evaluation
J = "judged"
POS = "positive"
CONFUSION = "count(*) FILTER (WHERE positive AND score >= 50) AS tp, count(*) FILTER (WHERE NOT positive AND score >= 50) AS fp, count(*) FILTER (WHERE positive AND score < 50) AS fn, count(*) FILTER (WHERE NOT positive AND score < 50) AS tn"
RATES = "CASE WHEN tp + fp > 0 THEN round(tp / CAST(tp + fp AS DOUBLE), 4) ELSE 0e0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / CAST(tp + fn AS DOUBLE), 4) ELSE 0e0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) ELSE 0e0 END AS f1, CASE WHEN fp + tn > 0 THEN round(fp / CAST(fp + tn AS DOUBLE), 4) ELSE 0e0 END AS fpr"
on("A18_confusion", f"SELECT *, {RATES} FROM (SELECT {CONFUSION} FROM judged) t")(lambda spark, d: ev.confusion(frame(spark, d, J), F.col(POS), F.col("score") >= 50))
on("A19_slice_rates", f"SELECT *, {RATES} FROM (SELECT lang, {CONFUSION} FROM judged GROUP BY lang) t")(lambda spark, d: ev.confusion(frame(spark, d, J), F.col(POS), F.col("score") >= 50, ["lang"]))
SWEEP = "SELECT score AS threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS pos, CAST(sum(n) OVER () AS BIGINT) AS neg FROM (SELECT score, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS n FROM judged GROUP BY score) WINDOW w AS (ORDER BY score DESC)"
on("W06_cumulative_counts", f"SELECT threshold, tp, fp FROM ({SWEEP})")(lambda spark, d: ev.sweep(frame(spark, d, J), "score", F.col(POS)).select("threshold", "tp", "fp"))
on("A25_roc_auc", "SELECT round((SELECT sum(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 5e-1 ELSE 0e0 END) FROM judged a, judged b WHERE a.positive AND NOT b.positive) / ((SELECT count(*) FROM judged WHERE positive) * (SELECT count(*) FROM judged WHERE NOT positive)), 6) AS auc")(lambda spark, d: ev.roc_auc(frame(spark, d, J), "score", F.col(POS)))
on("A26_best_f1", f"SELECT threshold, round(tp / CAST(pos AS DOUBLE), 6) AS recall, round(fp / CAST(neg AS DOUBLE), 6) AS fpr, round(2 * tp / CAST(pos + tp + fp AS DOUBLE), 6) AS f1 FROM ({SWEEP}) ORDER BY 2 * tp / CAST(pos + tp + fp AS DOUBLE) DESC, threshold DESC LIMIT 1")(lambda spark, d: ev.best_threshold(frame(spark, d, J), "score", F.col(POS)))
on("M16_operating_point", f"SELECT threshold, round(tp / CAST(pos AS DOUBLE), 6) AS recall, round(fp / CAST(neg AS DOUBLE), 6) AS fpr, round(2 * tp / CAST(pos + tp + fp AS DOUBLE), 6) AS f1 FROM ({SWEEP}) WHERE fp / CAST(neg AS DOUBLE) <= 2e-1 ORDER BY tp DESC, threshold DESC LIMIT 1")(lambda spark, d: ev.best_threshold(frame(spark, d, J), "score", F.col(POS), 0.2))
on("A27_partial_auc", f"SELECT round(sum((e - f0) * (CASE WHEN f > f0 THEN t0 + (t - t0) * (e - f0) / (f - f0) ELSE t END + t0) / 2) / 5e-2, 6) AS pauc FROM (SELECT *, least(f, 5e-2) AS e FROM (SELECT t, f, lag(t, 1, 0e0) OVER (ORDER BY threshold DESC) AS t0, lag(f, 1, 0e0) OVER (ORDER BY threshold DESC) AS f0 FROM (SELECT threshold, tp / CAST(pos AS DOUBLE) AS t, fp / CAST(neg AS DOUBLE) AS f FROM ({SWEEP}))) WHERE f0 < 5e-2)")(lambda spark, d: ev.partial_auc(frame(spark, d, J), "score", F.col(POS)))
query("A28_bootstrap")(lambda spark, d: ev.bootstrap(frame(spark, d, J), "doc_id", (F.col(POS) == (F.col("score") >= 50)).cast("int")))
ZZ = "1.959964e0"
on("A29_wilson", f"SELECT source, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM (SELECT source, count(*) FILTER (WHERE positive) / CAST(count(*) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n, {ZZ} AS z FROM judged GROUP BY source) t")(lambda spark, d: _wilson(spark, d))


def _wilson(spark: SparkSession, d: str) -> DataFrame:
    per = frame(spark, d, J).groupBy("source").agg(F.count_if(POS).alias("k"), F.count("*").alias("n"))
    low, high = ev.wilson(F.col("k"), F.col("n"))
    return per.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


BIN = "CAST(least(floor(score / 1.01e2 * 15), 14) AS INT)"
on("A30_calibration", f"SELECT round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM (SELECT {BIN} AS bin, count(*) AS n, sum(score / 1.01e2) AS sp, sum(CAST(positive AS DOUBLE)) AS sy, sum((score / 1.01e2 - CAST(positive AS DOUBLE)) * (score / 1.01e2 - CAST(positive AS DOUBLE))) AS sq FROM judged GROUP BY 1) t")(lambda spark, d: ev.calibration_error(frame(spark, d, J), F.col("score") / 101.0, F.col(POS)))
on("A30b_reliability", f"SELECT {BIN} AS bin, count(*) AS n, round(avg(score / 1.01e2), 6) AS mean_p, round(avg(CAST(positive AS DOUBLE)), 6) AS rate FROM judged GROUP BY 1")(lambda spark, d: ev.reliability(frame(spark, d, J), F.col("score") / 101.0, F.col(POS)))
SHARE = "CAST(CAST('0x' || substr(md5('7:' || {c}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0"
on("M10_stratified_split", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) <= floor(0.6 * count(*) OVER (PARTITION BY lang)) AS is_train FROM documents")(lambda spark, d: ev.stratified_split(table(spark, d, "documents"), "doc_id", "lang", 0.6, 7).select("doc_id", "is_train"))
on("M11_group_split", f"SELECT page_id, CASE WHEN s < 0.7 THEN 'train' WHEN s < 0.85 THEN 'valid' ELSE 'test' END AS split FROM (SELECT page_id, {SHARE.format(c=H)} AS s FROM pages)")(lambda spark, d: ev.group_split(table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("h")), "h", {"train": 0.7, "valid": 0.15, "test": 0.15}, 7).select("page_id", "split"))
on("M12_group_folds", f"SELECT doc_id, CAST(floor({SHARE.format(c='source')} * 5) AS INT) AS fold FROM documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", F.floor(ev.hash_share(F.lit("7"), F.col("source")) * 5).cast("int").alias("fold")))
FOLD = f"CAST(floor({SHARE.format(c='source')} * 5) AS INT)"


@on("M13_out_of_fold", f"""WITH j AS (SELECT doc_id, source, positive, CAST(floor(score / 10) AS INT) AS bin, {FOLD} AS fold FROM judged), c AS (SELECT fold, bin, count(*) FILTER (WHERE positive) AS p, count(*) AS n FROM j GROUP BY fold, bin),
    t AS (SELECT bin, sum(p) AS p, sum(n) AS n FROM c GROUP BY bin), a AS (SELECT sum(p) AS p, sum(n) AS n FROM c), f AS (SELECT fold, sum(p) AS p, sum(n) AS n FROM c GROUP BY fold)
    SELECT j.doc_id, j.fold, round((t.p - c.p + CAST(a.p - f.p AS DOUBLE) / (a.n - f.n)) / (t.n - c.n + 1), 6) AS out_of_fold FROM j JOIN c USING (fold, bin) JOIN t USING (bin) JOIN f USING (fold), a""")
def m13(spark, d):
    """Each document scored by a table of rates that no document of its source's fold entered."""
    j = frame(spark, d, "judged").select("doc_id", "positive", F.floor(F.col("score") / 10).cast("int").alias("bin"), F.floor(ev.hash_share(F.lit("7"), F.col("source")) * 5).cast("int").alias("fold"))
    return ev.out_of_fold(j, "fold", "bin", "positive").select("doc_id", "fold", F.round("out_of_fold", 6).alias("out_of_fold"))


on("M14_provenance_holdout", "SELECT source, count(*) AS n, count(*) FILTER (WHERE positive) AS positives, count(*) FILTER (WHERE positive AND score >= 50) AS caught FROM judged WHERE lang <> 'en' GROUP BY source")(
    lambda spark, d: ev.held_out_by(frame(spark, d, "judged"), "lang", ["en"]).where("NOT is_train").groupBy("source").agg(F.count("*").alias("n"), F.count_if("positive").alias("positives"), F.count_if(F.col("positive") & (F.col("score") >= 50)).alias("caught"))
)
on("M15_family_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM documents) WHERE n <= least(20, greatest(5, floor(0.3 * c)))")(lambda spark, d: _family(spark, d))


def _family(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source")
    docs = table(spark, d, "documents").select("doc_id", "source")
    ranked = docs.withColumn("n", F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("7:"), "doc_id")), "doc_id"))).withColumn("c", F.count("*").over(w))
    return ranked.where(F.col("n") <= F.least(F.lit(20), F.greatest(F.lit(5), F.floor(0.3 * F.col("c"))))).select("doc_id", "source")


MODES = {"average": AVG, "noisy_or": NOR, "max": "CAST(COALESCE(greatest(url_score, header_score, nlp_score, attachment_score), 0) AS DOUBLE)"}
on("M18_fusion_bakeoff", f"SELECT {', '.join(f'round(avg({x}), 6) AS {k}' for k, x in MODES.items())} FROM scored")(lambda spark, d: frame(spark, d, "scored").agg(F.round(F.avg(scores.weighted_average(channels())), 6).alias("average"), F.round(F.avg(scores.noisy_or(channels())), 6).alias("noisy_or"), F.round(F.avg(F.coalesce(F.greatest(*CH.values()), F.lit(0)).cast("double")), 6).alias("max")))
@on("M19_spam_gate", "SELECT doc_id, round(score * (1 - 5e-1 * COALESCE(CASE WHEN quality = 0 THEN (score % 10) / 1e1 END, 0)), 6) AS suppressed, round(score * CASE WHEN quality = 0 THEN 3e-1 ELSE 1e0 END, 6) AS gated FROM judged")
def m19(spark: SparkSession, d: str) -> DataFrame:
    rows, spam = frame(spark, d, "judged"), F.col("quality") == 0
    suppressed = scores.spam_suppressed(F.col("score"), F.when(spam, F.col("score") % 10 / 10), 0.5)
    return rows.select("doc_id", F.round(suppressed, 6).alias("suppressed"), F.round(scores.class_gated(F.col("score"), F.when(spam, "spam")), 6).alias("gated"))


@on("M20_vote_lookup", """WITH c AS (SELECT user_id AS id, max(ts) AS at, arg_max(event_id % 3, ts) AS votes FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 240 HOUR GROUP BY user_id)
    SELECT p.page_id, COALESCE(c.votes, t.risk_score - 50, 0) > 0 AS malicious, CASE WHEN c.id IS NOT NULL THEN 'cached' WHEN t.id IS NOT NULL THEN 'asked' ELSE 'skipped' END AS origin
    FROM pages p LEFT JOIN c ON c.id = p.page_id LEFT JOIN threats t ON t.id = p.page_id AND NOT t.is_deleted""")
def m20(spark: SparkSession, d: str) -> DataFrame:
    """Events stand for cached answers by time, threats for the service's answers; the cache holds for ten days here."""
    pages = table(spark, d, "pages").select("page_id")
    cache = table(spark, d, "events").select(F.col("user_id").alias("page_id"), (F.col("event_id") % 3).alias("votes"), "ts")
    answers = frame(spark, d, "threats").where("NOT is_deleted").select(F.col("id").alias("page_id"), (F.col("risk_score") - 50).alias("votes"))
    return relational.looked_up(pages, "page_id", cache, answers, "votes", "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 240)


on("M24_fold_auc", f"SELECT fold, round((sum(CASE WHEN positive THEN r ELSE 0 END) - np * (np + 1) / 2e0) / NULLIF(np * CAST(n - np AS DOUBLE), 0), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2e0 AS r, count(*) FILTER (WHERE positive) OVER (PARTITION BY fold) AS np, count(*) OVER (PARTITION BY fold) AS n FROM (SELECT *, doc_id % 5 AS fold FROM judged)) GROUP BY fold, np, n")(lambda spark, d: _fold_auc(spark, d))


def _fold_auc(spark: SparkSession, d: str) -> DataFrame:
    per = frame(spark, d, J).groupBy((F.col("doc_id") % 5).alias("fold"), "score").agg(F.count_if(POS).alias("p"), F.count_if(~F.col(POS)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("fold").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("wins", F.col("p") * (below + F.col("n") / 2))
    return per.groupBy("fold").agg(F.round(F.try_divide(F.sum("wins"), F.sum("p") * F.sum("n")), 6).alias("auc"))


# metrics over cumulative counters: per user, value of the counter is the running count of events
COUNTER = "SELECT event_type AS series, user_id AS instance, ts, count(*) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events"
INC = f"SELECT series, date_trunc('hour', ts) AS w, CASE WHEN d < 0 THEN value ELSE d END AS inc FROM (SELECT *, value - lag(value) OVER (PARTITION BY series, instance ORDER BY ts, value) AS d FROM ({COUNTER}) c) x WHERE d IS NOT NULL"


def _counter(spark: SparkSession, d: str) -> DataFrame:
    from ..session import views

    views(spark, d)
    return spark.sql(COUNTER)


query("Q01_rate", f"SELECT series, w AS window_start, round(sum(inc) / 3600e0, 8) AS rate FROM ({INC}) i GROUP BY series, w")(lambda spark, d: metrics.rate(_counter(spark, d), ["series"], "instance", "1 hour").withColumn("rate", F.round("rate", 8)))
query("Q02_increase", f"SELECT series, w AS window_start, CAST(sum(inc) AS BIGINT) AS increase FROM ({INC}) i GROUP BY series, w")(lambda spark, d: metrics.increase(_counter(spark, d), ["series"], "instance", "1 hour"))
BUCKETS = [10, 25, 50, 100, 250]
CUM = " UNION ALL ".join(f"SELECT event_type AS series, {b}e0 AS le, count(*) FILTER (WHERE value <= {b}) AS n FROM events GROUP BY event_type" for b in BUCKETS) + " UNION ALL SELECT event_type, CAST('Infinity' AS DOUBLE), count(*) FROM events GROUP BY event_type"


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    le = F.array(*[F.lit(float(b)) for b in BUCKETS], F.lit(float("inf")))
    return e.groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate([*BUCKETS, float("inf")])]).select(F.col("event_type").alias("series"), F.posexplode(F.array(*[f"b{i}" for i in range(len(BUCKETS) + 1)])).alias("i", "n")).select("series", F.get(le, F.col("i")).alias("le"), "n")


query("Q03_histogram_quantile", f"SELECT series, round(arg_min(CASE WHEN isinf(le) THEN prev_le ELSE prev_le + (le - prev_le) * (rank - prev_n) / CAST(n - prev_n AS DOUBLE) END, le), 6) AS q FROM (SELECT series, le, n, COALESCE(lag(le) OVER (PARTITION BY series ORDER BY le), 0e0) AS prev_le, COALESCE(lag(n) OVER (PARTITION BY series ORDER BY le), 0) AS prev_n, 5e-1 * max(n) OVER (PARTITION BY series) AS rank FROM ({CUM})) WHERE n >= rank GROUP BY series")(lambda spark, d: metrics.histogram_quantile(_buckets(spark, d), ["series"], 0.5).withColumn("q", F.round("q", 6)))
sql("Q04_topk", "SELECT rule_id, count(*) AS n FROM rule_hits GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 10")
sql("Q05_ratio_of_sums", "SELECT event_type, date_trunc('day', ts) AS day, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY event_type, date_trunc('day', ts)")
sql("Q06_contingency", "SELECT CASE WHEN e.risk_score <= 50 THEN 'low' ELSE 'high' END AS active, CASE WHEN v.score <= 75 THEN 'low' ELSE 'high' END AS shadow, count(*) AS n FROM emails e JOIN verdicts v ON v.id = e.internal_id GROUP BY 1, 2")
on("Q07_last_value", "SELECT event_type, max_by(value, (ts, event_id)) / 100 AS value FROM events GROUP BY event_type")(lambda spark, d: metrics.last_value(table(spark, d, "events"), ["event_type"], "ts", "event_id").select("event_type", (F.col("value") / 100).alias("value")))
sql("Q08_global_total", "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY date_trunc('day', ts)")
sql("X02_plan_builder", "SELECT doc_id, concat('header', CASE WHEN n_chars % 2 = 0 THEN ',url' ELSE '' END, CASE WHEN n_chars % 3 = 0 THEN ',attachment' ELSE '' END, CASE WHEN n_chars > 0 THEN ',nlp' ELSE '' END) AS expected FROM documents")
sql("X04_completeness", "SELECT user_id, bool_or(event_type = 'click') AND bool_or(event_type = 'view') AND bool_or(event_type = 'purchase') AS complete FROM events GROUP BY user_id")
sql("X20_shadow_comparison", "SELECT count(*) FILTER (WHERE (e.risk_score >= 50) <> (v.score >= 60)) AS changed, count(*) AS n FROM emails e JOIN verdicts v ON v.id = e.internal_id")
