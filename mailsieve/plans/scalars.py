"""Scalar functions on the test tables by their operator ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attachments as at
from ..functions import distance, mail, text, urls
from ..operators.domains import apex_by_suffix, suffix_rules
from ..registry import query
from ..session import table

#: DuckDB's forms of what several queries take apart.
HOST = r"lower(regexp_replace(regexp_replace(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 2), '^.*@', ''), ':\d*$', ''))"
H = HOST.format(u="url")
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
FRAG = r"regexp_extract(url, '#(.*)$', 1)"
REG = "array_to_string(list_slice(string_split({h}, '.'), -2, -1), '.')"
WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
MESSY = r"CASE page_id % 5 WHEN 0 THEN '  ' || upper(substr(url, 1, 9)) || substr(url, 10) WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN url || ' ' WHEN 3 THEN '' ELSE url END"


def messy() -> Column:
    u = F.col("url")
    k = F.col("page_id") % 5
    return F.when(k == 0, F.concat(F.lit("  "), F.upper(F.substring(u, 1, 9)), u.substr(F.lit(10), F.length(u)))).when(k == 1, F.regexp_replace(u, "^[a-z]+://", "")).when(k == 2, F.concat(u, F.lit(" "))).when(k == 3, "").otherwise(u)


def pages(name: str, oracle: str, **cols) -> None:
    """A query of page_id and columns over pages; oracle is the list of the same columns in SQL."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "pages").select("page_id", *[(f() if callable(f) else f).alias(k) for k, f in cols.items()])

    query(name, f"SELECT page_id, {oracle} FROM pages")(run)


def over(name: str, source: str, key: str, oracle: str, make) -> None:
    """A query of a key and columns over any table."""
    query(name, f"SELECT {key}, {oracle} FROM {source}")(lambda spark, d: table(spark, d, source).select(key, *make()))


def literals(name: str, schema: str, rows: list[tuple], oracle: str | None, make) -> None:
    """A query over literal rows, where the test tables have nothing to show."""
    query(name, oracle)(lambda spark, d: make(spark.createDataFrame(rows, schema)))


def values(rows: list[tuple]) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)


U = "url"
NORM = r"CASE WHEN trim({m}) = '' THEN NULL ELSE (SELECT lower(regexp_extract(f, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(f, '://([^/?#]*)', 1)) || CASE WHEN p = '/' THEN '' ELSE p END || q FROM (SELECT f, regexp_extract(f, '://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(f, '://[^?#]*([?#].*)$', 1) AS q FROM (SELECT CASE WHEN regexp_matches(trim({m}), '^[A-Za-z][A-Za-z0-9+.-]*://') THEN trim({m}) ELSE 'http://' || trim({m}) END AS f))) END".format(m="(" + MESSY + ")")
pages("F01_normalize_url", f"{NORM} AS normal", normal=lambda: urls.normalize_url(messy()))
pages("F02_extract_domain", f"{H} AS host", host=lambda: urls.extract_domain(F.col(U)))
pages("F03_normalize_domain", f"{H} AS domain", domain=lambda: urls.normalize_domain(F.concat(F.lit("*.*."), F.upper(urls.host(F.col(U))), F.lit(".."))))
pages("F04_is_url", f"page_id % 5 NOT IN (1, 3) AS ok", ok=lambda: urls.is_url(messy()))
pages("F05_tld_label", f"string_split({H}, '.')[-1] AS tld", tld=lambda: urls.tld_label(urls.host(F.col(U))))
pages("F06_apex", f"{REG.format(h=H)} AS apex", apex=lambda: urls.registrable_domain(urls.host(F.col(U))))
@query("F06b_apex_by_suffix", f"SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)example\\.com$') THEN array_to_string(list_slice(string_split(h, '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') END AS apex FROM (SELECT page_id, {H} AS h FROM pages) t")
def f06b(spark: SparkSession, d: str) -> DataFrame:
    """As with a list that names example.com as a suffix of its own; domains.read_rules reads a whole one."""
    rules = suffix_rules(spark.createDataFrame([("com",), ("example.com",)], "value string"))
    hosts = table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("h"))
    return apex_by_suffix(hosts, "h", rules).select("page_id", "apex")


pages("F07_split_tld", f"string_split({H}, '.')[-2] AS domain, array_to_string(list_slice(string_split({H}, '.'), 1, -3), '.') AS subdomain, string_split({H}, '.')[-1] AS tld", domain=lambda: urls.split_tld(urls.host(F.col(U)))["domain"], subdomain=lambda: urls.split_tld(urls.host(F.col(U)))["subdomain"], tld=lambda: urls.split_tld(urls.host(F.col(U)))["tld"])
pages("F08_registrable_label", f"string_split({H}, '.')[-2] AS label", label=lambda: urls.registrable_label(urls.host(F.col(U))))
BR = urls.BRAND_SUBSTRINGS
pages("F10_subdomain_brand", f"CASE WHEN page_id % 3 = 0 THEN '{BR[0]}' WHEN page_id % 3 = 1 THEN '{BR[3]}' END AS brand", brand=lambda: urls.subdomain_brand(F.concat(F.when(F.col("page_id") % 3 == 0, "secure-paypal-amazon.x.").when(F.col("page_id") % 3 == 1, "www.amazonx.").otherwise(""), urls.host(F.col(U)))))
ENT = "COALESCE((SELECT -sum(n / CAST(length({s}) AS DOUBLE) * log2(n / CAST(length({s}) AS DOUBLE))) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split({s}, '')) AS c) GROUP BY c)), 0e0)"
FEATURES = f"""length(url) AS url_length, length(url) - length(replace(url, '.', '')) AS num_dots, greatest(len(string_split({H}, '.')) - 2, 0) AS num_subdomains, length(url) - length(replace(url, '-', '')) AS num_hyphens_url, length({H}) - length(replace({H}, '-', '')) AS num_hyphens_hostname,
 CAST(url LIKE 'https://%' AS INT) AS https_flag, length(regexp_replace(url, '[^0-9]', '', 'g')) AS num_numeric_chars, {' + '.join(f"(length(url) - length(replace(lower(url), '{w}', ''))) // {len(w)}" for w in urls.SENSITIVE_WORDS)} AS num_sensitive_words,
 length({H}) AS hostname_length, length({PATH}) AS path_length, CASE WHEN {QUERY} = '' THEN 0 ELSE len(string_split({QUERY}, '&')) END AS num_query_params, length(regexp_replace(url, '[^!@#$%^&*~`|\\\\<>{{}}]', '', 'g')) AS num_special_chars, CAST(contains(url, '@') AS INT) AS at_symbol_present,
 round(length(regexp_replace(url, '[^0-9]', '', 'g')) / CAST(length(url) AS DOUBLE), 6) AS pct_numeric_chars, greatest(length({PATH}) - length(replace({PATH}, '/', '')) - 1, 0) AS path_depth, length(url) - length(replace(url, '_', '')) AS num_underscores, length({QUERY}) AS query_length, CAST({FRAG} <> '' AS INT) AS has_fragment,
 len(list_filter(regexp_split_to_array(url, '[/?&=_.:@#+~%-]'), lambda x: x <> '')) AS token_count, length(string_split({H}, '.')[-1]) AS tld_length"""
SAME = ["url_length", "num_dots", "num_subdomains", "num_hyphens_url", "num_hyphens_hostname", "https_flag", "num_numeric_chars", "num_sensitive_words", "hostname_length", "path_length", "num_query_params", "num_special_chars", "at_symbol_present", "pct_numeric_chars", "path_depth", "num_underscores", "query_length", "has_fragment", "token_count", "tld_length"]
query("F11_url_features", f"SELECT page_id, {FEATURES} FROM pages")(lambda spark, d: table(spark, d, "pages").select("page_id", *urls.url_features(F.col(U))).select("page_id", *SAME))
query("F12_url_features_all")(lambda spark, d: table(spark, d, "pages").select("page_id", *urls.url_features(F.col(U)), urls.is_shortener(urls.host(F.col(U))).alias("is_shortener"), F.least(*[F.levenshtein(urls.registrable_label(urls.host(F.col(U))), F.lit(b)) for b in BR]).alias("min_brand_distance")))
query("F13_entropy", "SELECT page_id, round(-sum(n / CAST(t AS DOUBLE) * log2(n / CAST(t AS DOUBLE))), 6) AS entropy FROM (SELECT page_id, c, count(*) AS n, max(t) AS t FROM (SELECT page_id, length(url) AS t, unnest(string_split(url, '')) AS c FROM pages) GROUP BY page_id, c) GROUP BY page_id")(lambda spark, d: table(spark, d, "pages").select("page_id", F.round(urls.entropy(F.col(U)), 6).alias("entropy")))
query("F14_byte_entropy", "SELECT page_id, round(-sum(n / CAST(t AS DOUBLE) * log2(n / CAST(t AS DOUBLE))), 6) AS entropy FROM (SELECT page_id, c, count(*) AS n, max(t) AS t FROM (SELECT page_id, length(url) AS t, unnest(string_split(url, '')) AS c FROM pages) GROUP BY page_id, c) GROUP BY page_id")(lambda spark, d: table(spark, d, "pages").select("page_id", F.round(at.byte_entropy(F.encode(U, "UTF-8")), 6).alias("entropy")))
PROB = "map {" + ", ".join(f"'{k}': {v}" for k, v in urls.CHAR_PROBABILITY.items()) + "}"
query("F15_url_char_prob", f"SELECT page_id, round(avg(COALESCE(m[c], 0)), 8) AS p FROM (SELECT page_id, unnest(string_split(lower(url), '')) AS c, CAST({PROB} AS MAP(VARCHAR, DOUBLE)) AS m FROM pages) WHERE regexp_matches(c, '[a-z0-9]') GROUP BY page_id")(lambda spark, d: table(spark, d, "pages").select("page_id", F.round(urls.char_probability(F.col(U)), 8).alias("p")))
RUN = "COALESCE(list_max(list_transform(regexp_extract_all(url, '{c}+'), lambda x: length(x))), 0)"
pages("F16_continuation_rate", f"round(({RUN.format(c='[A-Za-z]')} + {RUN.format(c='[0-9]')} + {RUN.format(c='[^A-Za-z0-9]')}) / CAST(length(url) AS DOUBLE), 6) AS rate", rate=lambda: F.round((urls.longest_run(F.col(U), r"\p{L}") + urls.longest_run(F.col(U), r"\p{Nd}") + urls.longest_run(F.col(U), r"^\p{L}\p{Nd}")) / F.length(U), 6))
pages("F17_repeated_digits", "regexp_matches(url, '000|111|222|333|444|555|666|777|888|999') AS rep", rep=lambda: F.col(U).rlike(r"(\d)\1{2}"))
pages("F18_counts", "length(url) - length(replace(url, '.', '')) AS dots, length(url) - length(replace(url, '/', '')) AS slashes, length(regexp_replace(url, '[^0-9]', '', 'g')) AS digits", dots=lambda: urls.count_of(F.col(U), "."), slashes=lambda: urls.count_of(F.col(U), "/"), digits=lambda: urls.count_class(F.col(U), "0-9"))
pages("F19_sensitive_words", "(length(url) - length(replace(lower(url), 'login', ''))) // 5 + (length(url) - length(replace(lower(url), 'account', ''))) // 7 AS n", n=lambda: urls.count_of(F.lower(U), "login") + urls.count_of(F.lower(U), "account"))
pages("F20_suspicious_extension", f"regexp_matches(lower({PATH}), '\\.({'|'.join(urls.SUSPICIOUS_EXTENSIONS)})$') AS bad", bad=lambda: F.lower(urls.path(F.col(U))).rlike(r"\.(" + "|".join(urls.SUSPICIOUS_EXTENSIONS) + ")$"))


@query("F21_tld_legit_prob", f"WITH t AS (SELECT string_split({H}, '.')[-1] AS tld, page_id FROM pages) SELECT page_id, tld, round(n / CAST(sum(n) OVER () AS DOUBLE) * count(*) OVER () / count(*) OVER (), 8) AS p FROM t JOIN (SELECT tld, count(*) AS n FROM t GROUP BY tld) USING (tld)".replace("round(n / CAST(sum(n) OVER () AS DOUBLE) * count(*) OVER () / count(*) OVER (), 8)", "round(n / CAST((SELECT count(*) FROM t) AS DOUBLE), 8)"))
def f21(spark, d):
    """Share of a TLD among the reference hosts, looked up for each host; the table comes from the data, as a parameter."""
    t = table(spark, d, "pages").select("page_id", urls.tld_label(urls.host(F.col(U))).alias("tld"))
    shares = t.groupBy("tld").agg(F.count("*").alias("n")).crossJoin(t.agg(F.count("*").alias("all")))
    return t.join(shares, "tld").select("page_id", "tld", F.round(F.col("n") / F.col("all"), 8).alias("p"))


pages("F22_canonicalize", "regexp_replace(lower(trim(url)), '^http://', 'https://') AS c", c=lambda: urls.canonicalize_url(F.col(U)))
pages("F23_operational", f"CAST(regexp_matches(lower(url), 'login|signin|verify|account') AS INT) AS login_kw, greatest(len(string_split({H}, '.')) - 2, 0) AS subdomain_depth, CAST(regexp_matches(url, '^[a-z]+://[^/?#]*:(\\d+)') AS INT) AS odd_port, round(length(regexp_replace({H}, '[a-z]', '', 'g')) / CAST(length({H}) AS DOUBLE), 6) AS non_alpha",
      login_kw=lambda: F.lower(U).rlike("login|signin|verify|account").cast("int"), subdomain_depth=lambda: F.greatest(F.size(F.split(urls.host(F.col(U)), r"\.")) - 2, F.lit(0)), odd_port=lambda: (~urls.port(F.col(U)).isin("", "80", "443")).cast("int"), non_alpha=lambda: F.round(F.length(F.regexp_replace(urls.host(F.col(U)), "[a-z]", "")) / F.length(urls.host(F.col(U))), 6))
pages("F24_path_depth", f"length({PATH}) - length(replace({PATH}, '/', '')) AS depth", depth=lambda: urls.count_of(urls.path(F.col(U)), "/"))
pages("F25_shortener", "page_id % 2 = 0 AS short", short=lambda: urls.is_shortener(F.when(F.col("page_id") % 2 == 0, "x.bit.ly").otherwise(urls.host(F.col(U)))))
pages("F26_route_to_enrichment", f"(page_id % 100) / 100e0 BETWEEN 0.3 AND 0.7 OR {H} LIKE '%-%' AS route", route=lambda: ((F.col("page_id") % 100) / 100.0).between(0.3, 0.7) | (urls.count_of(urls.host(F.col(U)), "-") > 0))
IPS = [(1, "8.8.8.8", True), (2, "10.1.2.3", False), (3, "172.20.0.1", False), (4, "172.32.0.1", True), (5, "192.168.1.1", False), (6, "127.0.0.1", False), (7, "169.254.9.9", False), (8, "100.64.0.1", False), (9, "224.0.0.1", False), (10, "x", False), (11, "256.1.1.1", False)]
literals("F27_public_ip", "id int, ip string", [x[:2] for x in IPS], f"SELECT id, ok FROM (VALUES {', '.join(f'({i}, {ok})' for i, _, ok in IPS)}) t(id, ok)", lambda df: df.select("id", urls.is_public_ip(F.col("ip")).alias("ok")))
# distances and hashes
query("F30_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a CROSS JOIN nation b WHERE a.n_nationkey < b.n_nationkey")(lambda spark, d: _nations(spark, d).select("a", "b", F.levenshtein("a", "b").alias("d")))


def _nations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")).join(n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b")), F.col("i") < F.col("j"))


OSA = [(1, "paypal.com", "paypla.com", 1), (2, "CA", "ABC", 3), (3, "abcdef", "abcdef", 0), (4, "kitten", "sitting", 3), (5, "abc", "xyzuvw", 4), (6, "google.com", "gogole.com", 1)]
literals("F31_damerau_levenshtein", "id int, a string, b string", [x[:3] for x in OSA], f"SELECT * FROM (VALUES {values([(x[0], x[3]) for x in OSA])}) t(id, d)", lambda df: df.select("id", distance.damerau_levenshtein(F.col("a"), F.col("b"), 3).alias("d")))
CAND = [(1, "secure-paypa1.com"), (2, "a.b.example.com"), (3, "localhost"), (4, "my-bank-login.evil.co")]
literals("F32_candidate_labels", "id int, d string", CAND, "SELECT * FROM (VALUES (1, ['secure-paypa1.com', 'secure.com', 'paypa1.com']), (2, ['a.b.example.com', 'b.example.com', 'example.com']), (3, ['localhost']), (4, ['my-bank-login.evil.co', 'evil.co', 'bank.co', 'login.co'])) t(id, c)", lambda df: df.select("id", mail.candidate_labels(F.col("d")).alias("c")))
over("F33_digests", "documents", "doc_id", "sha256(text) AS sha, md5(text) AS md5", lambda: [F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5")])
SUBJ = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '^(\s*(re:|fwd:|fw:|\[external\]|\[ext\]|\[spam\])\s*)+', ''), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '{email}', 'g'), '[0-9]{3,}', '{n}', 'g'))"
over("F34_fingerprint", "documents", "doc_id", f"sha256(lower(source) || '|' || lang || '|' || sha256({SUBJ}) || '|' || 'bec') AS fp", lambda: [mail.fingerprint(F.col("source"), F.col("lang"), F.substring_index("text", "\n", 1), F.lit("BEC")).alias("fp")])
over("F35_normalise_subject", "documents", "doc_id", f"{SUBJ} AS s", lambda: [mail.normalise_subject(F.substring_index("text", "\n", 1)).alias("s")])
query("F36_simhash")(lambda spark, d: table(spark, d, "documents").select("doc_id", distance.simhash_text("text").alias("h")))
over("F37_hamming", "orders", "o_orderkey", "bit_count(xor(o_orderkey, o_custkey)) AS d", lambda: [distance.hamming(F.col("o_orderkey"), F.col("o_custkey")).alias("d")])
over("F38_hex_hash", "documents", "doc_id", "doc_id % 3 = 0 AS ok", lambda: [at.is_hex_hash(F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.upper(F.sha2("text", 256))).otherwise("ab12")).alias("ok")])
over("F39_object_key", "documents", "doc_id", "'attachments/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS k", lambda: [at.object_key(F.sha2("text", 256)).alias("k")])
query("F3A_hash_bucket")(lambda spark, d: table(spark, d, "documents").select("doc_id", F.pmod(F.xxhash64("source"), F.lit(4096)).alias("bucket")))
# mail
AUTH = [(1, "mx.a; spf=pass (x) smtp.mail=a; dkim=Fail header.d=b; dmarc=none", "pass", "fail", "none"), (2, "x; dkim=neutral", "", "neutral", ""), (3, "notspf=pass", "", "", ""), (4, "spf=softfail;spf=pass", "softfail", "", "")]
literals("F40_auth_results", "id int, h string", [x[:2] for x in AUTH], f"SELECT * FROM (VALUES {values([(x[0], *x[2:]) for x in AUTH])}) t(id, spf, dkim, dmarc)", lambda df: df.select("id", *[mail.auth_result(F.col("h"), m).alias(m) for m in ("spf", "dkim", "dmarc")]))
ADDR = [(1, "Bob <bob@Mail.Example.COM>", "bob@mail.example.com", "mail.example.com"), (2, "a@b.org", "a@b.org", "b.org"), (3, "example.com", "example.com", "example.com"), (4, "", "", ""), (5, '"x@y" <z@w.net>', "z@w.net", "w.net")]
literals("F41_address_only", "id int, a string", [x[:2] for x in ADDR], f"SELECT * FROM (VALUES {values([(x[0], x[2]) for x in ADDR])}) t(id, addr)", lambda df: df.select("id", mail.address_only(F.col("a")).alias("addr")))
literals("F42_domain_of", "id int, a string", [x[:2] for x in ADDR], f"SELECT * FROM (VALUES {values([(x[0], x[3]) for x in ADDR])}) t(id, dom)", lambda df: df.select("id", mail.domain_of(F.col("a")).alias("dom")))
SAMED = [(1, "a.com", "a.com", True), (2, "x.a.com", "a.com", True), (3, "com", "a.com", False), (4, "", "", False), (5, "ba.com", "a.com", False), (6, "A.com", "y.a.COM", True)]
literals("F43_same_domain", "id int, a string, b string", [x[:3] for x in SAMED], f"SELECT * FROM (VALUES {', '.join(f'({x[0]}, {x[3]})' for x in SAMED)}) t(id, same)", lambda df: df.select("id", mail.same_registrable_domain(F.col("a"), F.col("b")).alias("same")))
NAUTH = [(1, "PASS", "pass"), (2, " permerror ", "fail"), (3, "soft-fail", "softfail"), (4, "weird", "none"), (5, "", ""), (6, "policy", "none")]
literals("F44_normalize_auth", "id int, v string", [x[:2] for x in NAUTH], f"SELECT * FROM (VALUES {values([(x[0], x[2]) for x in NAUTH])}) t(id, r)", lambda df: df.select("id", mail.normalize_auth(F.col("v")).alias("r")))
over("F45_message_id", "events", "event_id", "event_type || '.' || event_id AS mid", lambda: [mail.message_id(F.concat(F.lit(" <"), F.col("event_type"), F.lit("."), F.col("event_id"), F.lit("> "))).alias("mid")])
query("F46_hop_count", "SELECT l_orderkey, count(*) AS hops FROM lineitem GROUP BY l_orderkey")(lambda spark, d: table(spark, d, "lineitem").groupBy("l_orderkey").agg(mail.hop_count(F.collect_list("l_linenumber")).cast("long").alias("hops")))
literals("F47_originating_ip", "id int, r array<string>", [(1, ["10.0.0.1", "8.8.8.8", "9.9.9.9"]), (2, ["10.0.0.1"]), (3, ["1.1.1.1", "192.168.0.1"])], "SELECT * FROM (VALUES (1, '9.9.9.9'), (2, NULL), (3, '1.1.1.1')) t(id, ip)", lambda df: df.select("id", F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("string")), F.col("r")), lambda x: x.isNull() | urls.is_public_ip(x)), -1).alias("ip")))
HOPS = [(1, "from a.com by b.com (x); Mon, 1 Jan 2024 10:00:00 +0000", "a.com", "b.com"), (2, "by c.com; x", "", "c.com")]
literals("F48_received_chain", "id int, h string", [x[:2] for x in HOPS], f"SELECT * FROM (VALUES {values([(x[0], *x[2:]) for x in HOPS])}) t(id, sender, receiver)", lambda df: df.select("id", F.regexp_extract("h", r"(?i)\bfrom\s+(\S+)", 1).alias("sender"), F.regexp_extract("h", r"(?i)\bby\s+(\S+?)[;\s]", 1).alias("receiver")))
query("F49_time_drift", "SELECT user_id, round((max(epoch(ts)) - min(epoch(ts))) / 3600, 4) AS drift FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id")(lambda spark, d: table(spark, d, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp"))).groupBy("user_id").agg(F.round(mail.time_drift_hours(F.collect_list("t"), F.min("t")), 4).alias("drift")))
over("F50_vendor_tags", "events", "event_id", "json_keys(props) AS tags", lambda: [F.json_object_keys("props").alias("tags")])
literals("F51_suspicious_mailer", "id int, m string", [(1, "PHPMailer 6.1"), (2, "Outlook"), (3, None)], "SELECT * FROM (VALUES (1, TRUE), (2, FALSE), (3, FALSE)) t(id, bad)", lambda df: df.select("id", mail.suspicious_mailer(F.col("m")).alias("bad")))
over("F52_non_ascii", "documents", "doc_id", "strlen(text) > length(text) AS odd", lambda: [mail.contains_non_ascii(F.col("text")).alias("odd")])
literals("F53_free_provider", "id int, d string", [(1, "gmail.com"), (2, "a.b.gmail.com"), (3, "mygmail.com"), (4, "YAHOO.co.uk."), (5, "")], "SELECT * FROM (VALUES (1, TRUE), (2, TRUE), (3, FALSE), (4, TRUE), (5, FALSE)) t(id, free)", lambda df: df.select("id", mail.is_free_provider(F.col("d")).alias("free")))
BODY = [(1, "<p style='display: none'>x</p>", True, False), (2, "<form action='/x'>", False, True), (3, "font-size:0.5em", False, False), (4, "<div hidden>", True, False), (5, "color:#fff; background:#ffffff", True, False), (6, "plain", False, False)]
literals("F54_body_signals", "id int, b string", [x[:2] for x in BODY], f"SELECT * FROM (VALUES {', '.join(f'({x[0]}, {x[2]}, {x[3]})' for x in BODY)}) t(id, hidden, form)", lambda df: df.select("id", mail.has_hidden_text(F.col("b")).alias("hidden"), mail.has_form(F.col("b")).alias("form")))
AGE = [(1, "2024-01-01", 30), (2, "2024-01-30T12:00:00Z", 0), (3, "2025-01-01", None), (4, "01-Jan-2024", 30), (5, "nonsense", None), (6, "2023/12/31", 31)]
literals("F55_domain_age", "id int, c string", [x[:2] for x in AGE], f"SELECT * FROM (VALUES {values([(x[0], x[2]) for x in AGE])}) t(id, days)", lambda df: df.select("id", mail.domain_age_days(F.col("c"), F.lit("2024-01-31 00:00:00")).alias("days")))
query("F56_html_to_text")(lambda spark, d: table(spark, d, "pages").select("page_id", mail.html_to_text(F.col("html")).alias("t")))
over("F57_word_count", "documents", "doc_id", f"trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, len({WORDS}) AS n", lambda: [mail.collapse_whitespace(F.col("text")).alias("t"), mail.word_count(F.col("text")).alias("n")])
over("F58_urls_in_html", "pages", "page_id", "list_distinct(regexp_extract_all(html, '(?i)(?:href|src|action)\\s*=\\s*[\"'']([^\"'']+)', 1)).list_sort() AS u", lambda: [F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("(?i)(?:href|src|action)\\s*=\\s*[\"']([^\"']+)"), 1))).alias("u")])
literals("F59_urls_in_text", "id int, t string", [(1, "see http://a.com/x, and (https://b.org/y)."), (2, "none")], "SELECT * FROM (VALUES (1, ['http://a.com/x', 'https://b.org/y']), (2, CAST([] AS VARCHAR[]))) t(id, u)", lambda df: df.select("id", mail.urls_in_text(F.col("t")).alias("u")))
MAG = [(1, "4D5A9000", "application/x-msdownload"), (2, "255044462D", "application/pdf"), (3, "00", "application/octet-stream"), (4, "", ""), (5, "504B0304AA", "application/zip")]
literals("F60_magic_type", "id int, h string", [x[:2] for x in MAG], f"SELECT * FROM (VALUES {values([(x[0], x[2]) for x in MAG])}) t(id, kind)", lambda df: df.select("id", at.magic_type(F.unhex("h")).alias("kind")))
ATT = [(1, "invoice.pdf.exe", "application/pdf", 7.9, 80), (2, "a.docm", "application/x", 1.0, 20), (3, "x.png", "image/jpeg", 2.0, 30), (4, "archive.tar.gz", "application/gzip", 7.99, 20), (5, "n.txt", "text/plain", 1.0, 0)]


def _attachment(df: DataFrame) -> DataFrame:
    from ..functions.scores import attachment_score

    n = F.col("n")
    return df.select("id", attachment_score(F.lit(False), F.col("e"), at.mime_mismatch(n, F.col("m"), F.lit(None).cast("string")), at.is_dangerous(n), at.is_macro(n), at.is_double_extension(n)).alias("score"))


literals("F61_attachment_score", "id int, n string, m string, e double", [x[:4] for x in ATT], f"SELECT * FROM (VALUES {values([(x[0], x[4]) for x in ATT])}) t(id, score)", _attachment)
literals("F62_extensions", "id int, n string", [(1, "a.PDF. "), (2, "b.tar.gz"), (3, "none"), (4, "x.js")], "SELECT * FROM (VALUES (1, 'pdf', FALSE), (2, 'gz', FALSE), (3, '', FALSE), (4, 'js', TRUE)) t(id, ext, bad)", lambda df: df.select("id", at.ext_of(F.col("n")).alias("ext"), at.is_dangerous(F.col("n")).alias("bad")))
over("F63_threat_tags", "part", "p_partkey", "list_filter([CASE WHEN p_size > 40 THEN 'malicious_hash' END, CASE WHEN p_size % 2 = 0 THEN 'high_entropy' END, CASE WHEN p_size % 3 = 0 THEN 'macro_office' END], lambda x: x IS NOT NULL) AS tags", lambda: [at.threat_tags(F.col("p_size") % 2 == 0, F.lit(False), F.lit(False), F.col("p_size") % 3 == 0, F.lit(False), F.col("p_size") > 40).alias("tags")])
over("F64_scrub", "documents", "doc_id", "text AS t", lambda: [mail.scrub(F.concat(F.col("text"), F.lit("\x00"))).alias("t")])
# text
STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(?:https?://|ftp://)\\S+', ' ', 'g'), '(?i)\\bwww\\.\\S+', ' ', 'g'), '(?i)\\bhttps?\\b(?:\\s+\\w+){1,8}?\\s+(?:com|net|org|info|co|io|ru|cn)\\b', ' ', 'g'), '\\S+@\\S+\\.\\S+', ' ', 'g'), '\\s+', ' ', 'g'))"
over("F70_strip_urls", "documents", "doc_id", f"{STRIP} AS t", lambda: [text.strip_urls(F.col("text")).alias("t")])
over("F71_strip_html", "pages", "page_id", "regexp_replace(html, '<[^>]+>', ' ', 'g') AS t", lambda: [text.strip_tags(F.col("html")).alias("t")])
literals("F72_confusables", "id int, t string", [(1, "pаypаl"), (2, "ΑΒ")], "SELECT * FROM (VALUES (1, 'paypal'), (2, 'AB')) t(id, r)", lambda df: df.select("id", text.map_confusables(F.col("t")).alias("r")))
literals("F73_fold_leet", "id int, t string", [(1, "Y0ur p@ssw0rd"), (2, "Office365"), (3, "pa$$word")], "SELECT * FROM (VALUES (1, 'Your password'), (2, 'Office365'), (3, 'pa$$word')) t(id, r)", lambda df: df.select("id", text.fold_leet(F.col("t")).alias("r")))
literals("F74_join_spaced", "id int, t string", [(1, "v e r i f y now"), (2, "U S A")], "SELECT * FROM (VALUES (1, 'verify now'), (2, 'U S A')) t(id, r)", lambda df: df.select("id", text.join_spaced(F.col("t")).alias("r")))
literals("F75_normalize", "id int, t string", [(1, "ｖｅｒｉｆｙ  pаyp​al"), (2, " a\nb ")], "SELECT * FROM (VALUES (1, 'verify paypal'), (2, 'a b')) t(id, r)", lambda df: df.select("id", text.normalize(F.col("t")).alias("r")))
literals("F76_obfuscated", "id int, t string", [(1, "pаypal"), (2, "plain  text")], "SELECT * FROM (VALUES (1, TRUE), (2, FALSE)) t(id, r)", lambda df: df.select("id", text.is_obfuscated(F.col("t")).alias("r")))
query("F77_preprocess")(lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", text.normalize(text.strip_urls(text.strip_tags(F.col("text")))).alias("t")))
MSG = [(1, "URGENT: verify your account within 24 hours or your account will be suspended"), (2, "Please find the invoice attached. Dear customer, click here"), (3, "lunch tomorrow?"), (4, "You have won a prize! Claim now. Congratulations")]
literals("F78_intents", "id int, t string", MSG, "SELECT * FROM (VALUES (1, ['credential_harvest', 'account_verification', 'urgency_threat']), (2, ['payment_fraud', 'malware_delivery']), (3, ['credential_harvest']), (4, ['prize_scam'])) t(id, labels)", lambda df: df.select("id", text.intents(F.col("t"), F.lit("phishing")).alias("labels")))
literals("F79_five_intent", "id int, t string", MSG, "SELECT * FROM (VALUES (1, 'credential_harvesting', 0.6667e0), (2, 'malware_delivery', 0.5e0), (3, 'credential_harvesting', 1e0), (4, 'scam', 1e0)) t(id, intent, confidence)", lambda df: df.select("id", text.five_intent(text.intents(F.col("t"), F.lit("phishing")), F.lit("phishing")).alias("x")).select("id", "x.intent", F.round("x.confidence", 4).alias("confidence")))
literals("F80_urgency", "id int, t string", MSG, "SELECT * FROM (VALUES (1, 0.8e0), (2, 0e0), (3, 0e0), (4, 0e0)) t(id, u)", lambda df: df.select("id", text.urgency(F.col("t")).alias("u")))
literals("F81_deception", "id int, t string", MSG, "SELECT * FROM (VALUES (1, 1e0), (2, 0.4375e0), (3, 0e0), (4, 0.25e0)) t(id, u)", lambda df: df.select("id", text.deception(F.col("t")).alias("u")))
over("F83_head_tail", "documents", "doc_id", f"list_filter(CASE WHEN len({WORDS}) <= 254 THEN {WORDS} ELSE list_concat({WORDS}[1:64], {WORDS}[-190:]) END, lambda x: TRUE) AS w", lambda: [text.head_tail(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w")])
over("F84_softmax", "lineitem", "l_orderkey, l_linenumber".split(", ")[0], "l_linenumber, round(exp(l_discount / 1.5) / (exp(l_discount / 1.5) + exp(l_tax / 1.5)), 6) AS p", lambda: ["l_linenumber", F.round(text.softmax([F.col("l_discount"), F.col("l_tax")], 1.5)[0], 6).alias("p")])
over("F85_canonical_body", "documents", "doc_id", "lower(trim(source || ' ' || text)) AS t", lambda: [F.lower(F.trim(F.concat("source", F.lit(" "), "text"))).alias("t")])
