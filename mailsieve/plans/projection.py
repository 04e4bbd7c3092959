"""Engine tables made from the test tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

#: name -> select; see FIXTURES.md part C. Times that queries compare with are literals.
CTES = {
    "emails": """SELECT event_id AS internal_id, ts AS fetched_at, user_id % 5 AS org_id, user_id AS campaign_id, event_type,
        CAST(floor(value) AS BIGINT) % 101 AS risk_score,
        CASE WHEN event_id % 11 = 0 THEN NULL WHEN CAST(floor(value) AS BIGINT) % 101 <= 25 THEN 'benign' WHEN CAST(floor(value) AS BIGINT) % 101 <= 50 THEN 'suspicious'
             WHEN CAST(floor(value) AS BIGINT) % 101 <= 75 THEN 'phishing' WHEN event_id % 3 = 0 THEN 'spam' ELSE 'malware' END AS label,
        event_id % 13 = 0 AS is_deleted FROM events""",
    "threats": """SELECT page_id AS id, url, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'phishing' ELSE 'malware' END AS threat_type,
        CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id % 4 END AS asn, page_id % 6 AS feed_id, page_id % 2 = 0 AS is_global, page_id % 3 + 1 AS org_id,
        CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id % 4 = 1 END AS online, (page_id * 37) % 101 AS risk_score, page_id % 17 = 0 AS is_deleted FROM pages""",
    "campaigns": "SELECT DISTINCT user_id AS id, user_id % 5 AS org_id, concat('campaign ', CAST(user_id AS VARCHAR(20))) AS name FROM events WHERE user_id % 9 <> 0",
    "feeds": "SELECT n_nationkey AS id, n_name AS name, n_nationkey % 3 AS reliability, n_nationkey % 4 <> 0 AS enabled FROM nation WHERE n_nationkey < 8",
    "rules": "SELECT p_partkey AS id, p_name AS name, p_brand AS version, CASE WHEN p_size % 3 = 0 THEN 'archived' ELSE 'active' END AS status, p_size AS score_impact FROM part",
    "rule_hits": "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS rule_id, l_shipdate AS fired_at, CAST(l_quantity AS BIGINT) AS score_impact FROM lineitem",
    "verdicts": "SELECT event_id AS id, user_id AS entity_id, event_type AS entity_type, ts AS created_at, CAST(floor(value) AS BIGINT) % 101 AS score FROM events",
    "scored": """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_quantity * 2 AS INT) END AS url_score,
        CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(round(l_discount * 1000) AS INT) END AS header_score,
        CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(round(l_tax * 1250) AS INT) END AS nlp_score,
        CASE WHEN l_suppkey % 4 <> 0 THEN NULL ELSE CAST(l_quantity * 2 AS INT) END AS attachment_score FROM lineitem""",
    "judged": "SELECT d.doc_id, d.source, d.lang, d.n_chars % 101 AS score, l.toxic = 1 AS positive, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
}


def with_ctes(sql: str) -> str:
    """The statement with the projections that it names in front, as a WITH clause."""
    used = [k for k in CTES if re.search(rf"\b{k}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{k} AS ({CTES[k]})" for k in used)
    start, rest = re.fullmatch(r"(?s)(WITH RECURSIVE |WITH |)(.*)", sql).groups()
    return f"{start or 'WITH '}{head}{', ' if start else ' '}{rest}"
