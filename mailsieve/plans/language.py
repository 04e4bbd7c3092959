"""The rule language op by op, service stages, and stream policies by their operator ids."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.distance import simhash_text
from ..operators import models
from ..operators import relational as r
from ..operators.rules import Signals, compiled
from ..operators.similarity import simhash_pairs
from ..registry import query
from ..session import shared_folder, ship, table
from ..sources.history import HistorySource
from ..sources.sinks import quarantined
from .relational import frame, on
from .scalars import H
from .streams import drained

SIGNALS = {"kind": "event_type", "risk": "risk_score", "label": "label", "gone": "is_deleted"}


def leaves(name: str, rows: list[tuple]) -> None:
    """A query with one column for each (column, rule, SQL)."""
    oracle = ", ".join(f"({s}) AS {c}" for c, _, s in rows)

    @on(name, f"SELECT internal_id, {oracle} FROM emails")
    def run(spark: SparkSession, d: str, rows=rows) -> DataFrame:
        e = frame(spark, d, "emails")
        signals = Signals(e, SIGNALS)
        return e.select("internal_id", *[compiled(json.dumps(x), signals)[0].alias(c) for c, x, _ in rows])


def leaf(signal: str, op: str, value=None) -> dict:
    return {"signal": signal, "op": op, "value": value}


leaves("R02_rule_ops", [
    ("eq", leaf("risk", "eq", 50), "risk_score = 50"), ("neq", leaf("risk", "neq", 50), "risk_score <> 50"), ("gt", leaf("risk", "gt", 50), "risk_score > 50"), ("gte", leaf("risk", "gte", 50), "risk_score >= 50"), ("lt", leaf("risk", "lt", 50), "risk_score < 50"), ("lte", leaf("risk", "lte", 50), "risk_score <= 50"),
    ("isin", leaf("kind", "in", ["click", "view"]), "event_type IN ('click', 'view')"), ("not_in", leaf("kind", "not_in", ["click"]), "event_type <> 'click'"), ("has", leaf("kind", "contains", "IG"), "contains(event_type, 'ig')"), ("there", leaf("label", "exists"), "label IS NOT NULL"), ("gone", leaf("label", "missing"), "label IS NULL"),
])
leaves("R03_missing_signals", [("neq", leaf("label", "neq", "spam"), "label IS NOT NULL AND label <> 'spam'"), ("not_in", leaf("label", "not_in", ["spam"]), "label IS NOT NULL AND label <> 'spam'"), ("unknown", leaf("no.such", "eq", 1), "FALSE"), ("unknown_missing", leaf("no.such", "missing"), "TRUE"), ("negated", {"not": leaf("label", "eq", "spam")}, "label IS NULL OR label <> 'spam'")])
leaves("R04_equality", [("folded", leaf("kind", "eq", "CLICK"), "event_type = 'click'"), ("strict_bool", leaf("gone", "eq", 1), "FALSE"), ("bool", leaf("gone", "eq", False), "NOT is_deleted"), ("text_number", leaf("risk", "eq", "50"), "FALSE"), ("number", leaf("risk", "eq", 50.0), "risk_score = 50")])
leaves("R05_not_comparable", [("gte", leaf("kind", "gte", 5), "TRUE"), ("lte", leaf("kind", "lte", 5), "TRUE"), ("gt", leaf("kind", "gt", 5), "FALSE"), ("lt", leaf("risk", "lt", "x"), "FALSE"), ("risk_gte", leaf("risk", "gte", "x"), "TRUE")])
leaves("R06_bool_numbers", [("one", leaf("gone", "gte", 1), "is_deleted"), ("zero", leaf("gone", "lt", 1), "NOT is_deleted"), ("true", leaf("risk", "gt", True), "risk_score > 1")])
leaves("R08_snapshot", [("nested", {"all": [{"any": [leaf("kind", "eq", "click"), leaf("risk", "gt", 90)]}, {"not": leaf("gone", "eq", True)}]}, "(event_type = 'click' OR risk_score > 90) AND NOT is_deleted")])


@query("S05_service_stage", "SELECT event_type AS kind, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type")
def s05(spark: SparkSession, d: str) -> DataFrame:
    """One topic in, one handler, one topic out."""
    return drained(spark, d, "service", lambda s: s.where("value > 50").select(F.col("event_type").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("S07_history_stream", "SELECT * FROM (VALUES (3, 'a'), (7, 'b'), (7, 'c')) t(history_id, message_id)")
def s07(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a mailbox's history read as a stream, small ones written here first."""
    ship(spark)
    folder = Path(shared_folder(spark, "history").removeprefix("file:").replace("//", "/", 1))
    folder.mkdir(parents=True)
    for n, ids in ((3, ["a"]), (7, ["b", "c"])):
        (folder / f"{n}.json").write_text(json.dumps({"historyId": n, "messages": [{"id": i, "raw": ""} for i in ids]}))
    spark.dataSource.register(HistorySource)
    return spark.read.format("mail_history").option("path", str(folder)).load().select(F.col("history_id"), "message_id")


@query("S16_alert_payloads", "SELECT event_id, event_type FROM events WHERE value > 100")
def s16(spark: SparkSession, d: str) -> DataFrame:
    body = table(spark, d, "events").where("value > 100").select(F.to_json(F.struct("event_id", "event_type")).alias("value"))
    return body.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.get_json_object("value", "$.event_type").alias("event_type"))


LATE = "SELECT event_id, user_id, ts, event_type, min(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id) AS closed FROM events"
on("X07_late_drop", f"SELECT user_id, count(*) FILTER (WHERE ts > closed) AS late, count(*) FILTER (WHERE closed IS NULL OR ts <= closed) AS in_time FROM ({LATE}) t GROUP BY user_id")(
    lambda spark, d: table(spark, d, "events").withColumn("closed", F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).over(Window.partitionBy("user_id"))).groupBy("user_id").agg(F.count_if(F.col("ts") > F.col("closed")).alias("late"), F.count_if(F.col("closed").isNull() | (F.col("ts") <= F.col("closed"))).alias("in_time"))
)
on("X08_first_wins_merge", "SELECT user_id, min(ts) AS fetched_at, arg_min(event_id, (ts, event_id)) AS internal_id FROM events GROUP BY user_id")(lambda spark, d: table(spark, d, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("x")).select("user_id", F.col("x.ts").alias("fetched_at"), F.col("x.event_id").alias("internal_id")))
on("X09_wait_for_id", "SELECT l_orderkey, l_linenumber, NOT (header_score IS NOT NULL AND nlp_score IS NULL) AS ready FROM scored")(lambda spark, d: frame(spark, d, "scored").select("l_orderkey", "l_linenumber", (~(F.col("header_score").isNotNull() & F.col("nlp_score").isNull())).alias("ready")))


@query("X11_quarantine", "SELECT 'bad' AS kind, count(*) AS n FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'good', count(*) FROM events WHERE event_id % 10 <> 0")
def x11(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "quarantine")
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "{").alias("poison"))
    quarantined(e, f"{folder}/good", f"{folder}/bad")
    count = lambda k: spark.read.parquet(f"{folder}/{k}").agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return count("bad").union(count("good"))


@query("X17_simhash_index")
def x17(spark: SparkSession, d: str) -> DataFrame:
    """Near copies among conversation turns by role, as an index of hashes with time-out would find them in one period."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", simhash_text(F.lower(F.trim("text"))).alias("h"))
    return simhash_pairs(c, "id", "role", "h")


def _by_host():
    return lambda x: 1 / (1 + np.exp(-(x[:, 0] - 20) / 5))


on("X19_score_each_once", f"SELECT page_id, round(1 / (1 + exp(-(length({H}) - 20) / 5e0)), 6) AS p FROM pages")(lambda spark, d: _once(spark, d))


def _once(spark: SparkSession, d: str) -> DataFrame:
    """Each host is scored once and the score joined to its pages: what a score cache does for a service."""
    from ..functions.urls import host

    pages = table(spark, d, "pages").select("page_id", host(F.col("url")).alias("h"))
    hosts = models.scored(pages.select("h").distinct().withColumn("n", F.length("h")), ["n"], _by_host)
    return pages.join(hosts, "h").select("page_id", F.round("probability", 6).alias("p"))


@query("X21_periodic_sync", "SELECT count(*) AS n FROM events")
def x21(spark: SparkSession, d: str) -> DataFrame:
    """A run that takes what is there and ends; a scheduler starts the next."""
    return drained(spark, d, "sync", lambda s: s.select("event_id")).agg(F.count("*").alias("n"))


def _model(name: str, features: str, weights: list[float]) -> None:
    cols = features.split()
    z = " + ".join(f"{w} * {c}" for w, c in zip(weights, cols, strict=True))

    def load():
        return lambda x: 1 / (1 + np.exp(-(x @ np.array(weights))))

    query(name, f"SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-({z}))), 6) AS p FROM lineitem")(lambda spark, d: models.scored(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols), cols, load).select("l_orderkey", "l_linenumber", F.round("probability", 6).alias("p")))


_model("M02_structural_scorer", "l_quantity l_discount", [0.02, -1.0])
_model("M03_operational_scorer", "l_tax l_discount l_quantity", [3.0, 1.5, -0.01])


@query("M04_text_classifier", "SELECT doc_id, round(1 / (1 + exp(-(length(text) - 1500) / 1000e0)), 6) AS p FROM documents")
def m04(spark: SparkSession, d: str) -> DataFrame:
    """The text model's place: any predict function by batches, loaded once in each worker."""
    from pyspark.ml.functions import predict_batch_udf

    ship(spark)

    def make():
        import numpy as np

        return lambda n: 1 / (1 + np.exp(-(n.astype("float64") - 1500) / 1000))

    p = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=1024)
    return table(spark, d, "documents").select("doc_id", F.round(p(F.length("text").cast("double")), 6).alias("p"))
