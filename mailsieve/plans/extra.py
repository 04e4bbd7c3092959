"""Sources and sinks, model surfaces, campaign state and console reads by their operator ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import attachments, scores, text
from ..operators import calibration, models
from ..operators import relational as r
from ..registry import query
from ..session import shared_folder, table, views
from ..sources import kafka, sinks
from .projection import with_ctes
from .relational import GROWN, STATE, frame, on, sql
from .scoring import CH

J = "judged"


@on("S04_envelope_encode", "SELECT CAST(event_id AS VARCHAR) AS key, event_type AS kind FROM events")
def s04(spark: SparkSession, d: str) -> DataFrame:
    out = kafka.encoded(table(spark, d, "events").select("event_id", "event_type", "value"), "event_id")
    return out.select("key", F.get_json_object("value", "$.event_type").alias("kind"))


@on("S06_upload_json", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def s06(spark: SparkSession, d: str) -> DataFrame:
    """Uploads as JSON lines, written and read by schema."""
    folder = shared_folder(spark, "uploads")
    table(spark, d, "conversations").write.json(folder)
    return spark.read.schema("conv_id long, turn long, role string, text string").json(folder).groupBy("conv_id").agg(F.count("*").alias("n"))


on("S15_object_keys", "SELECT page_id, 'attachments/' || substr(sha256(html), 1, 2) || '/' || substr(sha256(html), 3, 2) || '/' || sha256(html) AS object_key FROM pages")(lambda spark, d: table(spark, d, "pages").select("page_id", attachments.object_key(F.sha2("html", 256)).alias("object_key")))


@on("S17_subset_manifest", "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 5")
def s17(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "manifest")
    best = r.latest(table(spark, d, "documents").withColumn("h", F.md5(F.concat(F.lit("7:"), "doc_id"))).withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id"))).where("n <= 5"), ["doc_id"], [F.asc("h")])
    best.select("doc_id", "source", "lang").write.json(folder)
    return spark.read.schema("doc_id long, source string, lang string").json(folder)


@on("S18_gzip_json", "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def s18(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "gz")
    table(spark, d, "documents").select("doc_id", "n_chars").write.option("compression", "gzip").json(folder)
    return spark.read.schema("doc_id long, n_chars long").json(folder).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@on("S19_append_unseen", "SELECT DISTINCT user_id, event_type FROM events")
def s19(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "enrichment")
    put = sinks.append_unseen(path, ["user_id", "event_type"])
    e = table(spark, d, "events").select("user_id", "event_type")
    for k in range(3):  # the last batch is delivered twice
        put(e.where(F.col("user_id") % 2 == min(k, 1)), k)
    return spark.read.parquet(path)


sql("S20_recent_store", "SELECT internal_id, fetched_at FROM emails ORDER BY fetched_at DESC, internal_id DESC LIMIT 200")


@on("S21_geo_lookup", "SELECT o_orderkey, n_name AS country FROM orders JOIN nation ON (o_orderkey * 48271) % 25000 BETWEEN n_nationkey * 1000 AND n_nationkey * 1000 + 999")
def s21(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 48271) % 25000).alias("ip"))
    blocks = table(spark, d, "nation").select((F.col("n_nationkey").cast("long") * 1000).alias("low"), (F.col("n_nationkey").cast("long") * 1000 + 999).alias("high"), F.col("n_name").alias("country"))
    return r.containment_join(points, blocks, "ip", "low", "high", bits=10).select("o_orderkey", "country")


sql("S22_enrichment_join", "SELECT p.page_id, t.asn, t.risk_score FROM pages p LEFT JOIN threats t ON t.id = p.page_id AND t.online")
LOOKALIKE = {"a": "@", "e": "3", "i": "1", "o": "0", "s": "$", "t": "7"}


@query("F86_char_noise")
def f86(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth character or so, by a seeded hash of its place, as its look-alike, twice, left out or swapped for a blank."""
    t = table(spark, d, "documents").select("doc_id", text.char_noise(F.col("text"), F.col("doc_id"), 10, LOOKALIKE).alias("noisy"))
    return t


# streams as folds over batches
@on("X01_fan_out", "SELECT topic, count(*) AS n FROM (SELECT 'analysis.' || event_type AS topic FROM events) GROUP BY topic")
def x01(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.stateful import fanned_out

    folder, e = shared_folder(spark, "topics"), table(spark, d, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    fanned_out(e, {f"analysis.{k}": e.where(F.col("event_type") == k) for k in kinds}, folder)
    return spark.read.schema(e.schema).option("recursiveFileLookup", True).parquet(folder).groupBy(F.concat(F.lit("analysis."), "event_type").alias("topic")).agg(F.count("*").alias("n"))


@on("X14_ingest_status", """WITH c AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events), q AS (SELECT event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS m FROM c WHERE n = 1)
    SELECT c.event_id, CASE WHEN c.n > 1 THEN 'duplicate' WHEN q.m > 30 THEN 'quota_exceeded' ELSE 'accepted' END AS status FROM c LEFT JOIN q ON q.event_id = c.event_id""")
def x14(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    marked = e.withColumn("n", n)
    first = r.quota(marked.where("n = 1").withColumn("org", F.col("user_id") % 5), ["org"], "ts", 30, ["event_id"]).select("event_id", F.when(F.col("accepted"), "accepted").otherwise("quota_exceeded").alias("status"))
    return marked.where("n > 1").select("event_id", F.lit("duplicate").alias("status")).unionByName(first)


@on("X16_campaign_state", f"{GROWN} SELECT id, max(n) AS n, max_by(mean, k) AS mean FROM m GROUP BY id")
def x16(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d)
    e = frame(spark, d, "emails").withColumnRenamed("campaign_id", "id").withColumnRenamed("risk_score", "v")
    return r.campaign_upsert(spark.sql(with_ctes(STATE)), e, "id", "v", ["fetched_at", "internal_id"]).select("id", F.col("email_count").alias("n"), F.col("risk_score").alias("mean"))


@on("X18_replay", "SELECT id, score, 1 AS copies FROM verdicts WHERE entity_type = 'view'")
def x18(spark: SparkSession, d: str) -> DataFrame:
    """The same batch delivered twice through the append-only log; ids stored before aren't stored again."""
    log = f"{shared_folder(spark, 'log')}/verdicts"
    batch = frame(spark, d, "verdicts").where("entity_type = 'view'").select("id", "score")
    for delivery in range(2):
        sinks.append_unseen(log, ["id"])(batch, delivery)
    return spark.read.parquet(log).groupBy("id", "score").agg(F.count("*").cast("int").alias("copies"))


# models
def _linear(w: list[float]):
    def load():
        import numpy as np

        return lambda x: 1 / (1 + np.exp(-(x @ np.array(w))))

    return load


on("M01_scorer", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_discount * 2 - l_tax))), 6) AS p FROM lineitem")(lambda spark, d: models.scored(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"], _linear([2.0, -1.0])).select("l_orderkey", "l_linenumber", F.round("probability", 6).alias("p")))


@on("M05_cascade", "SELECT l_orderkey, l_linenumber, round(CASE WHEN u <= 5e-1 THEN u WHEN o > 6e-1 AND u >= 5e-2 THEN 25e-2 * u + 75e-2 * o WHEN o < 1e-2 THEN 65e-2 * u + 35e-2 * o ELSE 6e-1 * u + 4e-1 * o END, 6) AS fused FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50e0 AS u, l_discount * 10 AS o FROM lineitem) t")
def m05(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = models.cascade(rows, lambda x: x.withColumn("url_p", F.col("l_quantity") / 50), lambda x: x.withColumn("op_p", F.col("l_discount") * 10), F.col("url_p") <= 0.5)
    return out.select("l_orderkey", "l_linenumber", F.round("fused", 6).alias("fused"))


@query("M06_isotonic")
def m06(spark: SparkSession, d: str) -> DataFrame:
    xs, ys = calibration.isotonic(frame(spark, d, J), "score", F.col("positive"))
    return spark.createDataFrame(list(zip(xs, ys, strict=True)), "x double, y double")


@query("M07_beta_calibration")
def m07(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, J).withColumn("p", F.col("score") / 101.0)
    return rows.select("doc_id", calibration.beta_calibrated(F.col("p"), calibration.beta(rows, "p", F.col("positive"))).alias("q"))


@query("M08_calibrated_or_fit")
def m08(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "scored")
    truth = F.coalesce(F.col("url_score"), F.lit(0)) + F.coalesce(F.col("nlp_score"), F.lit(0)) >= 120
    curves, final = calibration.calibrated_or_fit(rows, CH, truth)
    return rows.select("l_orderkey", "l_linenumber", F.round(scores.calibrated_or({k: F.col(c) for k, c in CH.items()}, curves, final), 4).alias("risk"))


@query("M09_combiner")
def m09(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, J).withColumn("len", F.col("doc_id") % 7).withColumn("truth", F.col("score") > 50)
    model = calibration.combiner(rows, ["score", "len"], F.col("truth"))
    return model.transform(__import__("pyspark.ml.feature", fromlist=["VectorAssembler"]).VectorAssembler(inputCols=["score", "len"], outputCol="features").transform(rows)).select("doc_id", F.col("prediction").cast("int").alias("predicted"))


@query("M17_temperature")
def m17(spark: SparkSession, d: str) -> DataFrame:
    t = calibration.temperature(frame(spark, d, J).withColumn("z", (F.col("score") - 50) / 10.0), "z", F.col("positive"))
    return spark.createDataFrame([(t,)], "temperature double")


@on("M21_adversarial_invariants", "SELECT conv_id, turn, TRUE AS same FROM conversations WHERE regexp_matches(text, '^[A-Za-z ,.]+$')")
def m21(spark: SparkSession, d: str) -> DataFrame:
    """Normalisation undoes full-width and homoglyph spellings of plain text."""
    plain = table(spark, d, "conversations").where(F.col("text").rlike("^[A-Za-z ,.]+$"))
    spelled = F.translate(F.translate("text", "aeo", "аео"), "X", "Ｘ")
    return plain.select("conv_id", "turn", (text.normalize(spelled) == text.normalize(F.col("text"))).alias("same"))


# console reads
sql("M23_email_list", "SELECT internal_id, org_id, risk_score, label FROM emails WHERE org_id = 3 AND NOT is_deleted ORDER BY fetched_at DESC, internal_id DESC LIMIT 25")
sql("M23_email_detail", "SELECT e.internal_id, e.risk_score, count(v.id) AS verdicts FROM emails e LEFT JOIN verdicts v ON v.entity_id = e.campaign_id WHERE e.internal_id = 42 GROUP BY e.internal_id, e.risk_score")
sql("M23_campaign_stats", "SELECT org_id, count(*) AS campaigns FROM campaigns GROUP BY org_id")
sql("M23_verdict_breakdown", "SELECT org_id, COALESCE(label, 'none') AS label, count(*) AS n FROM emails GROUP BY org_id, COALESCE(label, 'none')")
