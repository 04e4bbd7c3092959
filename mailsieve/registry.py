"""All queries of the engine by name, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query function under a name; oracle is the same result in DuckDB SQL."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored mail with its calibrated risk, label and source."""
    from .functions import scores
    from .plans.relational import frame

    rows = frame(spark, sf_dir, "scored")
    c = {k: f"{k}_score" for k in ("url", "header", "nlp", "attachment")}
    risk = F.floor(scores.calibrated_or({k: F.col(v) for k, v in c.items()}) + 0.5).cast("int")
    rows = rows.withColumn("risk_score", risk)
    return rows.select("l_orderkey", "l_linenumber", "risk_score", scores.reconciled(F.col("risk_score"), F.col("attachment_score")).alias("label"), scores.source(F.col("url_score"), F.col("header_score"), F.col("nlp_score")).alias("source"))


def load() -> None:
    """Imports the plan modules, which register their queries."""
    from .plans import extra, language, relational, scalars, scoring, streams  # noqa: F401
