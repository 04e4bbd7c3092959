"""Registrable domains by a public suffix list: a table of rules that is joined, since the list is long and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import is_ip


def suffix_rules(lines: DataFrame) -> DataFrame:
    """(suffix, more, exception) of a list's lines (column `value`): rules of plain, `*.` and `!` kind; blank lines and // comments are left out.

    A `*.` rule is kept under its parent with one label more, a `!` rule under its own name with one label less.
    """
    rule = F.lower(F.element_at(F.split(F.trim("value"), r"\s+"), 1))
    rules = lines.select(rule.alias("rule")).where("rule <> '' AND rule NOT LIKE '//%'").distinct()
    wild, not_ = F.col("rule").startswith("*."), F.col("rule").startswith("!")
    return rules.select(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("suffix"), F.when(wild, 1).when(not_, -1).otherwise(0).alias("more"), not_.alias("exception"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a list in the usual text format, at a path that all executors can read."""
    return suffix_rules(spark.read.text(path))


def apex_by_suffix(rows: DataFrame, host: str, rules: DataFrame, out: str = "apex") -> DataFrame:
    """rows with `out`: one label more than the longest suffix that a rule names (an exception goes first; no rule: the last label).

    Addresses stay as they are; a host that is a suffix itself gives its last two labels, as does one label itself; null gives
    null. Hosts are spelled as the list spells them, without a final dot. Each distinct host is looked up once, by an
    equi-join of its dotted endings with the rules.
    """
    names = rows.select(F.lower(host).alias("_h")).where("_h IS NOT NULL").distinct()
    names = names.withColumn("_l", F.split("_h", r"\.")).withColumn("_n", F.size("_l"))
    ends = names.select("_h", "_l", "_n", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"))
    ends = ends.withColumn("suffix", F.array_join(F.slice("_l", F.col("_n") - F.col("_k") + 1, F.col("_k")), "."))
    hits = ends.join(rules, "suffix", "left").withColumn("_s", F.col("_k") + F.col("more"))
    fits = F.col("_s").isNotNull() & (F.col("_s") <= F.col("_n"))
    best = hits.groupBy("_h").agg(F.first("_l").alias("_l"), F.first("_n").alias("_n"), F.max(F.when(fits, F.struct("exception", "_s"))).alias("_b"))
    size = F.coalesce(F.col("_b._s"), F.lit(1))
    take = F.least("_n", F.when(size < F.col("_n"), size + 1).otherwise(2))
    apex = F.when(is_ip(F.col("_h")), F.col("_h")).otherwise(F.array_join(F.slice("_l", F.col("_n") - take + 1, take), "."))
    return rows.join(best.select("_h", apex.alias("_apex")), F.lower(host) == F.col("_h"), "left").withColumn(out, F.col("_apex")).drop("_h", "_apex")
