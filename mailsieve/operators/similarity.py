"""Similarity joins: typosquats by edit distance, near duplicates by SimHash, best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import damerau_levenshtein, hamming
from ..functions.mail import BRANDS, candidate_labels


def _deletions(s: Column) -> Column:
    """The text and all texts with one character left out."""
    n = F.length(s)
    return F.array_distinct(F.concat(F.array(s), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)))))


def domain_guard(hosts: DataFrame, allowlist: DataFrame, apex: str = "apex") -> DataFrame:
    """hosts with verdict and brand: real (on the list), typosquat (one edit from an entry; the first by rank), unknown.

    allowlist has domain and rank. Texts one edit apart share a text with at most one character left out, so the edit join
    is an equi-join on those, then checked; neither side needs to be small.
    """
    names = hosts.select(F.lower(F.col(apex)).alias("_a")).where("_a IS NOT NULL").distinct()
    entries = allowlist.select(F.lower("domain").alias("_e"), F.col("rank").alias("_r"))
    left = names.select("_a", F.explode(_deletions(F.col("_a"))).alias("_k"))
    right = entries.select("_e", "_r", F.explode(_deletions(F.col("_e"))).alias("_k"))
    near = left.join(right, "_k").where(F.levenshtein("_a", "_e", 1).isin(0, 1)).withColumn("_d", F.levenshtein("_a", "_e"))
    best = near.groupBy("_a").agg(F.max(F.col("_d") == 0).alias("_same"), F.min_by("_e", "_r").alias("_near"))
    out = hosts.join(best, F.lower(F.col(apex)) == F.col("_a"), "left")
    verdict = F.when(F.col("_same"), "real").when(F.col("_near").isNotNull(), "typosquat").otherwise("unknown")
    return out.withColumn("verdict", verdict).withColumn("brand", F.when(F.col("_same"), F.lower(F.col(apex))).otherwise(F.col("_near"))).drop("_a", "_same", "_near")


def brand_typosquat(hosts: DataFrame, domain: str = "domain", most: int = 2, brands: list[str] = BRANDS) -> DataFrame:
    """hosts with target and distance: the brand nearest to any candidate label within `most` edits with transpositions; null if none, or if a candidate is a brand.

    Brands are a fixed list, so each distinct domain is compared with all of them; ties go to the smaller distance, then list order.
    """
    names = hosts.select(F.regexp_replace(F.lower(F.trim(F.col(domain))), r"\.$", "").alias("_d")).where("_d <> ''").distinct()
    table = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(b).alias("brand")) for i, b in enumerate(brands)])
    pairs = names.select("_d", F.explode(candidate_labels(F.col("_d"))).alias("_c")).select("*", F.explode(table).alias("_b"))
    pairs = pairs.where(F.abs(F.length("_c") - F.length("_b.brand")) <= most)
    pairs = pairs.withColumn("_n", damerau_levenshtein(F.col("_c"), F.col("_b.brand"), most)).where(F.col("_n") <= most)
    best = pairs.groupBy("_d").agg(F.min(F.struct("_n", "_b.rank", "_b.brand")).alias("_best")).where("_best._n > 0")
    out = hosts.join(best, F.regexp_replace(F.lower(F.trim(F.col(domain))), r"\.$", "") == F.col("_d"), "left")
    return out.withColumn("target", F.col("_best.brand")).withColumn("distance", F.coalesce(F.col("_best._n"), F.lit(0))).drop("_d", "_best")


def min_brand_distance(labels: DataFrame, label: str, brands: list[str]) -> DataFrame:
    """labels with brand_distance: the smallest edit distance to a brand of the fixed list."""
    return labels.withColumn("brand_distance", F.least(*[F.levenshtein(F.col(label), F.lit(b)) for b in brands]))


def simhash_pairs(df: DataFrame, key: str, group: str, hash_: str, most: int = 3) -> DataFrame:
    """(group, a, b, distance), a < b, whose hashes differ in `most` bits at most.

    Equal hashes are one class, linked to its smallest key. Different hashes within most bits agree in one of most + 1 bands of
    bits, so classes are joined on bands and checked.
    """
    bands = most + 1
    width = 64 // bands
    classes = df.groupBy(group, hash_).agg(F.min(key).alias("rep"))
    band = lambda i: F.shiftrightunsigned(F.col(hash_), i * width).bitwiseAND((1 << width) - 1)
    keyed = classes.select(group, hash_, "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), band(i).alias("v")) for i in range(bands)])).alias("band"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.rep") < F.col("b.rep")))
    near = near.select(F.col(f"a.{group}").alias(group), F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), hamming(F.col(f"a.{hash_}"), F.col(f"b.{hash_}")).alias("distance")).where(F.col("distance") <= most).distinct()
    same = df.join(classes, [group, hash_]).where(F.col(key) > F.col("rep")).select(group, F.col("rep").alias("a"), F.col(key).alias("b"), F.lit(0).alias("distance"))
    return near.union(same)


def best_indicator(lookups: DataFrame, indicators: DataFrame, kind: str = "kind", value: str = "value") -> DataFrame:
    """lookups with the active indicator of their kind and value that has the highest risk, then the latest sight."""
    live = indicators.where("is_active")
    best = live.groupBy(F.col("indicator_type").alias("_k"), F.col("indicator_value").alias("_v")).agg(F.max(F.struct("risk_score", F.col("last_seen").isNotNull().alias("seen"), "last_seen", F.negative("id").alias("neg"), "threat_type")).alias("_i"))
    out = lookups.join(best, (F.col(kind) == F.col("_k")) & (F.col(value) == F.col("_v")), "left")
    return out.withColumn("ti_match", F.col("_i").isNotNull()).withColumn("ti_risk", F.col("_i.risk_score")).withColumn("ti_type", F.col("_i.threat_type")).drop("_k", "_v", "_i")
