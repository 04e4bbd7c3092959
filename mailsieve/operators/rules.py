"""The rule language: JSON rules compiled to column predicates when the plan is made.

A rule is {"all": [...]}, {"any": [...]}, {"not": ...} or a leaf {"signal", "op", "value"}; a root may carry
{"category", "expr"}. Signals are columns; a null column is a missing signal. Every op but `missing` is false on a missing
signal. Numbers that can't be compared count as equal, so gte and lte hold for them.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("auth", "reputation", "structural")
DEFAULT_CATEGORY = {"header": "structural", "email": "auth"}


class RuleError(ValueError):
    """A malformed rule; such rules are skipped."""


class Signals:
    """Signal names and the columns they stand for, with each column's type."""

    def __init__(self, df: DataFrame, columns: dict[str, str]):
        types = dict(df.dtypes)
        self.columns = {k: (F.col(f"`{c}`"), types[c]) for k, c in columns.items()}

    def kind(self, name: str) -> str:
        t = self.columns[name][1]
        return "bool" if t == "boolean" else "text" if t == "string" else "number" if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else "other"


def _number(v: Any) -> float | None:
    return float(v) if isinstance(v, (bool, int, float)) else None


def _equal(c: Column, kind: str, v: Any) -> Column:
    if kind == "bool":
        return c == F.lit(v) if isinstance(v, bool) else F.lit(False)
    if kind == "text":
        return F.lower(c) == F.lit(v.lower()) if isinstance(v, str) else F.lit(False)
    if kind == "number" and _number(v) is not None:
        return c.cast("double") == F.lit(_number(v))
    return F.to_json(F.struct(c.alias("v"))) == F.lit(json.dumps({"v": v}, separators=(",", ":")))


def _compared(c: Column, kind: str, v: Any) -> Column:
    """-1, 0 or 1; 0 where either isn't a number."""
    n = _number(v)
    if kind not in ("bool", "number") or n is None:
        return F.lit(0)
    x = c.cast("int").cast("double") if kind == "bool" else c.cast("double")
    return F.when(x < n, -1).when(x > n, 1).otherwise(0)


def _leaf(rule: dict, signals: Signals) -> Column:
    name, op, value = rule.get("signal"), rule.get("op"), rule.get("value")
    if not isinstance(name, str) or not isinstance(op, str) or not name or not op:
        raise RuleError(f"a leaf needs signal and op: {rule}")
    op = op.strip().lower()
    ops = {"eq", "neq", "gt", "gte", "lt", "lte", "in", "not_in", "contains", "exists", "missing"}
    if op not in ops:
        raise RuleError(f"unsupported op {op!r}")
    if name not in signals.columns:
        return F.lit(op == "missing")
    c, kind = signals.columns[name][0], signals.kind(name)
    if op == "missing":
        return c.isNull()
    if op == "exists":
        return c.isNotNull()
    if op in ("eq", "neq"):
        hit = _equal(c, kind, value)
    elif op in ("in", "not_in"):
        hit = F.lit(False)
        for v in value if isinstance(value, list) else []:
            hit = hit | _equal(c, kind, v)
    elif op == "contains":
        hit = F.contains(F.lower(c), F.lit(value.lower())) if kind == "text" and isinstance(value, str) else F.lit(False)
    else:
        sign = _compared(c, kind, value)
        hit = {"gt": sign > 0, "gte": sign >= 0, "lt": sign < 0, "lte": sign <= 0}[op]
    hit = ~hit if op in ("neq", "not_in") else hit
    return F.coalesce(c.isNotNull() & hit, F.lit(False))


def predicate(rule: Any, signals: Signals) -> Column:
    if not isinstance(rule, dict):
        raise RuleError(f"not an object: {rule!r}")
    if "all" in rule or "any" in rule:
        both = rule.get("all", rule.get("any"))
        if not isinstance(both, list) or not both:
            raise RuleError("all and any need a list")
        out = predicate(both[0], signals)
        for r in both[1:]:
            out = out & predicate(r, signals) if "all" in rule else out | predicate(r, signals)
        return out
    return ~predicate(rule["not"], signals) if "not" in rule else _leaf(rule, signals)


def compiled(logic: str, signals: Signals, target: str = "header") -> tuple[Column, str]:
    """(predicate, category) of a rule's JSON text."""
    try:
        root = json.loads(logic)
    except ValueError as e:
        raise RuleError(f"not JSON: {e}") from e
    if not isinstance(root, dict):
        raise RuleError("rule logic is not an object")
    if "category" not in root:
        return predicate(root, signals), DEFAULT_CATEGORY.get(target, "auth")
    if not isinstance(root["category"], str) or "expr" not in root:
        raise RuleError("a rule with a category needs an expr")
    category = root["category"].strip().lower()
    return predicate(root["expr"], signals), category if category in CATEGORIES else "auth"


def active_rules(rules: DataFrame, targets: list[str], org_id: int | None = None) -> list:
    """The active rules for the targets, global ones and the organisation's, by id. Rules are a small dimension: they are collected."""
    own = F.col("org_id").isNull() if org_id is None else F.col("org_id").isNull() | (F.col("org_id") == org_id)
    return rules.where((F.col("status") == "active") & F.col("target").isin(targets) & own).orderBy("id").collect()


def evaluate(df: DataFrame, rules: list, columns: dict[str, str]) -> DataFrame:
    """df with `fired`: array of struct(rule_id, name, version, score_impact, category) of the rules that match, in rule order. Malformed rules are skipped."""
    signals, hits = Signals(df, columns), []
    for r in rules:
        try:
            p, category = compiled(r["logic"], signals, r["target"])
        except RuleError:
            continue
        hits.append(F.when(p, F.struct(F.lit(r["id"]).cast("long").alias("rule_id"), F.lit(r["name"]).alias("name"), F.lit(r["version"]).alias("version"), F.lit(r["score_impact"]).cast("int").alias("score_impact"), F.lit(category).alias("category"))))
    empty = F.array().cast("array<struct<rule_id:bigint,name:string,version:string,score_impact:int,category:string>>")
    return df.withColumn("fired", F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else empty)


def category_score(fired: Column, category: str) -> Column:
    """Impacts of a category summed and clamped to 0..100."""
    of = F.filter(fired, lambda x: x["category"] == category)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate(of, F.lit(0), lambda a, x: a + x["score_impact"])))


def total_impact(fired: Column) -> Column:
    return F.aggregate(fired, F.lit(0), lambda a, x: a + x["score_impact"])


def rule_hits(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each fired rule, with its version and impact at that time."""
    return df.select(*keys, F.explode("fired").alias("r")).select(*keys, "r.*")
