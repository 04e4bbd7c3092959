"""Relational operators: tenant views, latest rows, merges, upserts, queues, validation, containment joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tenant_view(df: DataFrame, org_id: int | None, org: str = "org_id", shared: str | None = None) -> DataFrame:
    """Rows of one organisation, and shared rows where the table has a flag. No valid organisation sees nothing."""
    if org_id is None or org_id <= 0:
        return df.where(F.lit(False))
    own = F.col(org) == org_id
    return df.where(F.coalesce(own | F.col(shared) if shared else own, F.lit(False)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given. The order must end in a unique column to be repeatable."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: dict[str, Callable[[Column, Column], Column]], insert: dict[str, Column] | None = None) -> DataFrame:
    """Merge by null-safe keys: columns in `update` become f(old, new) where both exist, other columns stay as they were; new rows are put in.

    new must hold a key once. One full outer join; `action` tells what became of each row (kept, updated, inserted).
    """
    cols = [c for c in old.columns if c not in keys]
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    out = [F.when(F.col("o._o"), F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys]
    both, only_new = F.col("o._o") & F.col("n._n"), F.col("o._o").isNull()
    for c in cols:
        fresh = (insert or {}).get(c, F.col(f"n.{c}") if c in new.columns else F.lit(None))
        changed = update[c](F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)) if c in update else F.col(f"o.{c}")
        out.append(F.when(only_new, fresh).when(both, changed).otherwise(F.col(f"o.{c}")).alias(c))
    action = F.when(only_new, "inserted").when(both, "updated").otherwise("kept").alias("action")
    return o.join(n, on, "full").select(*out, action)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it doesn't hold; the first of equal keys in new wins (by its other columns)."""
    rest = [c for c in new.columns if c not in keys]
    fresh = latest(new, keys, [F.col(c).asc() for c in rest] or [F.lit(1)])
    o = old.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return old.unionByName(fresh.join(o, on, "left_anti").select(*old.columns))


def deactivate_unseen(df: DataFrame, cutoff: Column, seen: str = "last_seen", active: str = "is_active") -> DataFrame:
    """Rows not seen since the cutoff, or never, turn inactive."""
    stale = F.col(seen).isNull() | (F.col(seen) < cutoff)
    return df.withColumn(active, F.col(active) & ~stale)


def tag_union(*arrays: Column) -> Column:
    """Distinct trimmed non-empty tags, sorted."""
    every = F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: F.trim(x)), lambda x: x != "")))


def tag_dedupe(tags: Column) -> Column:
    """Tags that differ only in case once, as first written."""
    clean = F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(clean, lambda x, i: F.array_position(F.transform(clean, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def running_mean(values: Column, mean: Column | None = None, n: Column | None = None) -> Column:
    """The mean that grows by round((mean * n + value) / (n + 1)) over an array in order, from a mean of n values on."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.coalesce(mean.cast("long"), zero).alias("m") if mean is not None else zero.alias("m"), F.coalesce(n.cast("long"), zero).alias("n") if n is not None else zero.alias("n"))
    step = lambda a, v: F.struct(F.floor((a["m"] * a["n"] + v) / (a["n"] + 1) + 0.5).cast("long").alias("m"), (a["n"] + 1).alias("n"))
    return F.aggregate(values, start, step)["m"]


def campaign_upsert(old: DataFrame, new: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, is_new, risk_score, email_count): campaigns after each row of new, in order, was put into its campaign or opened one.

    The mean is rounded at every step, so a campaign's new values are folded in order; only they are gathered, per campaign of one batch.
    """
    batch = new.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("long").alias("_v")))).alias("_x"))
    out = old.withColumn("_old", F.lit(True)).join(batch, key, "full")
    values = F.coalesce(F.transform("_x", lambda x: x["_v"]), F.array().cast("array<bigint>"))
    return out.select(key, F.col("_old").isNull().alias("is_new"), running_mean(values, F.col("risk_score"), F.col("email_count")).alias("risk_score"), (F.coalesce("email_count", F.lit(0)) + F.size(values)).cast("long").alias("email_count"))


def partial_update(old: DataFrame, changes: DataFrame, key: str, guard: Column | None = None) -> DataFrame:
    """old with the columns that changes has too set to its values where they aren't null; rows that the guard excludes stay."""
    cols = [c for c in changes.columns if c != key]
    c = changes.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_{x}") for x in cols])
    may = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
    out = old.join(c, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.when(may, F.coalesce(f"_{x}", x)).otherwise(F.col(x)).alias(x) if x in cols else F.col(x) for x in old.columns])


def cascade_delete(children: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """The children less the rows that belong to a parent in gone; null keys belong to none."""
    parents = gone.select(key).distinct()
    return {name: df.join(parents, key, "left_anti") for name, df in children.items()}


def refuse_locked(rows: DataFrame, changes: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """rows with the changes that may be made, and `refused`: rows that `used` refers to don't change."""
    locked = used.select(F.col(key).alias("_u")).distinct()
    out = rows.join(locked, F.col(key) == F.col("_u"), "left").withColumn("_locked", F.col("_u").isNotNull())
    changed = partial_update(out.drop("_u"), changes, key, ~F.col("_locked"))
    asked = changes.select(F.col(key).alias("_a")).distinct()
    return changed.join(asked, F.col(key) == F.col("_a"), "left").withColumn("refused", F.col("_locked") & F.col("_a").isNotNull()).drop("_a", "_locked")


def looked_up(rows: DataFrame, key: str, cache: DataFrame, answers: DataFrame, votes: str, at: str, now: Column, hours: int = 24) -> DataFrame:
    """rows with `malicious` (more than 0 votes) and `origin`: cached, if the latest cached answer is younger than `hours`, else asked, else skipped, which is not malicious.

    cache has key, votes and the time of the answer; answers has key and votes, a key at most once.
    """
    fresh = cache.where(F.col(at) > now - F.expr(f"INTERVAL {int(hours)} HOURS")).groupBy(key).agg(F.max_by(F.struct(votes), at).alias("_kept"))
    out = rows.join(fresh, key, "left").join(answers.select(key, F.struct(votes).alias("_said")), key, "left")
    count = F.coalesce(F.col("_kept"), F.col("_said"))[votes]
    origin = F.when(F.col("_kept").isNotNull(), "cached").when(F.col("_said").isNotNull(), "asked").otherwise("skipped")
    return out.withColumn("malicious", F.coalesce(count > 0, F.lit(False))).withColumn("origin", origin).drop("_kept", "_said")


def referenced(rows: DataFrame, col: str, values: DataFrame) -> DataFrame:
    """rows with `col` in lower case and `refused`: it isn't among the values (one column). Nulls pass."""
    known = values.select(F.lower(values.columns[0]).alias("_known")).distinct()
    out = rows.withColumn(col, F.lower(col)).join(known, F.col(col) == F.col("_known"), "left")
    return out.withColumn("refused", F.col(col).isNotNull() & F.col("_known").isNull()).drop("_known")


def validated(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df with `violations`: names of the checks that a row doesn't pass; a null check passes, as in SQL."""
    return df.withColumn("violations", F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull()))


def first_within(df: DataFrame, keys: list[str], at: str, seconds: int, ties: list[str]) -> DataFrame:
    """df with `allowed`: the first row of a key opens a period of so many seconds in which further rows aren't allowed; then the next opens another.

    Periods start at allowed rows, so they aren't fixed windows: a fold over each key's times in order. Only times are gathered, in a
    key's group.
    """
    w = Window.partitionBy(*keys).orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, 0)
    t = F.unix_seconds(F.col(at).cast("timestamp"))
    order = Window.partitionBy(*keys).orderBy(at, *ties)
    gap = t - F.lag(t).over(order)
    # a gap as long as the period always opens a new one, so a key is cut there into independent runs
    run = F.sum(F.when(gap.isNull() | (gap >= seconds), 1).otherwise(0)).over(w)
    cut = df.withColumn("_run", run).withColumn("_t", t)
    times = F.array_sort(F.array_distinct(F.collect_list("_t")))
    opened = F.aggregate(times, F.array().cast("array<bigint>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) >= seconds), F.concat(a, F.array(x))).otherwise(a))
    groups = cut.groupBy(*keys, "_run").agg(opened.alias("_open"))
    first = F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(*ties)) == 1
    return cut.join(groups, [*keys, "_run"]).withColumn("allowed", F.array_contains("_open", F.col("_t")) & first).drop("_run", "_t", "_open")


def quota(df: DataFrame, keys: list[str], at: str, limit: int, ties: list[str]) -> DataFrame:
    """df with `used` (rows of the key's month so far) and `accepted` (within the limit)."""
    w = Window.partitionBy(*keys, F.date_trunc("month", at)).orderBy(at, *ties)
    return df.withColumn("used", F.row_number().over(w)).withColumn("accepted", F.col("used") <= limit)


def containment_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, bits: int = 16) -> DataFrame:
    """Rows of points with the ranges that hold them, by an equi-join on blocks of 2**bits numbers.

    A range is listed under every block that it touches (at most 2**(32 - bits) for addresses), so no nested loop is needed.
    """
    block = lambda c: F.shiftright(F.col(c), bits)
    r = ranges.withColumn("_block", F.explode(F.sequence(block(low), block(high))))
    return points.withColumn("_block", block(point)).join(r, "_block").where(F.col(point).between(F.col(low), F.col(high))).drop("_block")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of an ordered list; the limit is the feature."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500, offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose parent is gone."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def job_next(jobs: DataFrame) -> DataFrame:
    """The pending job of highest priority, the oldest first."""
    return jobs.where("status = 'pending'").orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id")).limit(1)


def job_failed(jobs: DataFrame, failed_ids: list[int]) -> DataFrame:
    """Failed jobs go back to pending until their attempts are used up."""
    hit = F.col("id").isin(failed_ids) & (F.col("status") == "in_progress")
    tries = F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts"))
    return jobs.withColumn("status", F.when(hit & (tries >= F.col("max_attempts")), "failed").when(hit, "pending").otherwise(F.col("status"))).withColumn("attempts", tries)
