"""Stateful stream operators: claims, quotas, rate limits, and the plan-driven join of component scores.

The folds are plain functions of (state, rows), so that batches and tests use the same code as streams. State is kept by Spark's
state store, keyed, with time-outs where the state must go.
"""

from __future__ import annotations

import heapq
import itertools
import json
import tempfile
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

CLAIM_DAYS = 7
TIMEOUT_SECONDS, KEEP_SECONDS = 30, 120
#: Rows of one group that are sorted in memory; runs of so many are merged from disk where there are more.
RUN_ROWS, PIECE_ROWS = 1 << 20, 1 << 14
#: Stands for a null key while rows are sorted, after all others.
NO_KEY = np.iinfo(np.int64).max


def claimed(stream: DataFrame, keys: list[str], at: str, days: int = CLAIM_DAYS) -> DataFrame:
    """First arrivals of each key within so many days; rows with an empty key pass. State is bounded by the watermark."""
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull() | (F.col(k).cast("string") == "")
    marked = stream.withWatermark(at, f"{days} days").withColumn("_k", F.when(empty, F.expr("uuid()")).otherwise(F.to_json(F.struct(*keys))))
    return marked.dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def quota_fold(used: int, limit: int | None, n: int) -> tuple[int, list[bool]]:
    """Which of n further rows fit a limit of which `used` are spent."""
    return used + n, [limit is None or used + i + 1 <= limit for i in range(n)]


def quota(stream: DataFrame, org: str, at: str, key: str, limit: int) -> DataFrame:
    """(org, key, month, accepted) by a counter for each organisation and month."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for b in batches:
            b = b.sort_values([at, key])
            used, ok = quota_fold(used, limit, len(b))
            yield pd.DataFrame({org: k[0], key: b[key].values, "month": k[1], "accepted": ok})
        state.update((used,))

    rows = stream.select(F.col(org).cast("long").alias(org), F.col(key).cast("long").alias(key), at, F.date_format(at, "yyyy-MM").alias("month"))
    return rows.groupBy(org, "month").applyInPandasWithState(run, f"{org} long, {key} long, month string, accepted boolean", "used long", "append", GroupStateTimeout.NoTimeout)


def limit_fold(last: float | None, times: list[float], seconds: float) -> tuple[float | None, list[bool]]:
    """Rows allowed if none was allowed in the seconds before."""
    out = []
    for t in times:
        ok = last is None or t - last >= seconds
        last = t if ok else last
        out.append(ok)
    return last, out


def in_order(batches: Iterator[pd.DataFrame], at: str, key: str, run_rows: int = RUN_ROWS) -> Iterator[np.ndarray]:
    """All of a group's rows as arrays of (microseconds, key), ordered by both from the first array to the last; null times and keys come last.

    Spark hands a group over in Arrow batches that are cut anywhere and come in no order, so order within each isn't enough.
    Up to run_rows rows are sorted in memory; more are written to a nameless temporary file in sorted runs and merged.
    """
    have, n, sizes = [], 0, []
    with tempfile.TemporaryFile() as file:
        for b in itertools.chain(batches, [None]):
            if b is not None:
                t = b[at].astype("datetime64[us]")
                have.append(np.stack([t.astype("int64").where(t.notna(), NO_KEY).to_numpy(), b[key].astype("Int64").to_numpy("int64", na_value=NO_KEY)], axis=1))
                n += len(b)
            if n and (n >= run_rows or b is None):
                rows = np.concatenate(have)
                rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
                have, n = [], 0
                if b is None and not sizes:
                    yield rows
                    return
                file.write(rows.tobytes())
                sizes.append(len(rows))
        if not sizes:
            return
        file.flush()
        whole = np.memmap(file, dtype=np.int64, mode="r").reshape(-1, 2)
        ends = np.cumsum(sizes).tolist()
        read = lambda i, j: itertools.chain.from_iterable(whole[k : min(k + PIECE_ROWS, j)].tolist() for k in range(i, j, PIECE_ROWS))
        merged = heapq.merge(*map(read, [0, *ends[:-1]], ends))
        while piece := list(itertools.islice(merged, PIECE_ROWS)):
            yield np.array(piece, dtype=np.int64)


def rate_limited(stream: DataFrame, keys: list[str], at: str, key: str, seconds: int = 3600) -> DataFrame:
    """(keys, key, allowed): the first row of a key opens a period in which no other is allowed; null where the time is. Rows of one micro-batch are taken in the order of `at` and `key`."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for rows in in_order(batches, at, key):
            gone = rows == NO_KEY
            last, ok = limit_fold(last, np.where(gone[:, 0], np.nan, rows[:, 0] / 1e6).tolist(), seconds)
            ids, allowed = pd.array(rows[:, 1], dtype="Int64"), pd.array(ok, dtype="boolean")
            ids[gone[:, 1]] = pd.NA
            allowed[gone[:, 0] & ~np.array(ok)] = pd.NA
            yield pd.DataFrame({key: ids, "allowed": allowed}).assign(**dict(zip(keys, k, strict=True)))[[*keys, key, "allowed"]]
        state.update((None if last is None or np.isnan(last) else last,))

    rows = stream.select(*[F.col(c).cast("long").alias(c) for c in [*keys, key]], F.col(at).cast("timestamp").alias(at))
    schema = ", ".join(f"{c} long" for c in [*keys, key]) + ", allowed boolean"
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def bucket_fold(bucket: dict[str, Any], row: dict[str, Any]) -> dict[str, Any]:
    """A message put in an email's bucket: a plan sets the expected components, a score its own; first values win."""
    out = dict(bucket)
    if row["component"] == "plan":
        out.setdefault("expected", sorted(json.loads(row["payload"] or "[]")))
    else:
        out.setdefault("scores", {})
        out["scores"] = {row["component"]: row["score"]} | out["scores"]
        if row.get("degraded"):
            out["degraded"] = sorted({*out.get("degraded", []), row["component"]})
    return out


def missing(bucket: dict[str, Any]) -> list[str]:
    return sorted(set(bucket.get("expected", [])) - set(bucket.get("scores", {})))


def packaged(bucket: dict[str, Any], timed_out: bool) -> dict[str, Any]:
    """What is known of an email once it is complete or late."""
    gone = missing(bucket)
    return {**{f"{c}_score": bucket.get("scores", {}).get(c) for c in ("url", "header", "nlp", "attachment")}, "missing": gone, "degraded": bucket.get("degraded", []), "partial": bool(gone), "timed_out": timed_out}


AGGREGATED = "org_id long, email_id string, url_score double, header_score double, nlp_score double, attachment_score double, missing array<string>, degraded array<string>, partial boolean, timed_out boolean, status string"


def aggregated(stream: DataFrame, timeout: int = TIMEOUT_SECONDS, keep: int = KEEP_SECONDS) -> DataFrame:
    """One row for each email when its plan's scores are all there, or after the time-out with what there is.

    stream has org_id, email_id, component (plan, url, header, nlp, attachment), score, payload (the plan's expected
    components as JSON) and degraded. Buckets that never got a plan are dropped at the time-out. What comes after a row was
    sent out is returned as late_drop, for as long as the bucket's mark is kept.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = json.loads(state.get[0]) if state.exists else {}
        row = lambda status, late: pd.DataFrame([{"org_id": k[0], "email_id": k[1], **packaged(bucket, late), "status": status}])
        if state.hasTimedOut:
            if bucket.get("done") or "expected" not in bucket:
                state.remove()
                return
            yield row("partial", True)
            state.update((json.dumps({"done": True}),))
            state.setTimeoutDuration(keep * 1000)
            return
        late = 0
        for b in batches:
            for r in b.to_dict("records"):
                if bucket.get("done"):
                    late += 1
                else:
                    bucket = bucket_fold(bucket, {**r, "score": None if pd.isna(r["score"]) else float(r["score"])})
        for _ in range(late):
            yield row("late_drop", False)
        if not bucket.get("done") and "expected" in bucket and not missing(bucket):
            yield row("complete", False)
            bucket = {"done": True}
        state.update((json.dumps(bucket),))
        state.setTimeoutDuration((keep if bucket.get("done") else timeout) * 1000)

    rows = stream.select(F.col("org_id").cast("long").alias("org_id"), F.col("email_id").cast("string").alias("email_id"), "component", F.col("score").cast("double").alias("score"), "payload", "degraded")
    return rows.groupBy("org_id", "email_id").applyInPandasWithState(run, AGGREGATED, "bucket string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def closed_buckets(messages: DataFrame, at: str, timeout: int = TIMEOUT_SECONDS, keys: tuple = ("org_id", "email_id"), components: tuple = ("url", "header", "nlp", "attachment")) -> DataFrame:
    """(keys, status, missing, late): what became of the bucket that an email's first message opened, from recorded messages.

    complete: the plan and its scores came in the time-out; partial: the plan came, the scores in `missing` didn't; dropped: no
    plan came in time. late counts the messages after a bucket was complete or out of time; those of a dropped one too, though
    the stream would open another bucket for them. One shuffle by keys; nothing is collected per email.
    """
    w = Window.partitionBy(*keys)
    m = messages.withColumn("opened", F.min(at).over(w)).withColumn("end", F.col("opened") + F.expr(f"INTERVAL {int(timeout)} SECONDS"))
    came = lambda c: F.min(F.when((F.col("component") == c) & (F.col(at) <= F.col("end")), F.col(at))).over(w).alias(f"{c}_at")
    plan = F.min_by("payload", F.when((F.col("component") == "plan") & (F.col(at) <= F.col("end")), F.col(at))).over(w)
    m = m.select(*keys, at, "end", came("plan"), *map(came, components), F.coalesce(F.from_json(plan, "array<string>"), F.array().cast("array<string>")).alias("expected"))
    here = F.filter(F.array(*[F.when(F.col(f"{c}_at").isNotNull(), F.lit(c)) for c in components]), lambda c: c.isNotNull())
    m = m.withColumn("missing", F.array_sort(F.array_except("expected", here)))
    m = m.withColumn("status", F.when(F.col("plan_at").isNull(), "dropped").when(F.size("missing") > 0, "partial").otherwise("complete"))
    whole = F.greatest(F.col("plan_at"), *[F.when(F.array_contains("expected", c), F.col(f"{c}_at")) for c in components])
    return m.groupBy(*keys, "status", "missing").agg(F.count_if(F.col(at) > F.when(F.col("status") == "complete", whole).otherwise(F.col("end"))).alias("late"))


def fanned_out(batch: DataFrame, targets: dict[str, DataFrame], folder: str) -> None:
    """One batch written to several tables, read once."""
    batch.persist()
    try:
        for name, df in targets.items():
            df.write.mode("append").parquet(f"{folder}/{name}")
    finally:
        batch.unpersist()
