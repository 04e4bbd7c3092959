"""Sinks for micro-batches: alerts to a webhook, enrichment rows that weren't seen, quarantine."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def post(url: str, body: dict, tries: int = 3, wait: float = 1.0, send: Callable | None = None) -> bool:
    """One alert with retries and doubled waits; a refusal of the request itself (4xx) is final."""

    def default(u, data):
        with urllib.request.urlopen(urllib.request.Request(u, data, {"Content-Type": "application/json"}), timeout=10) as r:  # noqa: S310
            return r.status < 300

    for k in range(tries):
        try:
            if (send or default)(url, json.dumps(body).encode()):
                return True
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500:
                return False
        except OSError:
            pass
        if k + 1 < tries:
            time.sleep(wait * 2**k)
    return False


def webhook_batch(url: str, send: Callable | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that posts each row from the executors, without `recipients`, which are for mail alone."""

    def run(batch: DataFrame, _: int) -> None:
        def each(rows) -> None:
            for r in rows:
                post(url, json.loads(r.value), send=send)

        batch.drop("recipients").select(F.to_json(F.struct("*")).alias("value")).foreachPartition(each)

    return run


def append_unseen(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose keys the Parquet table doesn't have yet; a redelivered batch adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(keys)
        try:
            old = batch.sparkSession.read.parquet(path).select(*keys)
            fresh = fresh.join(old, keys, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return run


def refreshed(summaries: dict[str, DataFrame], folder: str) -> None:
    """Each summary computed anew and written over its table."""
    for name, df in summaries.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def quarantined(batch: DataFrame, good: str, bad: str, poison: str = "poison") -> None:
    """Readable rows to one table, the rest to another."""
    batch.where(F.col(poison).isNull()).drop(poison).write.mode("append").parquet(good)
    batch.where(F.col(poison).isNotNull()).write.mode("append").parquet(bad)
