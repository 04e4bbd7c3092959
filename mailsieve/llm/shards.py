"""Sharding by Karmarkar-Karp differencing of indivisible groups.

Groups are rows of equal text. A group of more than 1/UNITS of all bytes is a unit by itself; the other groups are dealt by
the hash of their text into UNITS units of whole groups. So there are at most 2 * UNITS units whatever the input, small
enough for one exact run of differencing, while rows never move to be assigned: a row's unit follows from its own text and
from the list of large groups (at most UNITS by definition), which is broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import saved, text_size

SHARDS, UNITS = 24, 8192
#: Rows of a shard are numbered in this many ranges of their hash, or more: about RANGE_ROWS rows in each if one shard had all.
RANGES, RANGE_ROWS = 512, 1 << 15


def differencing(sizes: list[int], k: int) -> list[int]:
    """For each item the part, 0 to k-1, that it gets.

    A heap holds partial partitions of k sums. The two with the largest spread are combined, the largest sum of one with the
    smallest of the other, until one is left. Sums are kept less their smallest, which doesn't change any spread.
    """
    if not sizes:
        return []
    heap, merges = [], []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [0] * (k - 1) + [size]))
    heapq.heapify(heap)
    at = len(sizes)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        both = sorted(zip([x + y for x, y in zip(a, reversed(b), strict=True)], range(k), strict=True))
        low = both[0][0]
        merges.append((i, j, [(q, k - 1 - q) for _, q in both]))  # of which part of either the new parts are made
        heapq.heappush(heap, (low - both[-1][0], at, [x - low for x, _ in both]))
        at += 1
    out = [0] * len(sizes)
    names = {at - 1: list(range(k))}  # of a partial partition: the final part for each of its parts
    for n in range(len(merges) - 1, -1, -1):
        i, j, made = merges[n]
        final = names.pop(len(sizes) + n)
        for child, side in ((i, 0), (j, 1)):
            names[child] = [f for _, f in sorted((pair[side], final[p]) for p, pair in enumerate(made))]
    for i in range(len(sizes)):
        out[i] = names[i][k - 1]
    return out


def shards(docs: DataFrame, n: int = SHARDS, units: int = UNITS) -> DataFrame:
    """All columns of docs and size, text_crc32, law, shard, slot, grown_shard; columns of docs that have these names are replaced.

    Law `bytes`: the shards' sizes are near equal, and rows of equal text stand in one shard. One group that is larger than a
    shard's share fills a shard by itself and the others share the rest. A null text has size 8 and the check sum 0 of no
    bytes, and nulls are a group of their own; so are empty texts. Slots count the rows of each shard from 0 in an order by
    hash and doc_id; repeated rows get different slots. grown_shard is null under this law. An empty table gives no rows.
    """
    spark = docs.sparkSession
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    own = [c for c in docs.columns if c not in added]
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), (text_size() + 8).alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"), F.coalesce(F.unhex(F.md5(text)), F.lit(b"null")).alias("g"), F.xxhash64(text).alias("u"))
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.first("u").alias("u"))
    groups = saved(groups.select("g", "bytes", "rows", F.pmod("u", F.lit(units)).cast("int").alias("unit")))
    total, count = (x or 0 for x in groups.agg(F.sum("bytes"), F.sum("rows")).first())
    large = F.col("bytes") * units > total
    heavy = [(bytes(r.g), r.bytes) for r in groups.where(large).select("g", "bytes").orderBy("g").collect()]
    light = [(r.unit, r.bytes) for r in groups.where(~large).groupBy("unit").agg(F.sum("bytes").alias("bytes")).orderBy("unit").collect()]
    part = differencing([b for _, b in heavy] + [b for _, b in light], n)
    by_group = spark.createDataFrame([(bytearray(g), p) for (g, _), p in zip(heavy, part, strict=False)], "g binary, heavy int")
    by_unit = spark.createDataFrame([(u, p) for (u, _), p in zip(light, part[len(heavy) :], strict=True)], "unit int, light int")
    out = rows.withColumn("unit", F.pmod("u", F.lit(units)).cast("int")).join(F.broadcast(by_group), "g", "left").join(F.broadcast(by_unit), "unit", "left")
    out = out.select("doc", "size", "text_crc32", F.coalesce("heavy", "light").alias("shard"), F.col("doc.doc_id").cast("string").alias("id"), "g")
    return _numbered(out, max(RANGES, -(-count // RANGE_ROWS))).select(*[F.col(f"doc.`{c}`").alias(c) for c in own], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _numbered(rows: DataFrame, ranges: int) -> DataFrame:
    """slot: counts are taken per shard and hash range, summed, and rows numbered within a range. The counts join rows that are laid out by range already."""
    spot = F.pmod(F.xxhash64("id", "g", F.lit(7)), F.lit(ranges)).cast("int")
    rows = rows.withColumn("range", spot)
    per = rows.groupBy("shard", "range").count().withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    per = per.select("shard", "range", F.coalesce("before", F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("shard", "range").orderBy("id", "g"))
    return rows.withColumn("here", here).join(per, ["shard", "range"]).withColumn("slot", (F.col("before") + F.col("here") - 1).cast("long"))


