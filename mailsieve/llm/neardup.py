"""MinHash near-duplicate detection whose banded candidates are checked by odd sketches, then on the full sets.

1. Each text becomes its set of distinct shingles. From the set come N_HASHES MinHash samples; groups of ROWS samples are
   hashed to band keys, and all samples are folded into a bitmap by parity (the odd sketch).
2. Texts of equal sets form a class; only classes go on, so copies cost one map-side combined sum.
3. Classes that share a band key are candidates. A shared key with many classes isn't expanded into pairs: its classes are
   first compared with one of them, its hub, the class that meets most others; a group of near copies is joined so.
   The classes that share a key with a class of another group, after that, are compared by rare shingles: two sets
   that reach the threshold share one of the rarest quarter of the shingles of either, in one common order by rarity. So texts from one
   template, whose rare shingles are their own, make no pairs however many share its band keys, and no link between such
   classes is lost, whatever their band keys say.
4. A pair is dropped if the odd sketches say that its similarity is surely under the threshold, else its sets are intersected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vec
from .components import components
from .storage import bounded_arrow, saved

SHINGLE, PERCENT = 5, 75
#: A pair of similarity 0.75 shares no band key with probability (1 - 0.75**5)**40 < 2e-5.
BANDS, ROWS = 40, 5
#: All samples go into the sketch, the first BANDS * ROWS into the keys.
N_HASHES, SKETCH_BITS = 512, 2048
SIGNATURE = "d1 long, d2 long, n_shingles long, bands array<long>, sketch array<long>"

_r = np.random.default_rng(20240229)
MUL = (_r.integers(0, 1 << 31, N_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
ADD = _r.integers(0, 1 << 32, N_HASHES, dtype=np.uint32)
BLOCK = 512


def minhash(values: np.ndarray) -> np.ndarray:
    """N_HASHES samples of a non-empty set of 64-bit hashes."""
    x = (values >> vec.S32).astype(np.uint32)
    out = np.full(N_HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), BLOCK):
        np.minimum(out, np.min(x[i : i + BLOCK, None] * MUL + ADD, axis=0), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """A bitmap for each row of samples: bit b is the parity of the samples that hash to b."""
    n = len(samples)
    which = np.arange(samples.shape[1], dtype=np.uint64) << vec.S32
    bit = (vec.mixed(samples.astype(np.uint64) | which) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount((bit + SKETCH_BITS * np.arange(n)[:, None]).ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.reshape(n, SKETCH_BITS).astype(np.uint8), axis=1).view("<i8")


def most_odd_bits(percent: int = PERCENT) -> int:
    """XOR bits that a pair of the threshold's similarity exceeds with a probability under 1e-5: 4.5 standard deviations over the mean."""
    p, n = 1 - percent / 100, SKETCH_BITS
    apart = N_HASHES * p
    mean = n / 2 * (1 - math.exp(-4 * apart / n))
    samples = N_HASHES * p * (1 - p) * (2 * math.exp(-4 * apart / n)) ** 2
    folding = n / 4 * (1 - math.exp(-8 * apart / n)) - 4 * apart * math.exp(-8 * apart / n) / 2
    return math.ceil(mean + 4.5 * math.sqrt(samples + max(folding, 0)))


def similarity_from_bits(bits: Column) -> Column:
    """The odd sketch's estimate of the Jaccard similarity."""
    return F.greatest(F.lit(0.0), 1 + F.log(F.greatest(F.lit(1e-9), 1 - 2 * bits / SKETCH_BITS)) * SKETCH_BITS / (4 * N_HASHES))


def _sets(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    data, off = vec.buffer(batch.column(0))
    w = vec.words(data, off, vec.SPACED)
    h, at = vec.windows(w, shingle)
    return vec.distinct_by_row(h, np.searchsorted(at, w.first))


def _digest(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: sums of two mixings of its hashes."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((2, len(bounds) - 1), dtype=np.uint64)
    for k, seed in enumerate((np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93))):
        if len(values):
            out[k, full] = vec.mixed(np.add.reduceat(vec.mixed(values ^ seed), bounds[:-1][full]))
    return out[0].view(np.int64), out[1].view(np.int64)


def _signer(shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vec.slices(whole, "text"):
                values, bounds = _sets(batch, shingle)
                n = len(batch)
                size = np.diff(bounds)
                samples = np.zeros((n, N_HASHES), dtype=np.uint32)
                for i in np.flatnonzero(size):
                    samples[i] = minhash(values[bounds[i] : bounds[i + 1]])
                d1, d2 = _digest(values, bounds)
                keys = np.zeros((n, BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for j in range(ROWS):
                    keys = vec.mixed(keys ^ samples[:, j : BANDS * ROWS : ROWS].astype(np.uint64))
                none = pa.array(size == 0)
                null = lambda a, t: pa.compute.if_else(none, pa.scalar(None, t), a)  # noqa: B023, E731
                longs = pa.list_(pa.int64())
                rows = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(m).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], null(pa.array(d1), pa.int64()), null(pa.array(d2), pa.int64()), pa.array(size.astype(np.int64)), null(rows(keys), longs), null(rows(odd_sketch(samples)), longs)],
                    names=[*batch.schema.names[1:], "d1", "d2", "n_shingles", "bands", "sketch"],
                )

    return sign


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the text's hash t and SIGNATURE of every row; a text without words has nulls and size 0."""
    bounded_arrow(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t")).mapInArrow(_signer(shingle), f"doc_id long, t long, {SIGNATURE}")


def _set_rows(shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vec.slices(whole, "text"):
                values, bounds = _sets(batch, shingle)
                d1, d2 = _digest(values, bounds)
                mine = (d1 == batch.column(2).to_numpy()) & (d2 == batch.column(3).to_numpy())
                out = pa.RecordBatch.from_arrays([batch.column(1), vec.long_array(values, bounds)], names=["nid", "shingles"])
                yield out.filter(pa.array(mine))

    return sets


def _bits_apart(a: str, b: str) -> Column:
    return sum(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64))


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those that sizes and odd sketches leave possible, with the sizes na and nb."""
    s = lambda k: sketches.select(F.col("nid").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n_shingles").alias(f"n{k}"))
    close = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_bits_apart("sa", "sb") <= most_odd_bits(percent))
    return pairs.join(s("a"), "a").join(s("b"), "b").where(close).select("a", "b", "na", "nb")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, na, nb), those whose sets reach the threshold."""
    t = lambda k: sets.select(F.col("nid").alias(k), F.col("shingles").alias(f"t{k}"))
    both = pairs.join(t("a"), "a").join(t("b"), "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _rare(able: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(g, nid, label, size, rank): of each class in able (nid, label), those of its rarest shingles that a class of another label may meet it at.

    rank counts all of a class's shingles from 1, the rarest first: those of no other class, then by the number of classes. A
    set of n shingles shares at least ceil(percent n / 100) with any set that reaches the threshold, so one of its
    first n - ceil(percent n / 100) + 1.
    """
    each = sets.join(able, "nid").select("nid", "label", F.size("shingles").alias("size"), F.explode("shingles").alias("g"))
    twice = saved(each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    each = each.join(twice, "g")
    own = Window.partitionBy("nid")
    each = each.select("g", "nid", "label", "size", (F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "g"))).cast("int").alias("rank"))
    each = saved(each.where(F.col("rank") <= F.col("size") - F.ceil(percent * F.col("size") / 100) + 1))
    met = saved(each.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("g"))
    return saved(each.join(met, "g"))


def _met(rare: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of classes of different labels that may reach the threshold by the rank of a shingle that they share.

    The smaller of two sets shares 2 percent / (100 + percent) of its own shingles if they reach it, so its first ones are
    fewer still. Where the first shingle that both have stands, what is left of either must hold all others that they share.
    """
    side = lambda k: rare.select("g", F.col("nid").alias(k), F.col("label").alias(f"l{k}"), F.col("size").alias(f"n{k}"), F.col("rank").alias(f"r{k}"))
    small, large = side("x"), side("y")
    small = small.where(F.col("rx") <= F.col("nx") - F.ceil(2 * percent * F.col("nx") / (100 + percent)) + 1)
    order = F.struct("nx", "x") < F.struct(F.col("ny").alias("nx"), F.col("y").alias("x"))
    left = F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry")) + 1
    both = small.join(large, "g").where(order & (F.col("lx") != F.col("ly")) & ((100 + percent) * left >= percent * (F.col("nx") + F.col("ny"))) & (100 * F.col("nx") >= percent * F.col("ny")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Two rows are linked if 100 * |A & B| >= percent * |A | B| for their shingle sets; component_id is the smallest doc_id
    reachable over links. Null or wordless texts have size 0 and are linked with nothing (component_id = doc_id). Repeated
    rows are one class, each row being returned. A row with a null doc_id takes part in links, gets the smallest other
    doc_id of its component (null if there is none) and is kept only if its component has no other id. An empty table
    gives no rows.
    """
    sig = saved(signatures(docs, shingle))
    some = sig.where("d1 IS NOT NULL")
    classes = some.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t")).alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")))
    classes = saved(classes.withColumn("nid", F.monotonically_increasing_id()))
    keys = classes.select("nid", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = saved(keys.join(shared, "key").select("key", "nid", "n"))
    labels = _linked(docs, classes, shared, shingle, percent)
    if labels is None:
        comp = classes.select("d1", "d2", F.col("rep.doc_id").alias("low"))
    else:
        of = classes.select("nid", "d1", "d2", "rep").join(labels, F.col("nid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "nid"))
        # written first, so that the join can split a component of very many classes
        low = saved(of.groupBy("label").agg(F.min("rep.doc_id").alias("low")))
        comp = of.join(low, "label").select("d1", "d2", "low")
    rows = sig.select("doc_id", "n_shingles", "d1", "d2").join(comp, ["d1", "d2"], "left")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked(docs: DataFrame, classes: DataFrame, shared: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """(node, label) for classes with a link; None if no band key is shared."""
    if not shared.limit(1).count():
        return None
    degree = shared.groupBy("nid").agg(F.sum(F.col("n") - 1).alias("degree"))
    wanted = classes.select("nid", "d1", "d2", "rep.doc_id", "rep.t").join(degree.select("nid"), "nid", "left_semi")
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    sets = wanted.join(texts, (wanted["t"] == texts["t"]) & wanted["doc_id"].eqNullSafe(texts["doc_id"])).select("text", "nid", "d1", "d2")
    sets = saved(sets.mapInArrow(_set_rows(shingle), "nid long, shingles array<long>").dropDuplicates(["nid"]))
    sketches = classes.select("nid", "sketch", "n_shingles", "bands").join(degree.select("nid"), "nid", "left_semi")
    rows = saved(shared.select("key", "nid").join(degree, "nid"))
    hubs = saved(rows.groupBy("key").agg(F.max_by("nid", F.struct("degree", "nid")).alias("hub")))
    pairs = rows.join(hubs, "key").where("nid <> hub").select(F.least("nid", "hub").alias("a"), F.greatest("nid", "hub").alias("b")).distinct()
    good = saved(_confirmed(_sketched(pairs, sketches, percent), sets, percent))

    def labelled(links: DataFrame) -> DataFrame:
        return saved(degree.select("nid").join(components(links), F.col("nid") == F.col("node"), "left").select(F.col("nid").alias("node"), F.coalesce("label", "nid").alias("label")))

    labels = labelled(good)
    at = rows.join(labels, F.col("nid") == F.col("node")).select("key", "nid", "label")
    mixed = saved(at.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"))
    able = saved(at.join(mixed, "key").select("nid", "label").distinct())
    pairs = _met(_rare(able, sets, percent), percent)
    more = saved(_confirmed(_sketched(pairs, sketches, percent), sets, percent))
    return labelled(good.union(more)) if more.limit(1).count() else labels


def representatives(docs: DataFrame, **how: int) -> DataFrame:
    """One row of docs for each group, the one of smallest doc_id, all columns as they were.

    Of rows that repeat a doc_id with the same text one stays; rows without a doc_id stay if no other id is in their group,
    once for each text.
    """
    kept = saved(near_duplicates(docs, **how).where("kept").select(F.col("doc_id").alias("kept id")))
    ids = kept.distinct()
    out = docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(F.col("kept id")), "left_semi")
    return out if kept.count() == ids.count() else out.dropDuplicates(["doc_id", "text"])
