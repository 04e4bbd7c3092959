"""Toxicity by class-conditional Kneser-Ney models of symbols and of expressions.

Symbols: every word is a sequence of symbols (a letter, a digit class, a byte class) with an end mark. For each class, toxic
and ordinary, five-symbol counts give p(symbol | four before) with Kneser-Ney discounting; both classes back off to the same
lower orders, whose continuation counts (distinct symbols before) are shared. So new words are scored by their parts.

Expressions: words and pairs of words in a row, with the exact number of toxic and of ordinary texts that hold them (their
continuation counts). Each class discounts its counts and gives what is left by the counts of both classes together: p(e) =
(max(c - d, 0) + d T s(e)) / N. So an expression seen once hardly tells the classes apart, one that many toxic texts share does,
and it may be made of ordinary words. The table of expressions grows with the input: it is counted by shuffle, with sums
before it, written, and joined to documents by key. Only a bit set of fixed size, which says what surely isn't in the table,
is broadcast, so that few expressions of a document need the join; a fuller bit set lets more through and loses nothing.

A text's evidence is the log-likelihood ratio of its strongest word by symbols and the likelihood ratio of its strongest
expression by the table: the ratio of a whole text, though normalised by its length (it is returned as per_symbol), drowns one
expression among thousands of words. A logistic curve, fitted on rows that the counts don't hold, turns both into a probability.

All labelled rows outside the held-out fifth and the calibration fifth are counted, without a cap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .storage import bounded_arrow, saved

#: Symbols: 0 a word's edge, 1-26 letters, 27 digits, 28-31 other bytes by their low bits. (Expressions are told apart by all their bytes.)
SYMBOL = np.zeros(256, dtype=np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[48:58] = 27
SYMBOL[128:] = 28 + np.arange(128) % 4
#: Contexts of four symbols are hashed to this many rows of 32 symbols.
CONTEXTS = 1 << 17
CHUNK = 1 << 16
#: Rows to fit the two-feature logistic curve: at most this many.
CALIBRATION_ROWS = 20000
SHARED_DISCOUNT = 0.75
#: Bits of the set of expressions that the table may hold.
BITS = 1 << 26
#: Expressions are in the table from this log-likelihood ratio on; weaker ones count as this.
LEAST_RATIO = 1.0
#: A class loses one text of each count, so an expression of a single text is left to the shared counts at every size of the input.
DISCOUNT = 1.0
EVIDENCE = ["per_symbol", "strongest", "expression"]
CURVE = EVIDENCE[1:]


def fold(col: Column) -> Column:
    """crc32 of the id's text mod 5; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")) % 5


def spelled(w: vec.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words `which`: exact code of every five symbols in a row, its hashed bucket, and each word's first position."""
    start, n = w.start[which], w.end[which] - w.start[which]
    first = np.concatenate([[0], np.cumsum(n + 5)])  # four edges before a word, one after
    syms = np.zeros(first[-1], dtype=np.int64)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    syms[np.repeat(first[:-1] + 4, n) + inner] = SYMBOL[w.lowered[np.repeat(start, n) + inner]]
    ends = np.cumsum(n + 1)
    at = np.repeat(first[:-1] + 4, n + 1) + (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - 1, n + 1))
    code = syms[at - 4] << 20 | syms[at - 3] << 15 | syms[at - 2] << 10 | syms[at - 1] << 5 | syms[at]
    row = (vec.mixed((code >> 5).astype(np.uint64)) >> vec.S32).astype(np.int64) % CONTEXTS
    return code, row * 32 + syms[at], ends - n - 1


def _distinct(w: vec.Words) -> tuple[np.ndarray, np.ndarray]:
    _, which, back = np.unique(w.hash, return_index=True, return_inverse=True)
    return which, back


def _pack(kind: int, x: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    for i in range(0, len(x), CHUNK):
        if (part := x[i : i + CHUNK]).any():
            yield kind, i // CHUNK, zlib.compress(part.tobytes(), 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, CONTEXTS * 32), dtype=np.int64)
    seen = np.zeros(1 << 25, dtype=bool)
    for whole in batches:
        for batch in vec.slices(whole, "text"):
            data, off = vec.buffer(batch.column(0))
            w = vec.words(data, off, vec.ALNUM)
            if not len(w.hash):
                continue
            label = batch.column(1).to_numpy()[w.doc]
            which, back = _distinct(w)
            code, bucket, first = spelled(w, which)
            size = np.diff(np.append(first, len(code)))
            seen[code] = True
            for y in (0, 1):
                times = np.repeat(np.bincount(back[label == y], minlength=len(which)), size)
                counts[y] += np.bincount(bucket, weights=times, minlength=counts.shape[1]).astype(np.int64)
    rows = [*_pack(0, counts[0]), *_pack(1, counts[1]), *_pack(2, np.packbits(seen))]
    kind, chunk, blob = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(chunk, pa.int32()), pa.array(blob, pa.binary())], names=["kind", "chunk", "blob"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, chunk, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(zlib.decompress(blob), dtype=np.uint8 if kind == 2 else np.int64)
            if (old := total.get((kind, chunk))) is None:
                total[kind, chunk] = x.copy()
            elif kind == 2:
                old |= x
            else:
                old += x
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([zlib.compress(total[k].tobytes(), 1) for k in keys], pa.binary())], names=["kind", "chunk", "blob"])


class Model:
    """The shared lower orders as probabilities, and each class's counts."""

    def __init__(self, counts: np.ndarray, seen: np.ndarray):
        d = SHARED_DISCOUNT
        left = seen.reshape(32, 1 << 20).sum(0).astype(np.float64)  # distinct symbols before four symbols
        tables = [left]
        while len(tables[-1]) > 32:
            tables.append((tables[-1] > 0).reshape(32, -1).sum(0).astype(np.float64))
        p = np.full(1, 1 / 32)
        for t in reversed(tables):
            t = t.reshape(-1, 32)
            total, types = t.sum(1, keepdims=True), (t > 0).sum(1, keepdims=True)
            low = np.tile(p.reshape(-1, 32), (32, 1))[: len(t)] if p.size > 1 else np.full_like(t, 1 / 32)
            p = np.where(total > 0, (np.maximum(t - d, 0) + d * types * low) / np.maximum(total, 1), low).reshape(-1)
        self.low = p.astype(np.float32)  # by the last four symbols
        self.counts = counts.astype(np.float32)
        by = counts.reshape(2, CONTEXTS, 32)
        self.total, self.types = by.sum(2).astype(np.float32), (by > 0).sum(2).astype(np.float32)
        ones, twos = (counts == 1).sum(1), (counts == 2).sum(1)
        self.discount = (ones / np.maximum(ones + 2 * twos, 1)).clip(0.1, 0.95).astype(np.float32)

    def log_p(self, y: int, bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
        row, d = bucket >> 5, self.discount[y]
        total = self.total[y][row]
        p = (np.maximum(self.counts[y][bucket] - d, 0) + d * self.types[y][row] * low) / np.maximum(total, 1)
        return np.log(np.where(total > 0, p, low))

    def evidence(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each text: log-likelihood ratio a symbol, the largest of a word, and the mean of the positive part of words over 2."""
        w = vec.words(data, off, vec.ALNUM)
        out = np.zeros((len(off) - 1, 2))
        if not len(w.hash):
            return out
        which, back = _distinct(w)
        code, bucket, first = spelled(w, which)
        low = self.low[code & 0xFFFFF]
        ratio = np.add.reduceat(self.log_p(1, bucket, low) - self.log_p(0, bucket, low), first)
        size = np.diff(np.append(first, len(code)))
        full = np.flatnonzero(np.diff(w.first))
        at = w.first[full]
        out[full, 0] = np.add.reduceat(ratio[back], at) / np.add.reduceat(size[back], at)
        out[full, 1] = np.maximum.reduceat(ratio[back], at)
        return out


def _events(batch: pa.RecordBatch, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct expressions of each text (the lowest bit says whether it is a pair) that bits may hold, and their rows."""
    w = vec.words(*vec.buffer(batch.column(0)), vec.ALNUM)
    pairs, at = vec.windows(w, 2)
    two = np.diff(w.first)[w.doc[at]] >= 2 if len(at) else np.zeros(0, dtype=bool)
    pairs, of = pairs[two] | np.uint64(1), w.doc[at[two]]
    key, row = np.concatenate([w.hash & ~np.uint64(1), pairs]), np.concatenate([w.doc, of])
    if bits is not None:
        use = bits[(key >> np.uint64(3)) % np.uint64(BITS // 8)] >> (key >> np.uint64(61)).astype(np.uint8) & 1 == 1
        key, row = key[use], row[use]
    order = np.argsort(row, kind="stable")
    key, bounds = vec.distinct_by_row(key[order], np.searchsorted(row[order], np.arange(len(batch) + 1)))
    return key, np.repeat(np.arange(len(batch)), np.diff(bounds))


def _lister(bits=None):
    """The other columns of each row, once for each expression, with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vec.slices(whole, "text"):
                key, row = _events(batch, bits.value if bits else None)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns[1:]), pa.array(key.view(np.int64))], names=[*batch.schema.names[1:], "key"])

    return run


def _bit_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for batch in batches:
        key = batch.column(0).to_numpy().view(np.uint64)
        np.bitwise_or.at(bits, ((key >> np.uint64(3)) % np.uint64(BITS // 8)).astype(np.int64), np.uint8(1) << (key >> np.uint64(61)).astype(np.uint8))
    rows = list(_pack(2, bits))
    kind, chunk, blob = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(chunk, pa.int32()), pa.array(blob, pa.binary())], names=["kind", "chunk", "blob"])


def _bit_set(keys: DataFrame):
    """A broadcast set of BITS bits that has those of all keys."""
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    blobs = keys.select("key").mapInArrow(_bit_chunks, "kind int, chunk int, blob binary").repartition(64, "kind", "chunk").mapInArrow(_merge, "kind int, chunk int, blob binary")
    for r in blobs.collect():
        x = np.frombuffer(zlib.decompress(r.blob), dtype=np.uint8)
        bits[r.chunk * CHUNK : r.chunk * CHUNK + len(x)] = x
    return keys.sparkSession.sparkContext.broadcast(bits)


def ratio(c1: Column, c0: Column, n1: Column, n0: Column, t1: Column, t0: Column, d: float = DISCOUNT) -> Column:
    """Log-likelihood ratio of an expression that c1 toxic and c0 ordinary texts hold, n and t being all counts and all expressions of a class."""
    share = (c1 + c0) / (n1 + n0)
    p = lambda c, n, t: (F.greatest(c - d, F.lit(0.0)) + d * t * share) / F.greatest(n, F.lit(1))
    return F.log(p(c1, n1, t1)) - F.log(p(c0, n0, t0))


def expressions(rows: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """(key, ratio) of the words and pairs of the texts of rows (text, y) whose ratio is `least` or more, which only those seen in a toxic text can reach.

    Ordinary texts list only what toxic ones may hold. Sums are taken before the shuffle, so a very common expression is one
    row a task. The numbers of different expressions of the classes, which enter smoothing only, are estimated by
    HyperLogLog over all rows.
    """
    pair = F.col("key").bitwiseAND(1).alias("pair")
    all_ = rows.select("text", "y").mapInArrow(_lister(), "y int, key long")
    sums = all_.groupBy(pair).agg(*(F.count_if(F.col("y") == y).alias(f"n{y}") for y in (0, 1)), *(F.approx_count_distinct(F.when(F.col("y") == y, F.col("key")), 0.01).cast("double").alias(f"t{y}") for y in (0, 1)))
    counted = lambda y, bits: rows.where(F.col("y") == y).select("text").mapInArrow(_lister(bits), "key long").groupBy("key").agg(F.count("*").alias(f"c{y}"))
    toxic = saved(counted(1, None))
    both = toxic.join(counted(0, _bit_set(toxic)), "key", "left").select("key", "c1", F.coalesce("c0", F.lit(0)).alias("c0"), pair)
    value = F.lit(None).cast("double")
    for x in sums.collect():  # two rows, words and pairs
        value = F.when(F.col("pair") == x.pair, ratio(F.col("c1"), F.col("c0"), *map(F.lit, (x.n1, x.n0, x.t1, x.t0)))).otherwise(value)
    return saved(both.select("key", value.alias("ratio")).where(F.col("ratio") >= least))


def _strongest(text: DataFrame, table: DataFrame, bits) -> DataFrame:
    """(doc_id, t, ratio): for the texts (text, doc_id, t) that hold an expression of the table, the ratio of the strongest."""
    hits = text.select("text", "doc_id", "t").mapInArrow(_lister(bits), "doc_id long, t long, key long").join(table, "key")
    return hits.groupBy("doc_id", "t").agg(F.max("ratio").alias("ratio"))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: centre, scale and weights (intercept last)."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.eye(a.shape[1]) * 1e-2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T * (p * (1 - p) + 1e-6) @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, w


def _symbols(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vec.slices(whole, "text"):
                x = shared.value.evidence(*vec.buffer(batch.column(0)))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x[:, 0]), pa.array(x[:, 1])], names=[*batch.schema.names[1:], "per_symbol", "strongest"])

    return run


def _counts(rows: DataFrame) -> Model:
    blobs = rows.select("text", "y").mapInArrow(_count, "kind int, chunk int, blob binary").repartition(64, "kind", "chunk").mapInArrow(_merge, "kind int, chunk int, blob binary").collect()
    counts, bits = np.zeros((2, CONTEXTS * 32), dtype=np.int64), np.zeros(1 << 22, dtype=np.uint8)
    for r in blobs:
        x = np.frombuffer(zlib.decompress(r.blob), dtype=np.uint8 if r.kind == 2 else np.int64)
        into = bits if r.kind == 2 else counts[r.kind]
        into[r.chunk * CHUNK : r.chunk * CHUNK + len(x)] = x
    return Model(counts, np.unpackbits(bits))


def _curve(x: list[str], fitted: tuple) -> Column:
    """The logistic curve as a column."""
    centre, scale, w = fitted
    z = sum(((F.col(c) - float(m)) / float(s) * float(v) for c, m, s, v in zip(x, centre, scale, w[:-1], strict=True)), F.lit(float(w[-1])))
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) and EVIDENCE for every row of docs.

    Only text is scored. Labels count where they are 0 or 1; ids labelled twice count twice. Counts come from rows whose fold is
    1, 2 or 3, the curve from at most CALIBRATION_ROWS of fold 4. Without both classes there, scores are 0.5 at no evidence.
    Null and empty texts have no evidence. Empty tables give no rows.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    text = F.col("text").cast("string")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL")
    part = fold(F.col("doc_id"))
    rows = saved(text.where(part.isin(1, 2, 3) & F.col("text").isNotNull()).join(known.where(part.isin(1, 2, 3)).hint("shuffle_hash"), "doc_id").select("text", "y"))
    model = spark.sparkContext.broadcast(_counts(rows))
    table = expressions(rows)
    bits = _bit_set(table)
    few = known.where(part == 4).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS)

    def evidence(some: DataFrame, *more: str) -> DataFrame:
        symbols = some.select("text", "doc_id", "t", *more).mapInArrow(_symbols(model), ", ".join(["doc_id long, t long", *(f"{c} int" for c in more), "per_symbol double, strongest double"]))
        best = _strongest(some, table, bits).select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "ratio")
        both = symbols.join(best, symbols["doc_id"].eqNullSafe(best["d"]) & (symbols["t"] == best["u"]), "left")
        return both.select("doc_id", *more, "per_symbol", "strongest", F.exp(F.coalesce("ratio", F.lit(LEAST_RATIO))).alias("expression"))

    seen = evidence(text.join(F.broadcast(few), "doc_id"), "y")
    seen = np.array([tuple(r) for r in seen.select("y", *CURVE).collect()]).reshape(-1, 1 + len(CURVE))
    plain = np.zeros(2), np.ones(2), np.array([0.1, 0.1, -0.1 * np.exp(LEAST_RATIO)])
    fitted = logistic(seen[:, 1:], seen[:, 0]) if len({*seen[:, 0]}) == 2 else plain
    out = evidence(text).withColumn("score", _curve(CURVE, fitted))
    return out.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *EVIDENCE)
