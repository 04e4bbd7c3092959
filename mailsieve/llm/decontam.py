"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words are counted over all documents.
2. TF-IDF passages (all benchmark passages and all windows of all documents) span a latent space, found by a distributed
   randomised SVD. The windows, of which there may be billions, enter by a sketch: each is added, by a random sign, to one of
   2 (RANK + OVERSAMPLE) rows, so that the rows' second moments are the windows' in expectation. The sketch is summed in whole
   numbers, so the rows' order and parts don't change it. The power iteration then runs on it and the benchmark's passages.
3. Every window of every document is compared with the benchmark passages of its length by cosine in that space. Windows that
   can't hold a leak aren't projected: a leak has PARAPHRASE of an item's words, so of its rarest words (the share that may
   be missing and NEED more) at least NEED must stand near each other. So a count of rare words decides which windows
   the latent space is asked about; it follows from the last step's bounds and rules out nothing that this would accept.
4. A candidate is a leak if the longest common subsequence of the item and the place covers nearly all of the item, or a
   smaller part of it together with the item's answer (its last sentence): a paraphrase.

The benchmark is the query set, taken in blocks of BLOCK items, of which PASS are searched for in one pass over the documents, so
what is broadcast is bounded. Documents aren't shuffled.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .storage import bounded_arrow

BLOCK, PASS = 1000, 4
#: Windows step by STRIDE words; they and the benchmark's passages are of these lengths.
STRIDE, LENGTHS = 8, (16, 32, 64)
RANK, OVERSAMPLE, ITERATIONS = 256, 16, 3
#: Weights are rounded to this part of a unit vector in the sketch of the documents' windows.
UNIT = 4096
MIN_COSINE = 0.4
#: Of an item's rarest words, so many must stand near each other for the item to be looked for there.
NEED = 8
#: Share of the item's words in the common subsequence: alone, or with at least half of its answer.
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.5


class Item(NamedTuple):
    item_id: int
    words: np.ndarray
    answer: np.ndarray


class Model(NamedTuple):
    vocab: np.ndarray  # sorted word hashes
    idf: np.ndarray
    other: float  # idf of words outside
    basis: np.ndarray  # latent vectors of the words, float32
    passages: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> unit latent vectors, item index
    items: list[Item]
    cosine: float
    rare: tuple[np.ndarray, np.ndarray]  # for each word, items that it is a rare word of: bounds and items
    need: np.ndarray  # rare words that a leak of each item surely has


def hashed(texts: list[str]) -> list[np.ndarray]:
    data, off = vec.buffer(pa.array(texts, pa.string()))
    w = vec.words(data, off, vec.ALNUM)
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def answer_of(text: str) -> str:
    """What follows the last question mark or `answer:`, else the last sentence."""
    parts = [x for x in re.split(r"(?i)\banswer\s*:|\?", text) if re.search(r"\w", x)]
    if len(parts) > 1:
        return parts[-1]
    parts = [x for x in re.split(r"(?<=[.!])\s+|\n", text) if re.search(r"\w", x)]
    return parts[-1] if parts else ""


def lookup(vocab: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index in the sorted vocab, -1 for others."""
    at = np.searchsorted(vocab, h)
    at[at == len(vocab)] = 0
    return np.where(vocab[at] == h, at, -1)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each element of a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for x in b.tolist():
        if m := masks.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _counter(vocab):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, n = vocab.value, None, 0
        total = np.zeros(len(words), dtype=np.int64)
        for whole in batches:
            for batch in vec.slices(whole, "text"):
                data, off = vec.buffer(batch.column(0))
                w = vec.words(data, off, vec.ALNUM)
                at = lookup(words, w.hash)
                each = np.unique((w.doc[at >= 0] * len(words) + at[at >= 0]))
                total += np.bincount(each % len(words), minlength=len(words))
                n += len(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["word", "n"])

    return count


def _windowed(w: vec.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of every block of STRIDE words, and the row of each block."""
    pos = np.arange(len(w.hash)) - w.first[w.doc]
    begin = np.flatnonzero(pos % STRIDE == 0)
    return begin, w.doc[begin]


def _sketcher(shared, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, idf, other = shared.value
        total = np.zeros(rows * len(vocab), dtype=np.int64)
        for whole in batches:
            for batch in vec.slices(whole, "text"):
                w = vec.words(*vec.buffer(batch.column(0)), vec.ALNUM)
                if not len(w.hash):
                    continue
                at = lookup(vocab, w.hash)
                known = at >= 0
                weight = np.where(known, idf[at], other)
                # windows of LENGTHS[1] words side by side, a shorter one at a text's end
                first = np.concatenate([[0], np.cumsum(-(-np.diff(w.first) // LENGTHS[1]))])
                window = first[w.doc] + (np.arange(len(w.hash)) - w.first[w.doc]) // LENGTHS[1]
                norm = np.sqrt(np.bincount(window, weights=weight**2, minlength=first[-1]))
                doc = np.repeat(np.arange(len(batch)), np.diff(first))
                h = vec.mixed(batch.column(1).to_numpy().view(np.uint64)[doc] + (np.arange(first[-1]) - first[doc]).astype(np.uint64))
                sign = np.where(h >> np.uint64(63), -UNIT, UNIT)
                here = window[known]
                cell = (h % np.uint64(rows)).astype(np.int64)[here] * len(vocab) + at[known]
                np.add.at(total, cell, np.rint(sign[here] * weight[known] / norm[here]).astype(np.int64))
        total = total.reshape(rows, -1)
        some = np.flatnonzero(total.any(axis=1))
        narrow = [x.astype(np.int32) if np.abs(x).max() < 1 << 31 else x for x in total[some]]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([x.itemsize for x in narrow], pa.int32()), pa.array([x.tobytes() for x in narrow], pa.binary())], names=["row", "bytes", "part"])

    return sketch


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each row's parts."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, size, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(part, dtype=f"i{size}")
            if row in total:
                total[row] += x
            else:
                total[row] = x.astype(np.int64)
    for row, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([(x / UNIT).astype(np.float32).tobytes()], pa.binary())], names=["row", "part"])


def _sketch(docs: DataFrame, vocab: np.ndarray, idf: np.ndarray, other: float, rows: int) -> np.ndarray:
    """Rows of random signed sums of the unit TF-IDF vectors of all windows of all documents, by the words of vocab."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab, idf, other))
    # the sign of a window by its row and place, so that windows of copies don't all go the same way
    some = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("h")).where("text IS NOT NULL")
    parts = some.mapInArrow(_sketcher(shared, rows), "row long, bytes int, part binary").repartition(min(rows, 16), "row")
    out = np.zeros((rows, len(vocab)), dtype=np.float32)
    for x in parts.mapInArrow(_added, "row long, part binary").collect():
        out[x.row] = np.frombuffer(x.part, dtype=np.float32)
    shared.unpersist()
    return out


def _products(passages: list[tuple[np.ndarray, int]], idf: np.ndarray, other: float, q: np.ndarray) -> np.ndarray:
    """Sum over passages of a (a' q), a being the passage's unit TF-IDF vector."""
    out = np.zeros_like(q)
    for at, n in passages:
        if len(at):
            norm2 = (idf[at] ** 2).sum() + (n - len(at)) * other**2
            np.add.at(out, at, np.outer(idf[at], (idf[at, None] * q[at]).sum(0) / norm2))
    return out


def _fit(docs: DataFrame, items: list[Item], rank: int, cosine: float) -> Model:
    spark = docs.sparkSession
    sc = spark.sparkContext
    vocab = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(x.words for x in items)]))
    shared = sc.broadcast(vocab)
    text = docs.select(F.col("text").cast("string"))
    df = {r.word: r.n for r in text.mapInArrow(_counter(shared), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = df.pop(-1, 0)
    counts = np.zeros(len(vocab))
    counts[list(df)] = list(df.values())
    idf = np.log((1 + n) / (1 + counts)) + 0.1
    other = float(np.median(idf)) if len(idf) else 1.0
    mine, length, of = [], [], []
    for i, x in enumerate(items):
        size = next((s for s in LENGTHS if len(x.words) <= 1.5 * s), LENGTHS[-1])
        step = range(0, max(1, len(x.words) - size // 2), size) if len(x.words) > 1.5 * size else [0]
        for k in step:
            part = x.words[k : k + size] if len(x.words) > 1.5 * size else x.words
            mine.append((np.searchsorted(vocab, part), len(part)))
            length.append(size)
            of.append(i)
    r = min(rank + OVERSAMPLE, len(vocab))
    corpus_rows = _sketch(docs, vocab, idf, other, 2 * r)
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((len(vocab), r)))[0]
    for _ in range(ITERATIONS):
        corpus = corpus_rows.T @ (corpus_rows @ q)
        own = _products(mine, idf, other, q)
        # both kinds of passages weigh the same in all
        y = own / max(len(mine), 1) + corpus / max(np.abs(corpus).sum(), 1e-12) * np.abs(own).sum() / max(len(mine), 1)
        left, values, _ = np.linalg.svd(y, full_matrices=False)
        q = left
    basis = q[:, :rank].astype(np.float32)
    vectors = np.array([(idf[at, None] * basis[at]).sum(0) for at, _ in mine], dtype=np.float32).reshape(len(mine), basis.shape[1])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    passages = {s: (vectors[[k for k, x in enumerate(length) if x == s]], np.array([of[k] for k, x in enumerate(length) if x == s], dtype=np.int64)) for s in LENGTHS}
    pairs, need = [], []
    for i, x in enumerate(items):
        at = np.searchsorted(vocab, x.words)
        may_miss = int((1 - PARAPHRASE) * len(at) + 1e-9)
        pick = at[np.argsort(counts[at], kind="stable")][: may_miss + NEED]
        need.append(len(pick) - may_miss)
        pairs += [(w, i) for w in sorted(set(pick.tolist()))]
    pairs = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    rare = np.searchsorted(pairs[:, 0], np.arange(len(vocab) + 1)), pairs[:, 1]
    return Model(vocab, idf, other, basis, passages, items, cosine, rare, np.maximum(need, 1))


def _near_rare_words(m: Model, at: np.ndarray, w: vec.Words, begin: np.ndarray) -> dict[int, np.ndarray]:
    """For each window length, the blocks at which a window may begin that holds enough rare words of an item of that length."""
    pos = np.flatnonzero(at >= 0)
    bounds, items = m.rare
    first, n = bounds[at[pos]], bounds[at[pos] + 1] - bounds[at[pos]]
    pos, first = np.repeat(pos, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item = items[first]
    order = np.argsort((w.doc[pos] * len(m.items) + item) * np.int64(len(w.hash) + 1) + pos, kind="stable")
    pos, item = pos[order], item[order]
    last = np.arange(len(pos)) + m.need[item] - 1
    use = np.flatnonzero(last < len(pos))
    last = last[use]
    length = np.array([len(x.words) for x in m.items])
    near = (item[use] == item[last]) & (w.doc[pos[use]] == w.doc[pos[last]]) & (pos[last] - pos[use] <= 2 * length[item[use]] + 2 * STRIDE)
    a, b, item = pos[use][near], pos[last][near], item[use][near]
    out = {}
    for size, (_, of) in m.passages.items():
        mine = np.isin(item, of)
        mark = np.zeros(len(begin) + 1, dtype=np.int64)
        np.add.at(mark, np.searchsorted(begin, a[mine] - length[item[mine]] - STRIDE), 1)
        np.add.at(mark, np.searchsorted(begin, np.where(length[item[mine]] > 1.5 * size, b[mine], a[mine]) + STRIDE + 1), -1)
        out[size] = np.cumsum(mark[:-1]) > 0
    return out


def found(m: Model, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
    """Leaks in a batch of texts: (row, item index, cosine, share of the item, share of its answer, first word)."""
    w = vec.words(data, off, vec.ALNUM)
    if not len(w.hash) or not m.items:
        return []
    at = lookup(m.vocab, w.hash)
    known = at >= 0
    weight = np.where(known, m.idf[at], m.other)
    begin, doc = _windowed(w)
    last = np.searchsorted(doc, doc, side="right")  # end of each block's row
    near = _near_rare_words(m, at, w, begin)
    tried: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for size, (vectors, of) in m.passages.items():
        if not len(of):
            continue
        to = np.minimum(np.arange(len(begin)) + size // STRIDE, last)
        pick = np.flatnonzero(near[size])
        for chunk in np.array_split(pick, len(pick) // 4096 + 1):
            if not len(chunk):
                continue
            need = np.unique(np.concatenate([np.minimum(chunk + k, to[chunk] - 1) for k in range(size // STRIDE)]))
            spans = [(begin[b], begin[b + 1] if b + 1 < len(begin) else len(w.hash)) for b in need]
            z = np.zeros((len(need) + 1, m.basis.shape[1]), dtype=np.float32)
            a, b = (np.array(x) for x in zip(*spans, strict=True))
            for j in range(STRIDE):  # the j-th word of every block
                rows = np.flatnonzero(a + j < b)
                rows = rows[known[a[rows] + j]]
                z[rows] += m.basis[at[a[rows] + j]] * weight[a[rows] + j, None].astype(np.float32)
            slot = np.searchsorted(need, chunk)
            total = np.zeros((len(chunk), z.shape[1]), dtype=np.float32)
            for k in range(size // STRIDE):
                here = chunk + k < to[chunk]
                total += np.where(here[:, None], z[np.where(here, np.minimum(slot + k, len(need) - 1), len(need))], 0)
            # both sides by their norms within the space: what it doesn't hold of a window mustn't count against it
            cos = total @ vectors.T / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
            for i, j in zip(*np.nonzero(cos >= m.cosine), strict=True):
                tried.setdefault((int(doc[chunk[i]]), int(of[j])), []).append((float(cos[i, j]), int(begin[chunk[i]])))
    out = []
    for (row, i), places in sorted(tried.items()):
        x, best = m.items[i], None
        done = set()
        for cos, at_word in sorted(places, reverse=True):
            if any(abs(at_word - d) < STRIDE for d in done):
                continue
            done.add(at_word)
            n = len(x.words)
            a, b = max(w.first[row], at_word - n // 2 - STRIDE), min(w.first[row + 1], at_word + n + n // 2 + STRIDE)
            share = lcs(x.words, w.hash[a:b]) / n
            if share >= PARAPHRASE:
                answer = lcs(x.answer, w.hash[a:b]) / len(x.answer) if len(x.answer) else 0.0
                if (share >= VERBATIM or answer >= ANSWER) and (best is None or share > best[1]):
                    best = (cos, share, answer, int(a - w.first[row]))
                    if share == 1.0:
                        break
        if best:
            out.append((row, i, *best))
    return out


def _passes(*args) -> Iterator[list]:
    """The models of all blocks, PASS at a time."""
    models = _models(*args)
    while some := list(itertools.islice(models, PASS)):
        yield some


def _models(docs: DataFrame, benchmark: DataFrame, rank: int, cosine: float) -> Iterator:
    spark = docs.sparkSession
    bounded_arrow(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    blocks = -(-items.count() // BLOCK)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        words, answers = hashed([r.text for r in rows]), hashed([answer_of(r.text) for r in rows])
        some = [Item(r.item_id, w, a) for r, w, a in zip(rows, words, answers, strict=True) if len(w)]
        if some:
            yield spark.sparkContext.broadcast(_fit(docs, some, rank, cosine))


def _searcher(models: list):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vec.slices(whole, "text"):
                for model in models:
                    m = model.value
                    rows = found(m, *vec.buffer(batch.column(0)))
                    ids = batch.column(1).take(pa.array([r[0] for r in rows], pa.int64()))
                    cols = list(zip(*rows, strict=True)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([ids, pa.array([m.items[i].item_id for i in cols[1]], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int64())], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"])

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, first_word) for every benchmark item found in a row of docs.

    Null and empty texts hold nothing; null or wordless items are found nowhere. Repeated rows are each returned. Empty
    tables give no rows.
    """
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long"
    rows = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"))
    out = docs.sparkSession.createDataFrame([], schema)
    for models in _passes(docs, benchmark, rank, cosine):
        out = out.union(rows.mapInArrow(_searcher(models), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs in which no benchmark item is found, all columns as they were."""

    def keeper(models, at):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in vec.slices(whole, "text"):
                    hit = {r[0] for model in models for r in found(model.value, *vec.buffer(batch.column(at).cast(pa.string())))}
                    yield batch.filter(pa.array([i not in hit for i in range(len(batch))]))

        return keep

    how = {"rank": RANK, "cosine": MIN_COSINE} | how
    out = docs
    for models in _passes(docs, benchmark, how["rank"], how["cosine"]):
        out = out.mapInArrow(keeper(models, docs.columns.index("text")), docs.schema)
    return out
