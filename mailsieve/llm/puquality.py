"""Quality by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; unlabelled text is a sample of all documents, good and bad. A linear
model over shape features is fitted by the non-negative unbiased risk: with class prior p, p R+(positives) + max(0,
R-(unlabelled) - p R-(positives)); when the part in max() turns negative, steps go against it. Labels of bad quality are
not used. The prior comes from the data: bad text hardly scores above the positives' median under a first model of positive
against unlabelled, so twice the share of unlabelled text above it is the share of good text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .storage import bounded_arrow
from .toxic import fold, logistic

#: Rows to fit on, at most about so many of either kind.
SAMPLE = 10000
THRESHOLD = 0.3
STEPS, RATE = 800, 0.05
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91] = 1  # capitals
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#*$%&|<>{}[]=~^_\\/@+`"]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[128:] = 7
_CLASS[[9, 10, 11, 12, 13, 32]] = 8
NAMES = ["words", "word_length", "capitals", "digits", "symbols", "marks", "shouts", "foreign", "distinct_words", "distinct_threes", "top_word", "lines"]


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Shape of each text, NAMES as columns; all 0 for a text without words."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    w = vec.words(data, off, vec.SPACED)
    count = np.diff(w.first)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    row = np.repeat(np.arange(n), np.diff(off))
    by = np.bincount(row * 9 + _CLASS[data], minlength=n * 9).reshape(n, 9)[full]
    lines = np.bincount(row[data == 10], minlength=n)[full] + 1
    size, words = np.maximum(by[:, 1:8].sum(1), 1), count[full]
    threes, at = vec.windows(w, 3)
    distinct3, b3 = vec.distinct_by_row(threes, np.searchsorted(at, w.first))
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
    runs = np.diff(np.append(new, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[new], runs)
    letters = np.maximum(by[:, 1] + by[:, 2], 1)
    out[full] = np.column_stack([
        np.log1p(words), size / words, by[:, 1] / letters, by[:, 3] / size, np.log1p(100 * by[:, 4] / size), by[:, 5] / words, np.log1p(10 * by[:, 6] / words), by[:, 7] / size,
        np.bincount(d[new], minlength=n)[full] / words, np.diff(b3)[full] / np.maximum(words - 2, 1), top[full] / words, np.log1p(words / lines),
    ])
    return out


def _expanded(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / scale, -6, 6)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def fit(pos: np.ndarray, unl: np.ndarray) -> dict:
    """Weights by the non-negative risk with logistic loss, and the class prior."""
    both = np.vstack([pos, unl])
    centre, scale = both.mean(0), both.std(0) + 1e-9
    p, u = _expanded(pos, centre, scale), _expanded(unl, centre, scale)
    c, s, w = logistic(np.vstack([p, u])[:, :-1], np.concatenate([np.ones(len(p)), np.zeros(len(u))]))
    g = lambda x: (x[:, :-1] - c) / s @ w[:-1]
    prior = float(np.clip(2 * np.mean(g(u) > np.median(g(p))), 0.05, 0.98))
    theta, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    for t in range(1, STEPS + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ theta, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ theta, -30, 30)))
        up = -prior * (p * (1 - sp)[:, None]).mean(0)  # of p R+
        down = (u * su[:, None]).mean(0) - prior * (p * sp[:, None]).mean(0)
        risk = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
        grad = (up + down if risk >= 0 else -down) + 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"centre": centre, "scale": scale, "theta": theta, "prior": prior}


def probability(x: np.ndarray, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_expanded(x, model["centre"], model["scale"]) @ model["theta"], -30, 30)))


def _mapper(model=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vec.slices(whole, "text"):
                x = features(*vec.buffer(batch.column(0)))
                new = pa.array(probability(x, model)) if model else pa.array(x.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], new], names=[*batch.schema.names[1:], "score" if model else "x"])

    return run


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on) for every row of docs.

    Only text is scored. Positives are at most `sample` ids with quality 1 outside the held-out fold, the first by hash;
    unlabelled text is about `sample` rows outside it, chosen by hash from all. Texts without words score as such a text does
    under the model. Without a positive label or a document outside the held-out fold, every score is 0.5. Empty tables give no rows.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = fold(F.col("doc_id")) != 0
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y = 1 AND doc_id IS NOT NULL").where(train).select("doc_id").distinct()
    few = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = lambda df: np.array([r.x for r in df.select("text").mapInArrow(_mapper(), "x array<double>").collect()]).reshape(-1, len(NAMES))
    positives = rows(text.join(F.broadcast(few), "doc_id"))
    share = min(1.0, sample / max(1, docs.count()))
    unlabelled = rows(text.where(train & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))))
    if not len(positives) or not len(unlabelled):
        scored = text.select("doc_id", F.lit(0.5).alias("score"))
    else:
        scored = text.select("text", "doc_id").mapInArrow(_mapper(fit(positives, unlabelled)), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
