"""Array-at-a-time tokenising of Arrow text columns.

The Python operators never loop over words: an Arrow string column is one byte
buffer with offsets, so words of a whole batch are found and hashed with a few
numpy passes. Words are hashed from their bytes after lower-casing A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [(1 << 64) - 1], dtype=np.uint64)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
S32, S29 = np.uint64(32), np.uint64(29)
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 256
#: Batches are cut so that the text worked on at a time stays near this size; one longer text is a batch by itself.
SLICE_BYTES = 4 << 20


def _table(is_word) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        if is_word(b):
            out[b] = b + 32 if 65 <= b <= 90 else b
    return out


#: Words [^\x20\x09-\x0D]+, lower-cased; 0 marks a separator. NUL is a word character, kept apart as byte 255.
SPACED = _table(lambda b: b != 32 and not 9 <= b <= 13)
SPACED[0] = 255
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


class Words(NamedTuple):
    lowered: np.ndarray  # the batch's bytes, mapped by the table; 0 between words
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # row in the batch of each word
    first: np.ndarray  # index of each row's first word, with the total at the end
    hash: np.ndarray


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x * M1
    x ^= x >> S32
    x = x * M2
    x ^= x >> S29
    return x


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> Words:
    low = np.zeros(len(data) + 8, dtype=np.uint8)  # eight more, so that a load at any byte stays inside
    np.take(table, data, out=low[: len(data)])
    inside = low != 0
    prev = np.empty_like(inside)
    prev[0], prev[1:] = False, inside[:-1]
    prev[off[:-1]] = False  # a text's first byte begins a word
    start = np.flatnonzero(inside & ~prev)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    cut = off[1:] - 1
    after[cut[cut >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    first = np.searchsorted(start, off)
    return Words(low, start, end, doc, first, _hash(low, start, end))


def _hash(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - start
    eight = np.ndarray(shape=(max(0, len(low) - 7),), dtype="<u8", buffer=low.data, strides=(1,))
    h = mixed((eight[start] & MASK[np.minimum(n, 8)]) ^ n.astype(np.uint64))
    at, left = np.flatnonzero(n > 8), 8
    while len(at) and left < LONG_WORD:
        h[at] = mixed(h[at] ^ (eight[start[at] + left] & MASK[np.minimum(n[at] - left, 8)]))
        left += 8
        at = at[n[at] > left]
    for i in at:
        h[i] = xxhash.xxh64_intdigest(low[start[i] : end[i]].tobytes(), seed=int(n[i]))
    return h


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE_BYTES of text."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    _, off = buffer(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, in order, and the index of each run's first word. A row of fewer words gives its whole sequence as one run."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    many = max(0, n - k + 1)
    acc = w.hash[:many].copy()
    for j in range(1, k):
        acc = mixed(acc) + w.hash[j : many + j]
    ok = w.doc[:many] == w.doc[k - 1 : many + k - 1]
    at = np.flatnonzero(ok)
    acc = mixed(acc[ok])
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin, size = w.first[short], count[short]
        one = w.hash[begin].copy()
        for j in range(1, k - 1):
            more = size > j
            one[more] = mixed(one[more]) + w.hash[begin[more] + j]
        one = mixed(mixed(one) + size.astype(np.uint64))
        acc, at = np.concatenate([acc, one]), np.concatenate([at, begin])
        order = np.argsort(at, kind="stable")
        acc, at = acc[order], at[order]
    return acc, at


def distinct_by_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values sorted and made distinct within each run bounds[i]:bounds[i+1]; returns them and the new bounds."""
    out = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][bounds[:-1] < len(out)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[bounds]


def long_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
