"""Edit distances and text fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance of lower-cased texts; most + 1 beyond it."""
    a, b = a.lower(), b.lower()
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def damerau_levenshtein(a: Column, b: Column, most: int = 2) -> Column:
    """osa() by Arrow batches; Spark has no built-in with transpositions."""

    @F.pandas_udf(T.IntegerType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa(p, q, most) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


@F.pandas_udf(T.LongType())
def simhash_text(text: pd.Series) -> pd.Series:
    """64-bit SimHash of the words of a text, in Arrow batches: bit b is set if more words' 8-byte BLAKE2 hashes have it than not. 0 without words."""
    cache: dict[str, bytes] = {}

    def hashed(w: str) -> bytes:
        if (h := cache.get(w)) is None:
            h = cache[w] = hashlib.blake2b(w.encode(), digest_size=8).digest()
        return h

    def one(s: str | None) -> int:
        words = (s or "").lower().split()
        if not words:
            return 0
        bits = np.unpackbits(np.frombuffer(b"".join(map(hashed, words)), dtype=np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return int(np.packbits(2 * bits.sum(0) > len(words), bitorder="little").view("<i8")[0])

    return text.map(one).astype("int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
