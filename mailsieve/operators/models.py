"""Scoring by models that are given: any function from a batch of features to probabilities, run by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import url_fusion

NEUTRAL = 0.5


def scored(df: DataFrame, features: list[str], load: Callable[[], Callable[[np.ndarray], np.ndarray]], out: str = "probability") -> DataFrame:
    """df with a probability. load() makes the model once in each Python worker; a batch that it fails on gets the neutral score and degraded = true.

    Equal feature rows of a batch are scored once.
    """
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            x = b[features].astype("float64").to_numpy()
            try:
                each, back = np.unique(np.nan_to_num(x, nan=-1.0), axis=0, return_inverse=True)
                p, bad = np.clip(np.asarray(model(each), dtype=float)[back.ravel()], 0, 1), False
            except Exception:  # noqa: BLE001  a failing model must not fail the mail
                p, bad = np.full(len(b), NEUTRAL), True
            yield b.assign(**{out: p, "degraded": bad})

    return df.mapInPandas(run, f"{cols}, {out} double, degraded boolean")


def cascade(urls: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], confident: Column) -> DataFrame:
    """Rows that the first model is confident of leave there; only the rest run the second. Split by filters, since a condition does not keep Spark from running a Python function."""
    one = first(urls)
    done = one.where(confident).withColumn("op_p", F.lit(None).cast("double"))
    more = second(one.where(~F.coalesce(confident, F.lit(False))))
    return done.unionByName(more, allowMissingColumns=True).withColumn("fused", url_fusion(F.col("url_p"), F.col("op_p"), F.lit(False)))
