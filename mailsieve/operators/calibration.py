"""Calibration curves fitted on labelled scores, and what they make of a score."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import CAP, piecewise


def isotonic(df: DataFrame, score: str, truth: Column) -> tuple[list[float], list[float]]:
    """Points of the isotonic curve of truth by score. Scores are pooled first, so the fit sees distinct scores only."""
    pooled = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("features")).agg(F.avg(truth.cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(weightCol="weight").fit(pooled)
    return [float(x) for x in model.boundaries], [float(y) for y in model.predictions]


def beta(df: DataFrame, p: str, truth: Column) -> tuple[float, float, float]:
    """(a, b, c) of the beta calibration 1 / (1 + exp(-(a ln p - b ln(1 - p) + c)))."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    rows = df.select(F.log(q).alias("x"), (-F.log(1 - q)).alias("y"), truth.cast("double").alias("label"))
    model = LogisticRegression(regParam=1e-6, maxIter=100).fit(VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows))
    return float(model.coefficients[0]), float(model.coefficients[1]), float(model.intercept)


def beta_calibrated(p: Column, fitted: tuple[float, float, float]) -> Column:
    a, b, c = fitted
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return 1 / (1 + F.exp(-(a * F.log(q) - b * F.log(1 - q) + c)))


def calibrated_or_fit(df: DataFrame, channels: dict[str, str], truth: Column) -> tuple[dict, tuple]:
    """Curves for each channel and the final curve of the combined score."""
    curves = {k: isotonic(df, c, truth) for k, c in channels.items()}
    p = F.lit(1.0)
    for k, c in channels.items():
        q = F.greatest(F.lit(0.0), F.least(F.lit(CAP), piecewise(F.col(c).cast("double"), *curves[k])))
        p = p * F.when(F.col(c).isNull(), 1.0).otherwise(1 - q)
    return curves, isotonic(df.withColumn("_raw", F.round((1 - p) * 100, 4)), "_raw", truth)


def temperature(df: DataFrame, logit: str, truth: Column, low: float = 0.25, high: float = 8.0, steps: int = 25) -> float:
    """The temperature of least log loss on a geometric grid, all of it in one aggregation."""
    grid = [low * (high / low) ** (k / (steps - 1)) for k in range(steps)]
    y = truth.cast("double")

    def loss(t: float) -> Column:
        z = F.col(logit) / t
        return F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - y * z)

    row = df.agg(*[loss(t).alias(f"t{k}") for k, t in enumerate(grid)]).first()
    return min(zip(row, grid, strict=True), key=lambda x: (x[0] if x[0] is not None else math.inf, x[1]))[1]


def combiner(df: DataFrame, features: list[str], truth: Column, kind: str = "logistic"):
    """A fitted combiner of channel scores (nulls are 0): logistic regression or boosted trees."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.na.fill(0, features).withColumn("label", truth.cast("double")))
    if kind == "logistic":
        return LogisticRegression(regParam=1e-3).fit(rows)
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(maxIter=20, maxDepth=3, seed=7).fit(rows)
