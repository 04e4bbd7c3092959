"""Range queries over sampled counters, gauges and cumulative histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def deltas(samples: DataFrame, labels: list[str], instance: str) -> DataFrame:
    """samples with `delta`: the growth since the series' sample before; a fall is a reset, after which the value itself has grown. First samples go."""
    before = F.lag("value").over(Window.partitionBy(*labels, instance).orderBy("ts", "value"))
    d = F.col("value") - before
    return samples.withColumn("delta", F.when(d < 0, F.col("value")).otherwise(d)).where("delta IS NOT NULL")


def _windowed(samples: DataFrame, labels: list[str], instance: str, span: str, slide: str | None) -> DataFrame:
    w = F.window("ts", span, slide) if slide else F.window("ts", span)
    return deltas(samples, labels, instance).groupBy(*labels, w.alias("w")).agg(F.sum("delta").alias("increase"))


def increase(samples: DataFrame, labels: list[str], instance: str, span: str, slide: str | None = None) -> DataFrame:
    """Sum of growth by labels and window; sliding if slide is given."""
    return _windowed(samples, labels, instance, span, slide).select(*labels, F.col("w.start").alias("window_start"), "increase")


def rate(samples: DataFrame, labels: list[str], instance: str, span: str, slide: str | None = None) -> DataFrame:
    """Growth a second by labels and window."""
    seconds = F.unix_seconds(F.col("w.end").cast("timestamp")) - F.unix_seconds(F.col("w.start").cast("timestamp"))
    return _windowed(samples, labels, instance, span, slide).select(*labels, F.col("w.start").alias("window_start"), (F.col("increase") / seconds).alias("rate"))


def histogram_quantile(buckets: DataFrame, labels: list[str], q: float) -> DataFrame:
    """The quantile of cumulative buckets (le, n), linear inside its bucket; the last finite bound if it lies beyond."""
    w = Window.partitionBy(*labels)
    o = w.orderBy("le")
    b = buckets.select(*labels, "le", "n", F.lag("le", 1, 0.0).over(o).alias("low"), F.lag("n", 1, 0).over(o).alias("under"), (q * F.max("n").over(w)).alias("rank"))
    inside = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("under")) / (F.col("n") - F.col("under")))
    return b.where("n >= rank").groupBy(*labels).agg(F.min_by(inside, "le").alias("q"))


def last_value(samples: DataFrame, labels: list[str], at: str, tie: str) -> DataFrame:
    return samples.groupBy(*labels).agg(F.max(F.struct(at, tie, "value")).alias("x")).select(*labels, "x.value")
