"""Evaluation of scores against labels, splits and calibration tables. Every operator is one or two aggregations over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(df: DataFrame, truth: Column, flagged: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, f1, fpr, rounded to 4 places."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = df.groupBy(*(by or [])).agg(n(truth & flagged).alias("tp"), n(~truth & flagged).alias("fp"), n(truth & ~flagged).alias("fn"), n(~truth & ~flagged).alias("tn"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fp, fp + tn).alias("fpr"))


def sweep(df: DataFrame, score: str, truth: Column) -> DataFrame:
    """One row for each distinct score, from the highest: tp and fp at that threshold, with tpr and fpr.

    Rows are first summed by score, so the running sums go over distinct scores only (bounded for scores on a fixed scale).
    """
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"))
    w = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    out = per.select("threshold", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("neg"))
    return out.select("threshold", "tp", "fp", "pos", "neg", F.try_divide("tp", "pos").alias("tpr"), F.try_divide("fp", "neg").alias("fpr"))


def roc_auc(df: DataFrame, score: str, truth: Column) -> DataFrame:
    """Area under the curve, ties counting half."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("p", "n", (F.col("p") * (below + F.col("n") / 2)).alias("wins"))
    return per.agg(F.round(F.try_divide(F.sum("wins"), F.sum("p") * F.sum("n")), 6).alias("auc"))


def partial_auc(df: DataFrame, score: str, truth: Column, most: float = 0.05) -> DataFrame:
    """Area up to a false-positive rate, over that rate, by trapezoids cut at it."""
    s = sweep(df, score, truth).select("threshold", "tpr", "fpr")
    w = Window.orderBy(F.desc("threshold"))
    s = s.select("tpr", "fpr", F.lag("tpr", 1, 0.0).over(w).alias("t0"), F.lag("fpr", 1, 0.0).over(w).alias("f0")).where(F.col("f0") < most)
    end = F.least("fpr", F.lit(most))
    at_end = F.when(F.col("fpr") > F.col("f0"), F.col("t0") + (F.col("tpr") - F.col("t0")) * (end - F.col("f0")) / (F.col("fpr") - F.col("f0"))).otherwise(F.col("tpr"))
    return s.agg(F.round(F.sum((end - F.col("f0")) * (at_end + F.col("t0")) / 2) / most, 6).alias("pauc"))


def best_threshold(df: DataFrame, score: str, truth: Column, max_fpr: float | None = None) -> DataFrame:
    """The threshold of most recall within a false-positive rate, or of best F1 without one; ties to the higher threshold."""
    s = sweep(df, score, truth).withColumn("f1", 2 * F.col("tp") / (F.col("pos") + F.col("tp") + F.col("fp")))
    s = s.where(F.col("fpr") <= max_fpr) if max_fpr is not None else s
    goal = F.col("tpr") if max_fpr is not None else F.col("f1")
    best = s.agg(F.max(F.struct(goal.alias("goal"), F.col("threshold"), F.col("tpr"), F.col("fpr"), F.col("f1"))).alias("b"))
    return best.select("b.threshold", F.round("b.tpr", 6).alias("recall"), F.round("b.fpr", 6).alias("fpr"), F.round("b.f1", 6).alias("f1"))


def reliability(df: DataFrame, p: Column, truth: Column, bins: int = 15) -> DataFrame:
    """Equal-width bins of a probability: n, mean probability, share of positives."""
    at = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(truth.cast("double")), 6).alias("rate"))


def calibration_error(df: DataFrame, p: Column, truth: Column, bins: int = 15) -> DataFrame:
    """Expected calibration error and Brier score."""
    at = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    y = truth.cast("double")
    per = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((p - y) * (p - y)).alias("sq"))
    return per.agg(F.round(F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def wilson(k: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Wilson score interval of a share."""
    p = k / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def hash_share(*cols: Column) -> Column:
    """A number in 0..1 from the md5 of the columns, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("double") / 4294967296.0


def stratified_split(df: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """df with is_train: of each label the first floor(share * n) rows by hash of (seed, key)."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    w = Window.partitionBy(label)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(order, key))).withColumn("_n", F.count("*").over(w))
    return ranked.withColumn("is_train", F.col("_r") <= F.floor(share * F.col("_n"))).drop("_r", "_n")


def group_split(df: DataFrame, group: str, shares: dict[str, float], seed: int) -> DataFrame:
    """df with split: a group goes whole to the part that its hash falls in."""
    h, upto, out = hash_share(F.lit(str(seed)), F.col(group).cast("string")), 0.0, None
    for name, share in list(shares.items())[:-1]:
        upto += share
        out = F.when(h < upto, name) if out is None else out.when(h < upto, name)
    return df.withColumn("split", out.otherwise(list(shares)[-1]))


def bootstrap(df: DataFrame, key: str, stat: Column, resamples: int = 400, seed: int = 7) -> DataFrame:
    """Poisson bootstrap of a mean: 2.5 %, 50 % and 97.5 % of the weighted means over the resamples.

    Each row gets a Poisson(1) weight for each resample from a hash, so rows need not be gathered; sums are map-side combined.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("b")), F.lit(1 << 30)).cast("double") / (1 << 30)
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    weight = sum(F.when(u >= c, 1).otherwise(0) for c in cuts)
    per = df.select(F.col(key), stat.cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).select("b", "v", weight.alias("w"))
    means = per.groupBy("b").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    q = lambda x: F.round(F.percentile("m", F.lit(x)), 4)
    return means.agg(q(0.025).alias("low"), q(0.5).alias("mid"), q(0.975).alias("high"))


def out_of_fold(df: DataFrame, fold: str, by: str, positive: str) -> DataFrame:
    """df with out_of_fold: the rate of positives among the rows with the same `by` outside the row's own fold, smoothed by one row at the rate of all rows outside.

    Counts are taken by (fold, by) once; a fold's own are taken off the totals, so nothing is fitted fold after fold.
    """
    own = df.groupBy(fold, by).agg(F.count_if(F.col(positive)).alias("_p"), F.count("*").alias("_n"))
    rates = own.select(fold, by, *((F.sum(c).over(Window.partitionBy(by)) - F.col(c)).alias(f"{c}o") for c in ("_p", "_n")))
    folds = own.groupBy(fold).agg(F.sum("_p").alias("_pf"), F.sum("_n").alias("_nf"))
    total = own.agg(F.sum("_p").alias("_pa"), F.sum("_n").alias("_na"))
    folds = folds.join(F.broadcast(total)).select(fold, ((F.col("_pa") - F.col("_pf")) / (F.col("_na") - F.col("_nf"))).alias("_rate"))  # a row a fold, and one row
    out = df.join(rates, [fold, by]).join(F.broadcast(folds), fold)
    return out.withColumn("out_of_fold", (F.col("_po") + F.col("_rate")) / (F.col("_no") + 1)).drop("_po", "_no", "_rate")


def held_out_by(df: DataFrame, provenance: str, trained_on: list) -> DataFrame:
    """df with is_train: whether the row comes from one of the sources trained on; all others are held out whole, and so is a row of no known source."""
    return df.withColumn("is_train", F.coalesce(F.col(provenance).isin(trained_on), F.lit(False)))
