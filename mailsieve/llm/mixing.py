"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, here a ramp from (1 - tilt) to (1 + tilt) times its mean weight.
Its integral up to time t is the source's cumulative token demand D(t) = target * ((1 - tilt) t + tilt t^2). A source's
documents are laid in an order by hash on a line of tokens, the whole line again for each further pass; the token at which a
document begins is demanded at the time t with D(t) = that token, which is its training position. What lies beyond the
target isn't taken. Documents are range-sorted by position.

Token offsets are sums over (source, hash range), then a running sum inside one range. There are RANGES ranges a source, each
cut into more as the table grows, so that a range of a source with all rows holds about RANGE_ROWS of them; the cuts keep the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import saved

RANGES, RANGE_ROWS = 1024, 1 << 15
WEIGHTS, TILTS = (3, 1, 2), (0.5, 0.0, -0.5)
SHARE_PERCENT, MAX_PASSES = 150, 2


def targets(sizes: dict, weights: dict, total: float, passes: int = MAX_PASSES) -> dict:
    """Words for each source: total shared by weight; a share over `passes` times the source's size stops there, and the excess is shared by weight again."""
    out, left, open_ = {}, total, list(sizes)
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if unit * weights[s] > passes * sizes[s]]
        if not full:
            return out | {s: unit * weights[s] for s in open_}
        for s in full:
            out[s] = float(passes * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def position(token: Column, target: Column, tilt: Column) -> Column:
    """The time at which cumulative demand reaches the token: the root of tilt t^2 + (1 - tilt) t = token / target."""
    x = token / target
    return 2 * x / ((1 - tilt) + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * x))


def range_cuts(rows: int) -> int:
    """How often a range is halved for a table of so many rows; 0 for small ones. Ten halvings (3e10 rows) are the most, then pieces grow."""
    return min(10, ((max(1, rows) - 1) // (RANGES * RANGE_ROWS)).bit_length())


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, tilts: tuple = TILTS, share: int = SHARE_PERCENT, passes: int = MAX_PASSES) -> DataFrame:
    """docs with one more column `mix`: struct of size, source_size, target, taken, first_position, second_position (array of one position a pass in `positions`).

    Sources are ordered by code point, null last, and take the weights and tilts in turn. The table of sources, one row each
    with its size, is collected: it is metadata of the corpus, not rows. Documents are ordered by md5 of doc_id and text, so
    reruns agree; repeated rows are laid one after the other. A null text has size 0 and takes nothing. The document at a
    source's target is taken in part (its first words). An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c != "mix"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"), size.alias("size"), order.alias("o"))
    cuts = range_cuts(docs.count())
    head = F.conv(F.substring("o", 1, 10), 16, 10).cast("long")  # 40 bits; the last 10 of the first 20 are the range, the first ones its piece
    rows = rows.withColumn("range", F.shiftleft(F.shiftright(head, 20) % RANGES, cuts).bitwiseOR(F.shiftright(head, 40 - cuts)))
    per = saved(rows.groupBy("source", "range").agg(F.sum("size").alias("words")))
    sizes = {r.source: r.n for r in per.groupBy("source").agg(F.sum("words").alias("n")).collect()}
    names = sorted(sizes, key=lambda s: (s == "", s))  # "" is the null source, others begin with "="
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = targets(sizes, weight, share / 100 * sum(sizes.values()), passes)
    table = [(s, sizes[s], float(target[s]), float(tilts[i % len(tilts)])) for i, s in enumerate(names)]
    plan = spark.createDataFrame(table, "source string, source_size long, target double, tilt double")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("source", "range", F.coalesce(before, F.lit(0)).alias("before")).join(plan, "source")
    here = F.sum("size").over(Window.partitionBy("source", "range").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("here", here).join(per, ["source", "range"])
    stop = F.floor(F.col("target")).cast("long")
    begins = [F.col("before") + F.col("here") + p * F.col("source_size") for p in range(passes)]
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), stop - b)) for b in begins]
    where = F.filter(F.array(*[F.when(t > 0, F.round(position(b, F.col("target"), F.col("tilt")), 9)) for b, t in zip(begins, takes, strict=True)]), lambda x: x.isNotNull())
    mix = F.struct("size", "source_size", "target", sum(takes).cast("long").alias("taken"), where.alias("positions"))
    return rows.select(*[F.col(f"doc.`{c}`").alias(c) for c in own], mix.alias("mix"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of the first pass; null if nothing is taken), passes; range-sorted by position."""
    out = mixed(docs.select("doc_id", "source", "text"), **how).select("doc_id", "mix.*").withColumn("target", F.round("target", 4))
    out = out.withColumn("position", F.round(F.get("positions", 0), 6)).withColumn("passes", F.size("positions"))
    return out.drop("positions").orderBy("position", "doc_id")


def sequence(docs: DataFrame, **how) -> DataFrame:
    """The rows to train on in curriculum order, all columns as they were: once for each pass that takes a document."""
    out = mixed(docs, **how)
    cols = [F.col(f"`{c}`") for c in docs.columns if c != "mix"]
    return out.select(*cols, F.explode("mix.positions").alias("mix at")).orderBy("mix at").drop("mix at")
