"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is its sequence of words. The edit bound is EDITS = 1 word for lines of every length: two lines are linked if one word
put in, left out or changed makes one the other, and a word at least is left that they have in common (so two lines of one
word each are linked only if equal). Lines emit the hashed keys of their variants with one word left out, and of themselves.
Lines that share the key of a variant with the same gap differ in the word at the gap at most; a line that has the key of
another's variant is that line less a word. So each key's lines need comparing with its earliest only, and counts of lines by
key give the number of links: no pairs within a group are made, however large it is.

Two lines one word apart share their first or their last words up to about the middle. So only lines that share such a half
with another line emit variants, and only with gaps in the other half; lines of up to SHORT words, which have no half to
speak of, emit all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import saved

#: The one bound that the key scheme is made for; a second edit would need variants for every pair of gaps.
EDITS = 1
SHORT = 4
ID = ["h1", "h2"]


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


def _one_blank(raw: Column) -> Column:
    """The words of a line with one blank between."""
    odd = F.contains(raw, F.lit("  ")) | raw.rlike(r"[\x09-\x0D]")
    return F.trim(F.when(odd, F.regexp_replace(raw, r"[\x20\x09-\x0D]+", " ")).otherwise(raw))


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, h1, h2) for the lines that have a word; line is its words with one blank between."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "raw"))
    rows = rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), _one_blank(F.col("raw")).alias("line")).where("line <> ''")
    return rows.select("*", *_hashes())


def _half_keys(k: str) -> list[Column]:
    """struct(key, kind, k) for the first k and the last k words of `line`."""
    part = lambda size: F.call_function("substring_index", F.col("line"), F.lit(" "), size)
    both = F.xxhash64(F.lit("first"), k, part(F.col(k))), F.xxhash64(F.lit("last"), k, part(-F.col(k)))
    return [F.struct(key.alias("key"), F.lit(kind).alias("kind"), F.col(k).alias("k")) for kind, key in enumerate(both)]


def _with_halves(lines: DataFrame) -> DataFrame:
    """lines with the number of words `n` and `halves`: keys of about half of their words, from either end.

    k is 2 * floor(n / 4), the same for a line and one a word longer but where n is a multiple of 4; such a line has keys for both.
    Word counts are columns of their own, so that no expression holds them several times.
    """
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    none = F.array().cast("array<struct<key:bigint,kind:int,k:int>>")
    lines = lines.select("*", n.cast("int").alias("n"))
    lines = lines.select("*", (2 * F.floor(F.col("n") / 4)).cast("int").alias("k"), (2 * F.floor((F.col("n") - 1) / 4)).cast("int").alias("k1"))
    keys = F.when(F.col("n") <= SHORT, none).when(F.col("n") % 4 == 0, F.array(*_half_keys("k"), *_half_keys("k1"))).otherwise(F.array(*_half_keys("k")))
    return lines.select("doc_id", "line_no", *ID, "n", keys.alias("halves"))


def _judged(docs: DataFrame) -> DataFrame:
    """(at, h1, h2, keeper, n_links) for every line."""
    place = F.struct(F.col("doc_id").alias("d"), F.col("line_no").alias("l"))
    lines = _with_halves(line_rows(docs)).select(place.alias("at"), *ID, "n", "halves")
    distinct = saved(lines.groupBy(*ID).agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("halves").alias("halves")).withColumn("id", F.monotonically_increasing_id()))
    halves = distinct.select("id", F.explode("halves").alias("x")).select("id", "x.*")
    # shared keys are written before the join, which then deals both sides anew and can split a key of very many lines
    shared = saved(halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    # from where on, and up to where, the words may differ
    able = halves.join(shared, "key").groupBy("id").agg(F.min(F.when(F.col("kind") == 0, F.col("k"))).alias("after"), F.min(F.when(F.col("kind") == 1, F.col("k"))).alias("before"))
    able = distinct.select("id", "at", *ID).join(able.union(distinct.where(F.col("n") <= SHORT).select("id", F.lit(0), F.lit(0))), "id")
    # their words are read again, by place and hash, so rows without a doc_id or with the same one stay apart
    spot = lambda d, no: F.xxhash64(d, no)
    able = able.select(spot(F.col("at.d"), F.col("at.l")).alias("spot"), *ID, "id", "at", "after", "before")
    texts = line_rows(docs).select(spot(F.col("doc_id"), F.col("line_no")).alias("spot"), *ID, "line")
    able = saved(able.join(texts, ["spot", *ID]).select("id", "at", "after", "before", F.split("line", " ").alias("ws")).dropDuplicates(["id"]))
    words = able.select("id", F.size("ws").alias("n"), "after", "before", F.posexplode("ws").alias("p", "w"))
    words = words.select("id", "n", "after", "before", "p", F.xxhash64("w", "p").alias("stay"), F.xxhash64("w", F.col("p") - 1).alias("move"))
    whole = Window.partitionBy("id")
    upto = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    words = words.select("id", "n", "after", "before", "p", "stay", *(F.expr(f"bit_xor({c})").over(w).alias(a) for c, w, a in (("stay", upto, "kept"), ("move", upto, "moved"), ("move", whole, "all"))))
    key = F.col("kept").bitwiseXOR(F.col("stay")).bitwiseXOR(F.col("all")).bitwiseXOR(F.col("moved"))
    gap = (F.col("n") > 1) & ((F.col("p") >= F.col("after")) | (F.col("p") < F.col("n") - F.col("before")))
    # rows of one kind for all keys: of a variant with its gap (same), of a variant (less), of the line itself (own)
    variants = words.select("id", F.explode(F.concat(
        F.when(gap, F.array(F.struct(F.xxhash64(F.lit("same"), "n", "p", key).alias("key"), F.lit(0).alias("kind")), F.struct(F.xxhash64(F.lit("one"), F.col("n") - 1, key).alias("key"), F.lit(1).alias("kind")))).otherwise(F.array().cast("array<struct<key:bigint,kind:int>>")),
        F.when(F.col("p") == F.col("n") - 1, F.array(F.struct(F.xxhash64(F.lit("one"), "n", "kept").alias("key"), F.lit(2).alias("kind")))).otherwise(F.array().cast("array<struct<key:bigint,kind:int>>")),
    )).alias("x")).select("id", "x.key", "x.kind")
    groups = variants.groupBy("key").agg(F.count_if(F.col("kind") == 0).alias("same"), F.count_if(F.col("kind") == 1).alias("longer"), F.count_if(F.col("kind") == 2).alias("own"))
    groups = saved(groups.where("same > 1 OR (longer > 0 AND own > 0)"))
    hits = saved(variants.join(groups, "key").select("id", "key", "kind").distinct().join(able.select("id", "at"), "id"))
    best = hits.groupBy("key").agg(F.min("at").alias("any"), F.min(F.when(F.col("kind") == 2, F.col("at"))).alias("short"), *(F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(3)))
    links = hits.join(saved(best), "key").select(
        "id", "at", F.when(F.col("kind") == 1, F.col("short")).otherwise(F.col("any")).alias("near"), F.when(F.col("kind") == 0, F.col("n0") - 1).when(F.col("kind") == 1, F.col("n2")).otherwise(F.col("n1")).alias("links")
    ).where("links > 0")
    best = _confirmed(links, able).groupBy("id").agg(F.min("near").alias("near"), F.sum("links").alias("n_links"))
    best = distinct.select("id", *ID, "at").join(best, "id", "left").select(*ID, F.least("at", F.coalesce("near", "at")).alias("keeper"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return lines.select("at", *ID).join(best, ID)


def near_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, kept, keeper_doc_id, keeper_line, n_links) for every line of docs that has a word.

    Lines are ordered by (doc_id, line_no). A line is kept unless an earlier line is equal to it or linked with it; the keeper
    is the earliest such line, or the line itself. n_links counts the different lines linked with it. A null text has no lines.
    A null doc_id comes before all others. Repeated rows are equal lines; of equal ones at the same place each is
    kept or dropped alike. An empty table gives no rows.
    """
    out = _judged(docs)
    return out.select(F.col("at.d").alias("doc_id"), F.col("at.l").alias("line_no"), F.col("at").eqNullSafe(F.col("keeper")).alias("kept"), F.col("keeper.d").alias("keeper_doc_id"), F.col("keeper.l").alias("keeper_line"), F.col("n_links").cast("long").alias("n_links"))


def within_one(a: Column, b: Column) -> Column:
    """Whether the word arrays a and b are one word apart at most: what is left between their common start and common end is one word."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    differ = F.filter(F.sequence(F.lit(1), short), lambda i: F.get(a, i - 1) != F.get(b, i - 1))
    start = F.coalesce(F.get(differ, 0) - 1, short)
    rest = lambda x, skip, size: F.slice(x, start + 1 + skip, F.greatest(F.lit(0), size - start - skip))
    return F.when(n == m, rest(a, 1, n) == rest(b, 1, m)).when(n == m + 1, rest(a, 1, n) == rest(b, 0, m)).when(m == n + 1, rest(a, 0, n) == rest(b, 1, m)).otherwise(F.lit(False))


def _confirmed(links: DataFrame, able: DataFrame) -> DataFrame:
    """Links whose edit distance is one word at most; where a line is itself the earliest there is nothing to check."""
    mine, other = able.select("id", "ws"), able.select(F.col("at").alias("near"), F.col("ws").alias("other"))
    near = links.where(F.col("at") != F.col("near")).join(mine, "id").join(other, "near").where(within_one(F.col("ws"), F.col("other")))
    return links.where(F.col("at") == F.col("near")).select("id", "near", "links").union(near.select("id", "near", "links"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the text of every row of docs less the lines that aren't kept; lines without a word go too.

    A row whose lines all go has the empty text, as has a null one. Rows of the same doc_id stay apart; those with the same text too are one.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t")).dropDuplicates(["doc_id", "t", "text"])
    each = rows.select("doc_id", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", _one_blank(F.col("raw"))).where("line <> ''")
    each = each.select("*", *_hashes())
    gone = _judged(docs).where(~F.col("at").eqNullSafe(F.col("keeper"))).select(F.col("at.d").alias("d"), F.col("at.l").alias("l"), *ID).distinct()
    same = each["doc_id"].eqNullSafe(gone["d"]) & (each["line_no"] == gone["l"]) & (each["h1"] == gone["h1"]) & (each["h2"] == gone["h2"])
    left = each.join(gone, same, "left_anti").groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    left = left.select(F.col("doc_id").alias("d"), "t", F.array_join(F.col("x.line"), "\n").alias("left"))
    return rows.join(left, rows["doc_id"].eqNullSafe(left["d"]) & (rows["t"] == left["t"]), "left").select("doc_id", F.coalesce("left", F.lit("")).alias("text"))
