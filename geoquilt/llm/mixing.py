"""Mixing sources to target word counts by weighted sampling without replacement (Efraimidis and Spirakis)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
_BUCKETS = 4096


def quality_weight(size: Column, chars: Column) -> Column:
    """Weight 1 for texts whose characters per word lie in the range of running text (3 to 12), else one half."""
    return F.when((chars >= 3 * size) & (chars <= 12 * size), 1.0).otherwise(0.5)


def targets(sources: DataFrame, share_percent: int = 150, most_epochs: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """sources (sk, source, source_size) with their target words.

    Sources by code point (null last) weigh `weights`, repeating, and share share_percent of all words; a target stops
    at most_epochs times its source's size and what it leaves is reshared by weight. One pass finds the level: sources
    by ascending cap per weight are full until the level computed from the rest no longer passes the next one's cap.
    The frame has a row for each source only.
    """
    order = Window.orderBy(F.col("source").isNull(), "source", "sk")
    weighted = sources.withColumn("no", F.row_number().over(order) - 1)
    weighted = weighted.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("no") % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * most_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(all_) * share_percent - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0))) / (100.0 * F.sum("weight").over(onward))
    levelled = weighted.withColumn("level", level)
    open_ = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    # the level of the first source that is not filled; levels only fall to it and then do not fall below
    levelled = levelled.withColumn("level", F.coalesce(F.max(open_).over(all_), F.lit(float("inf"))))
    return levelled.select("sk", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, share_percent: int = 150, most_epochs: int = 2, weights: tuple[int, ...] = (5, 2, 1), whole: bool = False, mark: Column | None = None) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of docs.

    A source takes its target's complete epochs first: every document that many times. What is left of the target goes
    to documents by ascending exponential key -ln(u) / weight, u a hash of the doc_id and the weight a measure of the
    text's quality, until their words reach it; the last of them is taken in part, or with whole=True wholly or not,
    whichever is nearer. The prefix sums have two levels: words of (source, key range), then the rows of the one range
    where the budget ends, so no task sorts a source. Null text: size 0, taken 0. Null source: a source of its own,
    ordered last. mark: a column to hand through. Null doc_id: hashed as the empty string. Repeated rows are sized and taken each. Other columns are
    not read.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", (F.lit(0).cast("long") if mark is None else mark).alias("mark"))
    sized = sized.select("doc_id", "source", size.alias("size"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "mark")
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(u) / quality_weight(F.col("size"), F.col("chars"))
    sized = sized.withColumn("key", key).withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * _BUCKETS)).withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sized = written(sized.drop("chars"), "sized")
    sums = sized.groupBy("sk", "range").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    sums = written(sums, "ranges")
    sources = sums.groupBy("sk").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    goal = targets(sources, share_percent, most_epochs, weights)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("left", F.floor("target") - F.col("epochs") * F.col("source_size"))
    run = Window.partitionBy("sk").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).join(goal, "sk")
    placed = placed.select("sk", "range", "before", "words", "source_size", "target", "epochs", "left")
    rows = sized.join(placed, ["sk", "range"])
    ends_here = (F.col("before") < F.col("left")) & (F.col("before") + F.col("words") > F.col("left"))
    clear = rows.where(~ends_here).withColumn("extra", F.when(F.col("before") < F.col("left"), F.col("size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("sk", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room")))
    if whole:
        part = F.when(F.col("room") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    edge = rows.where(ends_here).withColumn("room", room).withColumn("extra", part).drop("room")
    both = clear.unionByName(edge)
    return both.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"), *["mark"] * (mark is not None))


def drawn(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it whole; rows of no words are taken by no mix and go.

    A row is told by a 64-bit hash over doc_id, source and text and which of them are null, so repeated rows are drawn alike.
    """
    columns = docs.columns
    inner = [c if c in ("doc_id", "source", "text") else f"c{i}" for i, c in enumerate(columns)]  # no column of docs meets one of ours
    name = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("text"), F.lit("")), *[F.col(c).isNull() for c in ("doc_id", "source", "text")])
    marked = docs.toDF(*inner).withColumn("row", name)
    times = mixed(docs, whole=True, mark=name, **options).where("taken > 0").select(F.col("mark").alias("row"), F.floor(F.col("taken") / F.col("size")).cast("int").alias("times"))
    times = times.groupBy("row").agg(F.max("times").alias("times"))
    out = marked.join(times, "row")
    return out.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*inner).toDF(*columns)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, coalesce(length(text), 0) AS chars FROM documents
), k AS (
  SELECT *, -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / (CASE WHEN chars >= 3 * size AND chars <= 12 * size THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no FROM d GROUP BY source
), w AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 150 - 100 * CAST(coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / (100.0::DOUBLE * CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)) AS level FROM w
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * coalesce(max(CASE WHEN level <= cap::DOUBLE / weight THEN level END) OVER (), 'inf'::DOUBLE)) AS target FROM l
), e AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS BIGINT) AS epochs FROM t
), p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size
    - CAST(coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS room
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM p
"""
