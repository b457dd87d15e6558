"""Mixing sources to target weights, in DataFrame operations only.

Documents get hash-random keys; (source, key bucket) sums give distributed prefix sums, so only the
rows of the one bucket in which a source's budget ends are split into finer buckets, and only the
rows of one of those are ordered exactly. The cut is then a small
(source) table that every document compares its key with: no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Leading hexadecimal digits of the key that make its bucket: 4096 buckets a source, and as many again in the one where its budget ends.
BUCKET_DIGITS = 3


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _key() -> Column:
    return F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 16)


def targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Target words of each (source, source_size): by weight, none above cap times its size.

    Sources by code point, null last, take the weights in turn. The excess of capped sources goes to
    the others by weight until none is above: with sources ordered by cap / weight, the level
    at which all sources before are capped and the rest share by weight is the common one where it
    first respects its own source's cap; from there on levels only fall, so it is the greatest that does.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    limits = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(everything))
    by_limit = Window.orderBy(F.col("most").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    levels = limits.withColumn("level", (F.col("total") - before).cast("double") / rest)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    common = levels.withColumn("common", F.max(fits).over(everything))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("most").cast("double")))
    return common.select("source", "source_size", target.alias("target"))


def cuts(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row a source: source_size, target, epochs (whole passes) and where the last pass ends (cut_*, part)."""
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _key().alias("key")), "sizes")
    sums = sized.groupBy("source", F.substring("key", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    goal = goal.withColumn("budget", F.floor("target").cast("long")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long"))
    goal = stored(goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")), "goals")
    budgets = goal.select(F.col("source").alias("s"), "rest")

    def ending(sums: DataFrame) -> DataFrame:
        """The bucket of each source in which its last pass ends, from bucket sums (source, bucket, words, base: the words before them all)."""
        earlier = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = sums.withColumn("before", F.col("base") + earlier).join(budgets, F.col("source").eqNullSafe(F.col("s")))
        return placed.where("before <= rest and rest < before + words").select("s", F.col("bucket").alias("end_bucket"), "before", "rest")

    def inside(ends: DataFrame, digits: int) -> DataFrame:
        return sized.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.substring("key", 1, digits) == F.col("end_bucket")))

    ends = stored(ending(sums.withColumn("base", F.lit(0).cast("long"))), "ends")
    finer = inside(ends, BUCKET_DIGITS).groupBy("source", F.substring("key", 1, 2 * BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("words"), F.first("before").alias("base"))
    ends = ending(finer)
    rows = inside(ends, 2 * BUCKET_DIGITS).groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    earlier = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        rows.withColumn("at", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(earlier), F.lit(0)))
        .where("at <= rest and rest < at + size * n")
        .select(F.col("source").alias("s"), F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_doc"), F.col("size").alias("cut_size"), F.expr("(rest - at) div n").alias("part"))
    )
    return stored(goal.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest", "budget"), "cuts")


def _taken() -> Column:
    at = F.struct(F.col("key"), F.col("doc_id"), F.col("size"))
    cut = F.struct(F.col("cut_key"), F.col("cut_doc"), F.col("cut_size"))
    last = F.when(F.col("cut_key").isNull() | (at > cut), F.lit(0)).when(at < cut, F.col("size")).otherwise(F.col("part"))
    return (F.col("epochs") * F.col("size") + last).cast("long")


def _with_cuts(docs: DataFrame, ends: DataFrame, *keep: str) -> DataFrame:
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _key().alias("key"), *keep)
    ends = ends.withColumnRenamed("source", "cut_source")
    return sized.join(ends, F.col("source").eqNullSafe(F.col("cut_source"))).withColumn("taken", _taken())


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Words that the mix takes of each document: doc_id, size, source_size, target, taken.

    A source's budget is its target rounded down. Its documents are passed in the order of their
    hash-random keys as many times as the budget holds them all, then once more up to the exact word
    at which it ends; repeated rows (same doc_id and size) at that place share it evenly, rounded
    down. Null texts have size 0, a null source is a source, a null doc_id sorts first among equal
    keys; an empty table gives no row. Equal input gives equal output, whatever the partitioning.
    """
    return _with_cuts(docs, cuts(docs, weights, cap)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The mix itself, with the columns of documents: one row for each time a document is taken.

    The document at which a source's budget ends is there up to its last word that the mix takes;
    documents of which it takes nothing are absent, those without words too. Nulls, repeated rows and
    empty tables are as in mix(); rows keep their doc_id, lang and source.
    """
    ends = cuts(docs, weights, cap)
    taken = _with_cuts(docs, ends, "text", "lang").where("taken > 0")
    copies = taken.withColumn("copy", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
    # possessive, so that the word count is matched in a loop, not by recursion
    head = F.expr(r"regexp_extract(text, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){', taken % size, '}+'), 0)")
    text = F.when(F.col("copy") * F.col("size") > F.col("taken"), head).otherwise(F.col("text"))
    return copies.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key FROM documents),
named AS (
  SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT *, 3 * source_size AS most,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM named),
goals AS (
  SELECT source, source_size, CASE WHEN common IS NULL THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE), common * weight) END AS target
  FROM (SELECT *, max(CASE WHEN level * weight <= most THEN level END) OVER () AS common FROM levels)),
budgets AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM goals),
ordered AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM ordered
"""
