"""Reads of sets: membership, cardinality, bounds, order, equality, digests. Sets are (set_id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import spread


def contains(probes: DataFrame, sets: DataFrame) -> DataFrame:
    """probes (set_id, value) with found: is the value in that set."""
    members = spread(sets.select("set_id", "value"), "set_id", "value").distinct().withColumn("found", F.lit(True))
    return probes.join(members, ["set_id", "value"], "left").select("set_id", "value", F.coalesce("found", F.lit(False)).alias("found"))


def summary(sets: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """set_id, n, lo, hi, is_empty; ids names the sets that are there, so that empty ones appear (lo and hi null)."""
    out = spread(sets, "set_id", "value").distinct().groupBy("set_id").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    if ids is not None:
        out = ids.select("set_id").join(out, "set_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("is_empty", F.col("n") == 0)


def ordered(sets: DataFrame) -> DataFrame:
    """Values in ascending order within each set; the range shuffle sorts in parallel."""
    return sets.select("set_id", "value").distinct().orderBy("set_id", "value")


def equality(left: DataFrame, right: DataFrame) -> DataFrame:
    """set_id, equal: do the two sides hold the same values, by one aggregate over both."""
    sides = left.select("set_id", "value", F.lit(1).alias("m")).union(right.select("set_id", "value", F.lit(2).alias("m")))
    both = sides.groupBy("set_id", "value").agg(F.bit_or("m").alias("m"))
    return both.groupBy("set_id").agg((F.sum(F.when(F.col("m") == 3, 0).otherwise(1)) == 0).alias("equal"))


def digest(sets: DataFrame) -> DataFrame:
    """set_id, n, total, lo, hi, mixed: equal for equal sets in any encoding and order."""
    mixed = F.bit_xor((F.col("value") * 2654435761).bitwiseAND(F.lit((1 << 53) - 1)))
    return spread(sets, "set_id", "value").distinct().groupBy("set_id").agg(F.count("value").alias("n"), F.sum("value").cast("bigint").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"), mixed.alias("mixed"))
