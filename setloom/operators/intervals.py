"""Run algebra without expanding runs: intersection, union and difference of (start, stop) lists, inclusive.

Runs are cut at block borders, so joins and windows are by block and none grows with the set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import over_borders


def by_block(runs: DataFrame) -> DataFrame:
    """Runs cut at multiples of 65,536: key, start, stop."""
    cut = runs.select("start", "stop", F.explode(F.sequence(F.shiftright("start", 16), F.shiftright("stop", 16))).alias("key"))
    first = F.shiftleft("key", 16)
    return cut.select("key", F.greatest("start", first).alias("start"), F.least("stop", first + 65535).alias("stop"))


def merged(runs: DataFrame) -> DataFrame:
    """Maximal runs of runs that may touch or overlap: first in each block, then those at block borders over them."""
    w = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = by_block(runs).distinct().withColumn("new", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    inside = new.withColumn("run", F.sum("new").over(w)).groupBy("key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return over_borders(inside.select("start", "stop"))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    a = by_block(left)
    b = by_block(right).select("key", F.col("start").alias("s"), F.col("stop").alias("t"))
    met = a.join(b, (a["key"] == b["key"]) & (a["start"] <= b["t"]) & (b["s"] <= a["stop"]))
    return merged(met.select(F.greatest("start", "s").alias("start"), F.least("stop", "t").alias("stop")))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return merged(left.select("start", "stop").union(right.select("start", "stop")))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """left without right: each block of left is intersected with the gaps between right's runs there."""
    keys = by_block(left).select("key").distinct()
    inside = by_block(merged(right)).join(keys, "key", "left_semi")
    w = Window.partitionBy("key").orderBy("start")
    # a sentinel after each block's last value closes the last gap
    marks = inside.union(keys.select("key", (F.shiftleft("key", 16) + 65536).alias("start"), (F.shiftleft("key", 16) + 65536).alias("stop")))
    gaps = marks.select("key", F.coalesce(F.lag("stop").over(w) + 1, F.shiftleft("key", 16)).alias("start"), (F.col("start") - 1).alias("stop")).where("start <= stop")
    return intersect(left, gaps.select("start", "stop"))


def without_values(runs: DataFrame, values: DataFrame) -> DataFrame:
    """Runs without single values (column value), which split them."""
    return difference(runs, values.select(F.col("value").alias("start"), F.col("value").alias("stop")))


def expand(runs: DataFrame) -> DataFrame:
    """value rows of runs."""
    return by_block(runs).select(F.explode(F.sequence("start", "stop")).alias("value")).distinct()


def filter_values(values: DataFrame, runs: DataFrame, keep: bool = True) -> DataFrame:
    """Values inside the runs, or outside: a range semi or anti join within blocks."""
    v = values.select("value", F.shiftright("value", 16).alias("k"))
    r = by_block(runs)
    return v.join(r, (F.col("k") == F.col("key")) & F.col("value").between(F.col("start"), F.col("stop")), "left_semi" if keep else "left_anti").select("value")
