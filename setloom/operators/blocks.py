"""Blocks and containers: statistics, encoding choice, runs, key-level planning. Sets are (set_id, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import key, low, spread

# fixed values of the format
ARRAY, BITMAP, RUN = 0, 1, 2
MOST_BYTES = 8192  # of a container's payload


def runs(sets: DataFrame) -> DataFrame:
    """set_id, start, stop (inclusive): maximal runs of consecutive values, across blocks.

    Runs are found per block first, so that no window holds more than 65,536 values; those that touch
    a block's first or last value, two a block at most, are then joined over the borders.
    """
    first = F.shiftleft(F.col("key").cast("bigint"), 16)
    inside = block_runs(sets).select("set_id", (first + F.col("start")).alias("start"), (first + F.col("start") + F.col("length")).alias("stop"))
    return over_borders(inside, "set_id")


def over_borders(block_runs: DataFrame, *by: str) -> DataFrame:
    """Maximal runs from those of each block: by, start, stop.

    Only runs at a block's border can go on in the next one. There are at most two a block, 131,072 of
    a set, and each joins a chain with its neighbours; all other runs are passed on as they are.
    """
    at_border = (F.col("start").bitwiseAND(F.lit(65535)) == 0) | (F.col("stop").bitwiseAND(F.lit(65535)) == 65535)
    w = Window.partitionBy(*by, "all").orderBy("start")
    edge = block_runs.where(at_border).select(*by, "start", "stop", F.lit(0).alias("all"))
    edge = edge.withColumn("new", F.when(F.lag("stop").over(w) + 1 == F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    chains = edge.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return block_runs.where(~at_border).select(*by, "start", "stop").union(chains.select(*by, "start", "stop"))


def block_runs(sets: DataFrame) -> DataFrame:
    """set_id, key, start, length: maximal runs within each block; a run holds length + 1 values."""
    lows = spread(sets.select("set_id", key().alias("key"), low().alias("low")), "set_id", "key").distinct()
    island = F.col("low") - F.row_number().over(Window.partitionBy("set_id", "key").orderBy("low"))
    return lows.withColumn("island", island).groupBy("set_id", "key", "island").agg(F.min("low").alias("start"), (F.max("low") - F.min("low")).alias("length")).select("set_id", "key", "start", "length")


def block_stats(sets: DataFrame) -> DataFrame:
    """set_id, key, card, runs, form, bytes: what each block holds and how it is stored smallest."""
    stats = block_runs(sets).groupBy("set_id", "key").agg(F.sum(F.col("length") + 1).cast("bigint").alias("card"), F.count("*").alias("runs"))
    return stats.withColumn("form", form()).withColumn("bytes", payload_bytes())


def form() -> Column:
    """Container form from card and runs: a run list if it is no larger than an array or bitmap, then an array, then a bitmap."""
    run = 2 + 4 * F.col("runs")
    array = 2 * F.col("card")
    return F.when((run <= array) & (run <= MOST_BYTES), RUN).when(array <= MOST_BYTES, ARRAY).otherwise(BITMAP)


def payload_bytes() -> Column:
    return F.when(F.col("form") == RUN, 2 + 4 * F.col("runs")).when(F.col("form") == ARRAY, 2 * F.col("card")).otherwise(MOST_BYTES).cast("bigint")


def encoding(sets: DataFrame) -> DataFrame:
    """set_id, n, containers, standard_bytes, inline_bytes, encoding, byte_len, num_containers of each set.

    A bitmap starts at a multiple of 64 in the data section; offsets are added up over the blocks of a
    set in key order, at most 65,536 of them.
    """
    items = F.array_sort(F.collect_list(F.struct("key", "form", "bytes")))
    per = block_stats(sets).groupBy("set_id").agg(F.sum("card").alias("n"), F.count("*").alias("containers"), F.max(F.when(F.col("form") == BITMAP, 1).otherwise(0)).alias("bitmaps"), items.alias("items"))
    data = F.expr(f"aggregate(items, 0L, (at, c) -> if(c.form = {BITMAP}, ((at + 63) div 64) * 64, at) + c.bytes)")
    head = F.expr("if(bitmaps = 1, ((16 + 8 * containers + 63) div 64) * 64, ((16 + 8 * containers + 7) div 8) * 8)")
    sized = per.withColumn("standard_bytes", (head + data).cast("bigint")).withColumn("inline_bytes", F.expr("((4 + 4 * n + 7) div 8) * 8").cast("bigint"))
    inline = (F.col("n") <= 65535) & (F.col("inline_bytes") < F.col("standard_bytes"))
    return sized.select(
        "set_id", F.col("n").cast("bigint").alias("n"), "containers", "standard_bytes", "inline_bytes",
        F.when(inline, "inline").otherwise("standard").alias("encoding"),
        F.when(inline, F.col("inline_bytes")).otherwise(F.col("standard_bytes")).alias("byte_len"),
        F.when(inline, 0).otherwise(F.col("containers")).cast("bigint").alias("num_containers"),
    )


def plan_keys(stats: DataFrame, op: str, operands: Sequence[str]) -> DataFrame:
    """key, most: the blocks that an operation on the sets named can touch, and a bound on each result block.

    From block statistics alone. and: blocks of all operands, the smallest card; or: blocks of any, the
    sum (at most a whole block); diff: blocks of the first, its card.
    """
    used = stats.where(F.col("set_id").isin(list(operands)))
    if op == "diff":
        return used.where(F.col("set_id") == operands[0]).select("key", F.col("card").alias("most"))
    per = used.groupBy("key").agg(F.count("*").alias("n"), F.min("card").alias("least"), F.sum("card").alias("total"))
    if op == "and":
        return per.where(F.col("n") == len(set(operands))).select("key", F.col("least").alias("most"))
    return per.select("key", F.least("total", F.lit(65536)).cast("bigint").alias("most"))


def layouts(stats: DataFrame, op: str, operands: Sequence[str]) -> DataFrame:
    """key, most, layout: for each block of plan_keys(), whether an operation is cheaper over 64-bit words or over values.

    A block has at most 1024 words, so words are fewer rows where the operands hold more values than that.
    """
    used = stats.where(F.col("set_id").isin(list(operands))).groupBy("key").agg(F.sum("card").alias("total"))
    layout = F.when(F.col("total") > 1024, "words").otherwise("values")
    return plan_keys(stats, op, operands).join(used, "key").select("key", "most", layout.alias("layout"))


def containers(sets: DataFrame) -> DataFrame:
    """Layout C: set_id, key, form, card, lows (ascending) of each block, at most 65,536 lows a row."""
    lows = spread(sets.select("set_id", key().alias("key"), low().alias("low")), "set_id", "key").distinct()
    return lows.groupBy("set_id", "key").agg(F.array_sort(F.collect_list("low")).alias("lows")).withColumn("card", F.size("lows"))


def container_combine(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """key, lows: two single-set container tables combined block by block with array functions."""
    how = {"and": "inner", "or": "full", "diff": "left"}[op]
    a, b = left.select("key", F.col("lows").alias("a")), right.select("key", F.col("lows").alias("b"))
    none = F.expr("cast(array() as array<int>)")
    both = a.join(b, "key", how).select("key", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    out = {"and": F.array_intersect("a", "b"), "or": F.array_union("a", "b"), "diff": F.array_except("a", "b")}[op]
    return both.select("key", F.array_sort(out).alias("lows")).where(F.size("lows") > 0)


def container_values(blocks: DataFrame) -> DataFrame:
    return blocks.select("key", F.explode("lows").alias("low")).select((F.shiftleft(F.col("key").cast("bigint"), 16) + F.col("low")).alias("value"))
