"""Expressions on values: their block, their place in it, their word; all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = (1 << 32) - 1
#: Bytes of input files for each partition that spread() makes at least.
PART_BYTES = 32 << 20


def key(value: str = "value") -> Column:
    """The block of 65,536 values that a value lies in."""
    return F.shiftright(F.col(value), 16).cast("int")


def low(value: str = "value") -> Column:
    return F.col(value).bitwiseAND(F.lit(0xFFFF)).cast("int")


def word_index(value: str = "value") -> Column:
    return F.shiftright(F.col(value), 6).bitwiseAND(F.lit(1023)).cast("int")


def word_bit(value: str = "value") -> Column:
    """The value's bit in its 64-bit word; bit 63 makes the number negative."""
    return F.expr(f"shiftleft(1L, cast({value} & 63 as int))")


def inside(value: str) -> str:
    """SQL of the value expression as a BIGINT that raises outside the unsigned 32-bit range; null stays null."""
    v = f"cast({value} as bigint)"
    return f"CASE WHEN {v} BETWEEN 0 AND {TOP} THEN {v} WHEN {v} IS NOT NULL THEN cast(raise_error(concat('not an unsigned 32-bit id: ', cast({v} as string))) as bigint) END"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by the columns named to as many partitions as the session has for shuffles, more if its input files are large.

    Shuffled ids take a byte or two each, a hundred once they are in a hash table. Partitions that Spark
    coalesces by their bytes in the shuffle so hold tens of millions; these are not coalesced.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 50)  # that of other tables than files is a very large number
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // PART_BYTES), *by)


def values(df: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """df as a set: one BIGINT column value, distinct, null dropped; out-of-domain ids raise, or are dropped."""
    v = F.col(column).cast("bigint")
    inside = (v >= 0) & (v <= TOP)
    if strict:
        v = F.when(inside | v.isNull(), v).otherwise(F.raise_error(F.concat(F.lit("not an unsigned 32-bit id: "), v.cast("string"))).cast("bigint"))
        return df.select(v.alias("value")).where("value is not null").distinct()
    return df.select(v.alias("value")).where(inside).distinct()


def ascending(df: DataFrame, set_id: str = "set_id", value: str = "value", order: str = "seq") -> DataFrame:
    """(set_id, value) of rows pushed in the order given; raises where a value is not above the one before it.

    Values ascend if they do within each block of 65,536 values and every block is pushed after those before it,
    so no task orders more than a block of a set. Values pushed at one place may come in any order.
    """
    from pyspark.sql import Window

    refused = F.raise_error(F.lit("values must be strictly ascending")).cast("bigint")
    rows = spread(df.select(set_id, value, F.col(order).alias("_order"), F.shiftright(F.col(value).cast("bigint"), 16).alias("_block")), set_id, "_block")
    before = F.lag(value).over(Window.partitionBy(set_id, "_block").orderBy("_order", value))
    ok = before.isNull() | (F.col(value) > before)
    checked = rows.select(set_id, F.when(ok, F.col(value)).otherwise(refused).alias(value))
    # nulls are the first of both, in structs too
    blocks = rows.groupBy(set_id, "_block").agg(F.min(F.struct("_order")).alias("first"), F.max(F.struct("_order")).alias("last"))
    done = F.lag("last").over(Window.partitionBy(set_id).orderBy("_block"))
    late = blocks.withColumn("done", done).where("done > first")
    return checked.union(late.select(set_id, refused.alias(value)))


def extended(sets: DataFrame, more: DataFrame) -> DataFrame:
    """(set_id, value) of sets with the values of more appended; raises where one is not above all values its set has."""
    top = sets.groupBy("set_id").agg(F.max("value").alias("top"))
    after = F.when(F.col("top").isNull() | (F.col("value") > F.col("top")), F.col("value")).otherwise(F.raise_error(F.lit("appended values must be above those of the set")).cast("bigint"))
    appended = more.select("set_id", "value").distinct().join(top, "set_id", "left").select("set_id", after.alias("value"))
    return sets.select("set_id", "value").union(appended)
