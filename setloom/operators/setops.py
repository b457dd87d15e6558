"""N-way intersection, union and difference by three strategies that agree.

mask: one aggregate for any number of operands (one shuffle). chain: semi or anti joins from
the smallest operand on, best when that is small. sql: Spark's own set operations. No operand gives the empty set, one
gives itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import spread
from ..plans.compile import evaluate
from ..plans.tree import And, Diff, Empty, Expr, Leaf, Or
from ..sources.blobs import decode, encode

_CHAIN = {"and": "left_semi", "diff": "left_anti"}


def _tree(op: str, sets: Sequence[DataFrame]) -> Expr:
    nodes = [Leaf(f"operand {k}", df) for k, df in enumerate(sets)]
    if op == "diff":
        return Diff(nodes[0], Or(tuple(nodes[1:]))) if nodes else Empty()
    return (And if op == "and" else Or)(tuple(nodes))


def combine(spark: SparkSession, op: str, sets: Sequence[DataFrame], strategy: str = "mask") -> DataFrame:
    """op is and, or, diff (the first without all others); sets have a value column."""
    sets = [s.select(F.col("value").cast("bigint").alias("value")).where("value is not null") for s in sets]
    if not sets:
        return spark.createDataFrame([], "value bigint")
    if strategy == "mask":
        return evaluate(spark, _tree(op, sets))
    if op == "or":
        return spread(reduce(DataFrame.union, sets), "value").distinct()
    if strategy == "chain":
        if op == "and":  # the smallest first, by the optimizer's estimates
            sets = sorted(sets, key=lambda s: int(str(s._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return reduce(lambda a, b: a.join(b, "value", _CHAIN[op]), sets[1:], sets[0].distinct())
    if strategy == "sql":
        return reduce(DataFrame.intersect if op == "and" else DataFrame.subtract, sets[1:], sets[0].distinct())
    raise ValueError(f"no strategy {strategy}")


def intersect(spark: SparkSession, *sets: DataFrame, strategy: str = "mask") -> DataFrame:
    return combine(spark, "and", sets, strategy)


def union(spark: SparkSession, *sets: DataFrame, strategy: str = "mask") -> DataFrame:
    return combine(spark, "or", sets, strategy)


def difference(spark: SparkSession, *sets: DataFrame, strategy: str = "mask") -> DataFrame:
    return combine(spark, "diff", sets, strategy)


def combine_blobs(spark: SparkSession, op: str, blobs: DataFrame, operands: Sequence[str], set_id: str, standard: bool = False, strategy: str = "mask") -> DataFrame:
    """One row (set_id, payload): and, or, diff of the sets named in blobs (set_id, payload), encoded again.

    No row if the result is empty; an operand that is not there is empty. standard asks for the form
    whose blocks can be read one by one, else the smallest is chosen.
    """
    # a set is decoded by one task, which is not to hold its values
    sets = spread(decode(blobs.where(F.col("set_id").isin(list(operands)))), "value")
    parts = [sets.where(F.col("set_id") == name).select("value") for name in operands]
    return encode(combine(spark, op, parts, strategy).select(F.lit(set_id).alias("set_id"), "value"), standard)
