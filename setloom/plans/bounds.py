"""What can be said of a tree before it is run: for every block, the most values the result can hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import block_stats
from .compile import _rows
from .tree import And, Diff, Empty, Expr, Leaf, fold, leaves, simplify


def tree_bounds(spark: SparkSession, tree: Expr) -> DataFrame:
    """key, most, layout: the blocks the tree's result can lie in, the most values it has there, and the layout that suits.

    From the leaves' block counts alone, by one aggregate over blocks, at most 65,536 of them: an AND has
    at most its smallest operand's values and none where one has no block, an OR at most the sum, a
    difference at most its left side's. Blocks with more than 4096 values at most suit words, others values.
    """
    flat = simplify(tree)
    if isinstance(flat, Empty):
        return spark.createDataFrame([], "key int, most bigint, layout string")
    used = leaves(flat)
    place = {leaf: k for k, leaf in enumerate(used)}
    sets = reduce(DataFrame.union, [_rows([x]).select(F.lit(k).alias("set_id"), "value") for k, x in enumerate(used)])
    stats = block_stats(sets)
    cards = stats.groupBy("key").agg(*[F.coalesce(F.sum(F.when(F.col("set_id") == k, F.col("card"))), F.lit(0)).alias(f"c{k}") for k in range(len(used))])

    def visit(node: Expr, below: list[Column]) -> Column:
        if isinstance(node, Leaf):
            return F.col(f"c{place[node]}")
        if isinstance(node, Diff):
            return below[0]
        if isinstance(node, And):
            return F.least(*below)
        return F.least(reduce(lambda a, b: a + b, below), F.lit(65536))

    most = cards.select("key", fold(flat, visit).cast("bigint").alias("most")).where("most > 0")
    return most.withColumn("layout", F.when(F.col("most") > 4096, "words").otherwise("values"))
