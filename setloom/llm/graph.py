"""Connected components of link tables by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); root is the smallest node it can reach.

    A round hangs each node's larger neighbours, then its smaller ones, on the smallest of its
    neighbourhood; star-shaped links are the fixed point, reached in O(log n) rounds in practice.
    Aggregates are partial before the shuffle and joins can be split, so a hub with very many links
    is no bottleneck. Every round is a written table. Links of a node to itself, repeated links and
    an empty table are fine; links with a null end are ignored.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = stored(pairs, "links"), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(hung.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        discard(now)
        now = after
        if seen == state:
            break
        seen = state
    stars = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
