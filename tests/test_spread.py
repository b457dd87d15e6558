"""Values are dealt to enough tasks, whatever few bytes they take in a shuffle."""

import pytest

from setloom import queries
from setloom.functions import columns
from setloom.operators import blocks

SF = "/root/testdata/sf0.001"


def test_partitions_are_not_coalesced(spark, monkeypatch):
    members = queries.members(spark, SF, "high", "runs")
    for made in (members, blocks.block_runs(members), blocks.containers(members), queries.QUERIES["or_n8_chain"](spark, SF), queries.QUERIES["or_n8"](spark, SF)):
        assert made.rdd.getNumPartitions() >= 8
    monkeypatch.setattr(columns, "PART_BYTES", 2000)
    assert queries.members(spark, SF, "high", "runs").rdd.getNumPartitions() > 8  # more for larger files
    made = spark.createDataFrame([(1,)], "value long")
    assert columns.spread(made, "value").rdd.getNumPartitions() < 10_000  # a table of unknown size


def test_pushes_over_blocks(spark):
    push = lambda *rows: sorted(tuple(r) for r in columns.ascending(spark.createDataFrame(rows, "set_id string, value long, seq long")).collect())
    rows = [("a", v, v * 2) for v in (0, 5, 65535, 65536, 200000, 2**32 - 1)] + [("b", 3, 1), ("b", 70000, 2), (None, 9, 1), (None, 99999, None)]
    with pytest.raises(Exception, match="strictly ascending"):  # null is the first place
        push(*rows)
    assert push(*rows[:-2]) == sorted((s, v) for s, v, _ in rows[:-2])
    for wrong in ([("a", 70000, 1), ("a", 5, 2)], [("a", 5, 1), ("a", 4, 2)], [("a", 5, 1), ("a", 5, 2)], [("a", 1, 1), ("a", 70000, 2), ("a", 2, 3), ("a", 70001, 4)]):
        with pytest.raises(Exception, match="strictly ascending"):
            push(*wrong)
    names = columns.ascending(queries.members(spark, SF, "high", "done").withColumn("seq", columns.F.col("value")))
    assert names.rdd.getNumPartitions() >= 8
