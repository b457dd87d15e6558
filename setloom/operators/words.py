"""Layout W: 64-bit words of sets and word-level algebra, for dense sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import key, word_bit, word_index


def to_words(sets: DataFrame) -> DataFrame:
    """set_id, key, w, word: a value is bit value & 63 of word (value >> 6) & 1023 of block value >> 16."""
    return sets.select("set_id", key().alias("key"), word_index().alias("w"), word_bit().alias("bit")).groupBy("set_id", "key", "w").agg(F.bit_or("bit").alias("word"))


def to_values(words: DataFrame) -> DataFrame:
    """The values of words (key, w, word and any set_id)."""
    kept = ["set_id"] if "set_id" in words.columns else []
    bits = words.select(*kept, "key", "w", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where(F.expr("getbit(word, i) = 1"))
    return bits.select(*kept, (F.shiftleft(F.col("key").cast("bigint"), 16) + F.shiftleft("w", 6) + F.col("i")).alias("value"))


def combine_words(words: DataFrame, op: str, operands: Sequence[str]) -> DataFrame:
    """key, w, word of and, or, diff over the sets named: one aggregate over their words."""
    used = words.where(F.col("set_id").isin(list(operands))).groupBy("key", "w")
    if op == "or":
        return used.agg(F.bit_or("word").alias("word"))
    if op == "and":
        return used.agg(F.bit_and("word").alias("word"), F.count("*").alias("n")).where((F.col("n") == len(set(operands))) & (F.col("word") != 0)).select("key", "w", "word")
    first, rest = F.when(F.col("set_id") == operands[0], F.col("word")), F.when(F.col("set_id") != operands[0], F.col("word"))
    both = used.agg(F.bit_or(first).alias("a"), F.bit_or(rest).alias("b")).where("a is not null")
    return both.select("key", "w", F.col("a").bitwiseAND(F.bitwise_not(F.coalesce("b", F.lit(0)))).alias("word")).where("word <> 0")


def cardinality(words: DataFrame) -> DataFrame:
    """set_id, n from popcounts."""
    return words.groupBy("set_id").agg(F.sum(F.bit_count("word")).cast("bigint").alias("n"))


def runs_to_words(runs: DataFrame) -> DataFrame:
    """key, w, word of runs (start, stop inclusive) that may overlap: a row a word that a run touches, set from its first to its last bit there."""
    touched = runs.select("start", "stop", F.explode(F.sequence(F.shiftright("start", 6), F.shiftright("stop", 6))).alias("n"))
    first = F.expr("cast(greatest(start, n * 64) - n * 64 as int)")
    last = F.expr("cast(least(stop, n * 64 + 63) - n * 64 as int)")
    bits = touched.select("n", first.alias("first"), last.alias("last"))
    word = F.expr("shiftleft(-1L, first) & shiftrightunsigned(-1L, 63 - last)")
    return bits.select(F.shiftright("n", 10).cast("int").alias("key"), F.col("n").bitwiseAND(F.lit(1023)).cast("int").alias("w"), word.alias("word")).groupBy("key", "w").agg(F.bit_or("word").alias("word"))


def set_words(words: DataFrame, more: DataFrame) -> DataFrame:
    """key, w, word with the bits of more set too."""
    return words.select("key", "w", "word").union(more.select("key", "w", "word")).groupBy("key", "w").agg(F.bit_or("word").alias("word"))


def clear_words(words: DataFrame, less: DataFrame) -> DataFrame:
    """key, w, word without the bits of less; words left empty go."""
    gone = less.groupBy("key", "w").agg(F.bit_or("word").alias("gone"))
    kept = words.select("key", "w", "word").join(gone, ["key", "w"], "left")
    return kept.select("key", "w", F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("gone", F.lit(0)))).alias("word")).where("word <> 0")


def filter_values(values: DataFrame, words: DataFrame, keep: bool = True) -> DataFrame:
    """The values (column value) whose bit is set in words, or not set."""
    v = values.select("value", key().alias("key"), word_index().alias("w"))
    bit = v.join(words.select("key", "w", "word"), ["key", "w"], "left").withColumn("held", F.expr("coalesce(getbit(word, cast(value & 63 as int)), 0) = 1"))
    return bit.where(F.col("held") if keep else ~F.col("held")).select("value")
