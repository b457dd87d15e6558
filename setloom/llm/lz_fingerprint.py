"""Lempel-Ziv phrase fingerprints.

A text's words (white space apart, long ones in chunks) are parsed into dictionary phrases as LZ78
does: the longest known phrase plus one symbol is a new phrase. The set of phrases is hashed and kept
as a one-permutation minimum-hash signature: the leading bits of a phrase's hash choose one of BINS
bins, the least hash of each bin stays. Two texts that compress each other well share phrases, and
the part of common minima estimates how many.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 7
BINS = 1 << BIN_BITS
EMPTY = "----"
#: Symbols whose hashes a worker keeps; beyond that it starts anew (results do not change).
CACHE_ENTRIES = 300_000
#: Documents in one range of ids, and how many ranges there are at most.
RANGE_ROWS, MOST_RANGES = 2000, 20_000

_symbols = re.compile(r"\S{1,16}").findall
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Parser:
    """Parses symbol lists into phrase hashes; holds the hashes of symbols seen before."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes = np.zeros(1024, dtype=np.uint64)

    def symbol_hashes(self, symbols: list[str]) -> np.ndarray:
        import xxhash

        new = set(symbols).difference(self.known)
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known.clear()
            new = set(symbols)
        if new:
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            while len(self.hashes) < base + len(new):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[base : base + len(new)] = np.array([xxhash.xxh64_intdigest(s) for s in new], dtype=np.uint64)
        return self.hashes[np.fromiter(map(self.known.__getitem__, symbols), np.int64, len(symbols))]

    def phrases(self, symbols: list[str], ends: list[int]) -> np.ndarray:
        """A 64-bit hash of each phrase; phrase k is symbols[ends[k-1]+1 .. ends[k]]."""
        if not ends:
            return np.empty(0, dtype=np.uint64)
        hashes = self.symbol_hashes(symbols)
        stop = np.array(ends) + 1
        start = np.r_[0, stop[:-1]]
        out = np.zeros(len(ends), dtype=np.uint64)
        active, step = np.arange(len(ends)), 0
        while len(active):
            out[active] = out[active] * _STEP + hashes[start[active] + step] + np.uint64(1)
            step += 1
            active = active[start[active] + step < stop[active]]
        out ^= out >> np.uint64(33)
        out *= _MIX1
        out ^= out >> np.uint64(33)
        out *= _MIX2
        return out ^ (out >> np.uint64(33))


def parse(symbols: list[str], root: dict, node: dict, at: int, ends: list[int], log: list | None = None) -> dict:
    """Go on with an LZ78 parse from symbols[at]; returns the open node. log: gets what the dictionary gains."""
    for i in range(at, len(symbols)):
        symbol = symbols[i]
        after = node.get(symbol)
        if after is None:
            node[symbol] = {}
            if log is not None:
                log.append((node, symbol))
            ends.append(i)
            node = root
        else:
            node = after
    return node


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash's low 16 bits of each bin, -1 for an empty bin."""
    hashes = np.sort(hashes)
    at = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS))
    out = np.full(BINS, -1, dtype=np.int32)
    filled = np.flatnonzero(np.diff(np.r_[at, len(hashes)]))
    out[filled] = (hashes[at[filled]] & np.uint64(0xFFFF)).astype(np.int32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common minima by bins filled in either signature; 1 for two empty ones."""
    filled = int(((a >= 0) | (b >= 0)).sum())
    return float(((a == b) & (a >= 0)).sum() / filled) if filled else 1.0


def written(sign: np.ndarray) -> str:
    return "".join(EMPTY if x < 0 else f"{x:04x}" for x in sign.tolist())


def compare_with_edit(parser: Parser, text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of the text whose last quarter is the following one's beginning, and that text.

    The parse up to the last symbol before the edit is shared: it is made once and taken up twice.
    """
    quarter = len(text) // 4
    head = text[: len(text) - quarter]
    edited = head + following[:quarter]
    own, other = _symbols(text), _symbols(edited)
    shared = max(0, len(_symbols(head)) - 1)
    root: dict = {}
    ends: list[int] = []
    node = parse(own[:shared], root, root, 0, ends)
    same = len(ends)
    log: list = []
    parse(own, root, node, shared, ends, log)
    for parent, symbol in reversed(log):
        del parent[symbol]
    edited_ends = ends[:same]
    parse(other, root, node, shared, edited_ends)
    return signature(parser.phrases(own, ends)), signature(parser.phrases(other, edited_ends)), edited


def fingerprint(text: str | None, parser: Parser | None = None) -> np.ndarray:
    symbols, root, ends = _symbols(text or ""), {}, []
    parse(symbols, root, root, 0, ends)
    return signature((parser or Parser()).phrases(symbols, ends))


def _ranged(docs: DataFrame) -> DataFrame:
    """docs by ranges of ids (range), each followed by a copy (tail = 1) of the first document after it."""
    spark = docs.sparkSession
    ids = docs.select("at")
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds = ids.agg(F.percentile_approx("at", [k / ranges for k in range(1, ranges)], 10 * ranges + 100).alias("b")).first()["b"] if ranges > 1 else []
    splits = [-float("inf"), *sorted({float(b) for b in bounds or []}), float("inf")]
    if len(splits) > 2:
        docs = Bucketizer(splits=splits, inputCol="position", outputCol="range").transform(docs.withColumn("position", F.col("at").cast("double"))).drop("position").withColumn("range", F.col("range").cast("int"))
    else:
        docs = docs.withColumn("range", F.lit(0))
    # one row a range: at most MOST_RANGES, so one task may order them and all may have them
    firsts = docs.groupBy("range").agg(F.min("at").alias("first")).withColumnRenamed("range", "own")
    whole = Window.partitionBy()
    before = F.coalesce(F.lag("own").over(Window.orderBy("own")), F.max("own").over(whole))
    firsts = firsts.withColumn("before", before)
    both = docs.join(F.broadcast(firsts), (F.col("range") == F.col("own")) & (F.col("at") == F.col("first")), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("range"), F.lit(0).alias("tail")))).otherwise(F.array(F.struct(F.col("range"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("range"), F.lit(1).alias("tail"))))
    out = both.select("doc_id", "text", "at", F.explode(places).alias("p")).select("p.range", "p.tail", "doc_id", "text", "at")
    return out.repartition(max(len(splits) - 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "range").sortWithinPartitions("range", "tail", "at", "text")


def lz_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next doc_id's, after the last the first; rows of one doc_id go by text,
    a null doc_id comes last. A null text is empty: all bins of its fingerprint are empty, and two
    such fingerprints are alike (1.0). A single document is its own next one; an empty table gives no
    row; other columns are not read. Texts are shuffled once, into ranges of ids; each range also
    gets the first document after it, so no task needs another's rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parser, waiting, rows = Parser(), None, []
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return batch

        previous = None  # (row, signature) of the document before this one, whose next this is
        for batch in batches:
            for where, tail, doc, text in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                text = text or ""
                if waiting is not None and waiting[0] == where:
                    _, doc_before, text_before = waiting
                    sign, edited_sign, edited = compare_with_edit(parser, text_before, text)
                    if previous is not None:
                        rows.append((*previous[0], likeness(previous[1], sign)))
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    previous = ((doc_before, len(text_before), digest, written(sign), written(edited_sign), likeness(sign, edited_sign)), sign)
                    if tail:
                        rows.append((*previous[0], likeness(sign, fingerprint(text, parser))))
                        previous = None
                waiting = None if tail else (where, doc, text)
                if len(rows) >= 500:
                    yield out()
        if rows:
            yield out()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    return _ranged(chosen).select("range", "tail", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
