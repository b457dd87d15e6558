"""Best-fit packing of token sequences by a configuration linear program.

Documents become token ids, longer ones are cut into pieces of at most ``capacity`` ids. Only the
length histogram (at most ``capacity`` counts) reaches the driver. There the configuration LP

    minimise sum_p x_p   subject to   sum_p a[p, l] * x_p >= n[l]

is solved approximately by multiplicative weights: a knapsack dynamic program prices all
configurations at once by the current length weights, a step goes along a good one, and the weights
of the lengths it covers fall. The fractional solution is rounded down, and what it leaves is packed
best-fit decreasing on the histogram. The plan is a table of (length, first rank, ...) rows whose size does
not depend on the number of documents; pieces find their place by their rank among pieces of their
length, computed with bucketed prefix counts.
"""

from __future__ import annotations

import base64
import logging
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tokenizer_file

log = logging.getLogger(__name__)

#: Buckets a length's pieces are spread over while they are ranked.
RANK_BUCKETS = 4096


@lru_cache(maxsize=2)
def encoder(path: str, special: str):
    """A tiktoken encoder over a rank file; the special string inside a text is the id after the last rank."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)} if special else {})


@lru_cache(maxsize=2)
def reference(path: str):
    """The vocabulary's own encoder, whose ids count."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str, ranks: str, vocabulary: str, special: str) -> np.ndarray:
    """The ids of the text. The rank file's encoder gives the same ones several times faster, but raises
    where a run of white space is too long for it (about a million characters); such texts go to the vocabulary's own."""
    try:
        return encoder(tokenizer_file(ranks), special).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(reference(tokenizer_file(vocabulary)).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, ranks: str = "byte_bpe_50k.tiktoken", vocabulary: str = "byte_bpe_50k.json", special: str = "<|endoftext|>") -> DataFrame:
    """Token pieces of every whole text: doc_id, piece, start, length, ids_crc32, bucket.

    A document is its ids followed by end_id, so a null or empty text is that one id. Only a longer
    one than capacity is cut: all its pieces have capacity ids but the first, which may be shorter.
    bucket, below RANK_BUCKETS, spreads the pieces evenly, those of repeated rows too. A null doc_id stays.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(token_ids(text or "", ranks, vocabulary, special), end_id).astype("<u4")
                    end, piece, start = (len(ids) - 1) % capacity + 1, 0, 0
                    while start < len(ids):
                        for column, x in zip(rows, (doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())), strict=True):
                            column.append(x)
                        piece, start, end = piece + 1, end, end + capacity
                # places in a full cycle of all buckets, so that even few rows of a task are spread
                buckets = (np.arange(count, count + len(rows[0])) * 2654435761 % RANK_BUCKETS).astype(np.int32)
                count += len(rows[0])
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], pa.array(buckets)], ["doc_id", "piece", "start", "length", "ids_crc32", "bucket"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int")


def priced(weights: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest weight: counts by length, by an unbounded knapsack over weights[1..capacity]."""
    lengths = np.flatnonzero(weights > 0)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    if not len(lengths):
        return counts
    value, last, gain = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64), weights[lengths]
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        n = upto[room]
        total = value[room - lengths[:n]] + gain[:n]
        k = int(total.argmax())
        if total[k] > value[room - 1]:
            value[room], last[room] = total[k], lengths[k]
        else:
            value[room], last[room] = value[room - 1], 0
    room = capacity
    while room > 0:
        if last[room]:
            counts[last[room]] += 1
            room -= last[room]
        else:
            room -= 1
    return counts


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing on a length histogram: (counts by length, number of sequences) groups."""
    opened: dict[int, list[list]] = {}

    def put(free: int, pattern: dict[int, int], n: int) -> None:
        opened.setdefault(free, []).append([pattern, n])

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = [f for f in opened if f >= length]
            free = min(fits) if fits else capacity
            pattern, bins = opened[free].pop() if fits else ({}, -(-n // (capacity // length)))
            if fits and not opened[free]:
                del opened[free]
            each = free // length
            full = min(bins, n // each)
            if full:
                put(free - each * length, pattern | {length: pattern.get(length, 0) + each}, full)
                n, bins = n - full * each, bins - full
            if bins and n:
                put(free - n * length, pattern | {length: pattern.get(length, 0) + n}, 1)
                n, bins = 0, bins - 1
            if bins and pattern:
                put(free, pattern, bins)
    out = []
    for groups in opened.values():
        for pattern, n in groups:
            counts = np.zeros(capacity + 1, dtype=np.int64)
            for length, k in pattern.items():
                counts[length] = k
            out.append((counts, n))
    return out


def fractional(need: np.ndarray, capacity: int, accuracy: float = 0.02, rate: float = 0.1, steps: int = 20_000) -> tuple[np.ndarray, np.ndarray, float]:
    """An approximate fractional solution of the configuration LP: configurations (rows), times each, and a lower bound on the LP's value.

    Multiplicative weights for covering: a length's weight falls by exp(-rate) each time it is
    covered once over, and one piece of it is worth its weight divided by its need. A step goes along
    a configuration worth at least 1 - rate / 2 of the best, until the length it covers the most,
    relative to its need, is covered once more; lengths covered as often as the theory asks drop out.
    All weights divided by the worth of the best configuration bound the LP from below, as do
    pieces longer than capacity - t, counted whole, with the ids of those from t on, for any t up to half. The first configurations are those of best-fit decreasing. It ends when the value
    is within accuracy of the bound, or after so many steps; the bound tells how far it came.
    """
    lengths = np.flatnonzero(need)
    n = need[lengths].astype(float)
    pool = np.array([c[lengths] for c, _ in best_fit(need, capacity)], dtype=float)
    known = {c.tobytes() for c in pool}
    bound = max(float(n[lengths > capacity - t].sum() + (n * lengths)[(lengths >= t) & (lengths <= capacity - t)].sum() / capacity) for t in range(capacity // 2 + 1))
    times, done, enough = np.zeros(len(pool)), np.zeros(len(n)), np.log(len(n) + 1) / rate**2
    best, least, top = times, np.inf, np.inf
    for step in range(steps):
        weights = np.where(done < enough, np.exp(-rate * (done - done.min())), 0.0)
        worth = pool @ (weights / n)
        k = int(worth.argmax())
        if worth[k] < (1 - rate / 2) * top * weights.sum() or step % 200 == 0:
            prices = np.zeros(capacity + 1)
            prices[lengths] = weights / n
            config = priced(prices, capacity)[lengths].astype(float)
            most = float(config @ (weights / n))
            bound, top = max(bound, float(weights.sum()) / most), most / float(weights.sum())
            if config.tobytes() not in known:
                known.add(config.tobytes())
                pool, times, k = np.vstack([pool, config]), np.append(times, 0.0), len(pool)
        by = 1 / (pool[k] / n).max()
        times[k] += by
        done += by * pool[k] / n
        if done.min() > 0 and times.sum() / done.min() < least:
            best, least = times / done.min(), times.sum() / done.min()
        if least <= (1 + accuracy) * bound or done.min() >= enough:
            break
    return pool[: len(best)], best, bound


def configurations(histogram: dict[int, int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole-numbered solution of the configuration LP: (counts by length, number of sequences) groups.

    Full pieces are their own sequences. The fractional solution is rounded down, its excess left
    out, and what it leaves is packed best-fit decreasing; where best-fit decreasing alone takes no
    more sequences, it is the plan. The plan's size does not depend on the number of pieces; every
    piece is covered exactly once.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[np.ndarray, int]] = []
    if left[capacity]:
        alone = np.zeros(capacity + 1, dtype=np.int64)
        alone[capacity] = 1
        out.append((alone, int(left[capacity])))
        left[capacity] = 0
    if not left.any():
        return out
    plain, lengths = best_fit(left, capacity), np.flatnonzero(left)
    pool, times, bound = fractional(left, capacity)
    fewest = sum(n for _, n in plain)
    rounded: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-times, kind="stable"):
        config = np.zeros(capacity + 1, dtype=np.int64)
        config[lengths] = pool[k]
        used = config > 0
        n = min(int(times[k] + 1e-9), int((left[used] // config[used]).min()))
        if n:
            left[used] -= n * config[used]
            rounded.append((config, n))
    if left.any():
        rounded += best_fit(left, capacity)
    taken = sum(n for _, n in rounded)
    log.info("packing: %d sequences from the LP, %d best-fit decreasing, LP bound %.1f, besides full pieces", taken, fewest, bound)
    return out + (rounded if taken < fewest else plain)


def plan_rows(groups: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, each, sequence_from, offset_from) that place the k-th piece of a length."""
    rows, ranks, sequence = [], {}, 0
    for config, n in groups:
        offset = 0
        for length in np.flatnonzero(config)[::-1].tolist():
            each = int(config[length])
            begin = ranks.get(length, 0)
            ranks[length] = begin + n * each
            rows.append((length, begin, begin + n * each, each, sequence, offset))
            offset += each * length
        sequence += n
    return rows


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Pack all documents into as few sequences of at most capacity ids as the LP finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece, gapless
    from offset 0 in every sequence. Null texts are empty documents (one end id), an empty table
    gives no row, repeated rows are packed each, other columns are not read. The pieces are written
    once to the shared folder; after that only narrow rows are shuffled, by (length, bucket), so that
    one common length is spread over RANK_BUCKETS groups.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity, end_id, ranks), "pieces")  # written, so that buckets are the same wherever it is read
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_rows(configurations(histogram, capacity))
    places = spark.createDataFrame(plan, "length long, rank_from long, rank_to long, each long, sequence_from long, offset_from long")
    before = (
        cut.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        cut.withColumn("k", F.row_number().over(inside) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("k"))
    )
    p = F.broadcast(places.withColumnRenamed("length", "plan_length"))  # at most some thousand rows: see configurations
    inner = F.col("rank") - F.col("rank_from")
    return ranked.join(p, (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence_from") + F.floor(inner / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + (inner % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
