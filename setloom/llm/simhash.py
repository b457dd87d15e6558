"""SimHash near-duplicates with covering locality-sensitive hashing.

A random map sends each of the 64 bit positions to a vector of radius + 1 bits; every non-zero vector
of that space gives a mask of the positions whose scalar product with it is odd. For any two
fingerprints that differ in at most radius positions some vector is orthogonal to all of those
positions, so they agree under its mask: the 2^(radius+1) - 1 tables miss no pair.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components

SEED = 42
#: Masked buckets up to this many different fingerprints are joined with themselves; larger ones are
#: linked through the shared neighbours of their members, which takes time in proportion to the size.
BUCKET_PAIRS = 128

#: Document keys that are broadcast at most, under 60 bytes each.
BROADCAST_ROWS = 1_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 signed 64-bit masks such that any two words within radius agree under one of them."""
    draw = random.Random(seed)
    vectors = [draw.randrange(1, 1 << (radius + 1)) for _ in range(64)]
    masks = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(line, SEED)]
    else:
        begins, at = [], 0
        for word in words:
            begins.append(at)
            at += len(word) + 1
        stops = [*begins[width:], at]
        hashes = [digest(line[b : e - 1], SEED) for b, e in zip(begins, stops, strict=False)]
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        some = np.array(hashes[k : k + (1 << 15)], dtype="<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, *more: Column) -> DataFrame:
    """(doc_id, fp) of every whole text, with more columns; fp is the fingerprint as a signed 64-bit number."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *more, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            kept = batch.num_columns - 1
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(kept)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(prints.view(np.int64))], [*batch.schema.names[:kept], "fp"])

    return slim.mapInArrow(run, f"{schema}, fp long")


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect exactly the different fp values with chains of steps of at most radius bits.

    Within a usual bucket every pair is verified. In a larger one no pair is made: two words at most
    two bits apart share a word at most one bit from either, and all words around one such centre
    are within two bits of each other, so each centre's words are linked to their smallest.
    """
    if radius not in (1, 2):
        raise ValueError("buckets of any size are handled for a radius of 1 or 2")
    different = stored(prints.select("fp").distinct(), "prints")
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for k, m in enumerate(covering_masks(radius))])
    dealt = different.select("fp", F.explode(tables).alias("t")).select("fp", "t.table", "t.bucket")
    sizes = stored(dealt.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    within = dealt.join(sizes, ["table", "bucket"])
    usual = within.where(f"n <= {BUCKET_PAIRS}")
    other = usual.select("table", "bucket", F.col("fp").alias("other"))
    pairs = usual.join(other, ["table", "bucket"]).where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    crowded = within.where(f"n > {BUCKET_PAIRS}").select("fp").distinct()
    steps = [F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]]
    if radius == 1:  # a word and its neighbours: only the centre itself may be shared
        around = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(s) for s in steps])).alias("centre"))
        known = different.select(F.col("fp").alias("centre"))
        return pairs.union(around.join(known, "centre").select(F.col("fp").alias("a"), F.col("centre").alias("b"))).distinct()
    around = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(s) for s in steps])).alias("centre"))
    least = around.groupBy("centre").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("centre", "least")
    stars = around.join(least, "centre").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable by links).

    Null and empty texts have fingerprint zero and link like any other; texts are lower-cased in A-Z
    and split at ASCII white space only, as a whole. Equal fingerprints are one node, so copies make
    no pairs. Repeated rows come out each; rows without doc_id belong to their component but give
    it no id. An empty table gives no row; other columns are not read.
    """
    prints = stored(fingerprints(docs, width), "fingerprints")
    roots = components(links(prints, radius)).withColumnRenamed("node", "fp")
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    labelled = stored(lowest.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    ids = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    named = labelled.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_documents(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """The documents without near-duplicates: doc_id, text, lang, source, n_chars of one row of each group.

    Groups are those of near_duplicates, over rows instead of ids. The row with the smallest doc_id
    stays, null last; of rows with one doc_id that with the least text hash. So rows that
    share a doc_id but not a group all stay, and rows without doc_id stay only if nothing in their group has one. Of rows with
    equal doc_id and text one stays. All null, empty and wordless texts are one group. An empty table gives no row.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h")]
    prints = stored(fingerprints(docs, width, *key), "fingerprints")
    roots = components(links(prints, radius)).withColumnRenamed("node", "fp")
    rows = prints.groupBy("fp", "no_id", "id", "h").agg(F.count("*").alias("n")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rows = stored(rows, "rows")
    place = F.struct("no_id", "id", "h")
    first = rows.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = rows.join(first, "root").where(place != F.col("first")).select(*[F.col(c).alias(f"gone_{c}") for c in ("no_id", "id", "h")])
    gone = stored(gone, "gone")
    keyed = docs.select(*columns, *key)

    def of(table: DataFrame, how: str, prefix: str) -> DataFrame:
        # only the keys of some documents; beyond the bound the documents are shuffled
        some = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
        return keyed.join(some, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{prefix}{c}") for c in ("no_id", "id", "h")]), how)

    several = stored(rows.where("n > 1").select(*[F.col(c).alias(f"twice_{c}") for c in ("no_id", "id", "h")]), "several")
    keyed = of(gone, "left_anti", "gone_")
    once = of(several, "left_anti", "twice_").select(*columns)
    more = of(several, "left_semi", "twice_").dropDuplicates(["no_id", "id", "h"]).select(*columns)
    return once.union(more)


def hamming(a: str, b: str) -> int:
    """Differing bits of two fingerprints in hexadecimal."""
    return reduce(lambda n, x: n + x.bit_count(), [int(a, 16) ^ int(b, 16)], 0)
