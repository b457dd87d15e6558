"""Near-duplicate vectors through an inverted multi-index.

Each half of the unit vectors has its own codebook; the product of the two is a grid of cells. For
every cell, half by half, the distance from a vector to the hyperplane between the cell and its own
one is a lower bound on how far it is to anything inside. Traversal goes through both sorted lists of
bounds, nearest cells first, and stops at the bound beyond which at most 1 - recall of the partners
at exactly the wanted cosine lie; that bound is measured on a bounded sample. Candidates are verified
in double precision by blocked matrix products that give counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components

#: Vectors that the codebooks and the stopping bound are fitted on, at most.
SAMPLE = 20_000
#: Mean number of vectors a cell is planned for, and the largest codebook, as ten sampled vectors a
#: code are the least to fit it on: the grid grows with the table up to MOST_CODES ** 2 * CELL_ROWS vectors.
CELL_ROWS, MOST_CODES = 500, SAMPLE // 10
#: Cells whose block counts are broadcast at most, under 40 bytes each; more are joined by a shuffle.
BROADCAST_CELLS = 1_000_000
#: Members and visitors of a cell that one group compares at most (about).
MEMBERS, VISITORS = 2000, 4000


@dataclass
class MultiIndex:
    """Codebooks of both halves and the bound on the squared distance at which traversal stops."""

    codes: tuple[np.ndarray, np.ndarray]
    stop: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.codes[0].shape[1]
        return x[:, :cut], x[:, cut:]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell, squared bounds to the first half's codes, to the second's) of each row."""
        own, out = [], []
        for part, codes in zip(self.halves(x), self.codes, strict=True):
            d = (codes * codes).sum(1)[None, :] - 2 * part @ codes.T
            near = d.argmin(1)
            gap = d - d[np.arange(len(d)), near][:, None]
            apart = np.sqrt(np.maximum(((codes[:, None, :] - codes[None, :, :]) ** 2).sum(2), 1e-300))[near]
            bound = np.where(gap > 0, gap / (2 * apart), 0.0)
            own.append(near)
            out.append(bound * bound)
        return own[0] * len(self.codes[1]) + own[1], out[0], out[1]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own cell of each row, its number of cells to visit, and those cells, nearest first, of all rows.

        The two halves' bounds are sorted and merged by a multi-sequence traversal: a cell of the i-th
        and the j-th smallest bound follows only what has a smaller place in one list. All rows advance
        together, a cell a step, until the sum of their bounds is beyond the stop.
        """
        own, first, second = self.bounds(x)
        rows, n = first.shape[0], second.shape[1]
        by_first, by_second = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
        a, b = np.take_along_axis(first, by_first, 1), np.take_along_axis(second, by_second, 1)
        a = np.c_[a, np.full(rows, np.inf)]
        # front[r, j]: how many cells with the j-th smallest bound of the second half were visited; the
        # next of each column is the only candidate there, and only the first unvisited column can open
        front = np.zeros((rows, 1), dtype=np.int64)
        live, visited_row, visited_cell = np.arange(rows), [], []
        while len(live):
            width = front.shape[1]
            sums = np.take_along_axis(a[live], front[live], 1) + b[live][:, :width]
            j = sums.argmin(1)
            fine = sums[np.arange(len(live)), j] <= self.stop
            live, j = live[fine], j[fine]
            if not len(live):
                break
            i = front[live, j]
            visited_row.append(live)
            visited_cell.append(by_first[live, i] * n + by_second[live, j])
            front[live, j] += 1
            if width < n and (front[live, width - 1] > 0).any():
                front = np.c_[front, np.zeros(rows, dtype=np.int64)]
        row = np.concatenate(visited_row) if visited_row else np.empty(0, dtype=np.int64)
        cell = np.concatenate(visited_cell) if visited_cell else np.empty(0, dtype=np.int64)
        order = np.argsort(row, kind="stable")
        return own, np.bincount(row, minlength=rows), cell[order]


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    codes = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((codes * codes).sum(1)[None, :] - 2 * x @ codes.T).argmin(1)
        for j in range(len(codes)):
            own = x[near == j]
            if len(own):
                codes[j] = own.mean(0)
    return np.unique(codes, axis=0)


def fit(sample: np.ndarray, rows: int, cosine: float, recall: float, seed: int = 5) -> MultiIndex:
    """Codebooks for about rows / CELL_ROWS cells, and the stopping bound for the target recall.

    The bound is the recall quantile, over the sample, of the bound at which a partner at exactly the
    wanted cosine in a random direction is met; closer partners are met sooner.
    """
    rng = np.random.default_rng(seed)
    k = int(min(MOST_CODES, max(1, round(math.sqrt(rows / CELL_ROWS)))))
    cut = max(1, sample.shape[1] // 2)
    index = MultiIndex((_codebook(sample[:, :cut], k, rng), _codebook(sample[:, cut:], k, rng)), 0.0)
    noise = rng.standard_normal(sample.shape)
    noise -= (noise * sample).sum(1, keepdims=True) * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    partner = cosine * sample + math.sqrt(1 - cosine * cosine) * noise
    home, first, other = index.bounds(sample)
    cell, first_back, other_back = index.bounds(partner)
    at, n = np.arange(len(sample)), len(index.codes[1])
    there = first[at, cell // n] + other[at, cell % n]
    back = first_back[at, home // n] + other_back[at, home % n]
    index.stop = float(np.quantile(np.minimum(there, back), recall)) + 1e-9
    return index


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column, without a Python object a value."""
    import pyarrow as pa

    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], column.type)
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(array.offsets.to_numpy())


def _unit(lists: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """Unit vectors of the values and lengths of rows, zeros behind the shorter ones."""
    values, lengths = lists
    x = np.zeros((len(lengths), max(2, width)))
    row = np.repeat(np.arange(len(lengths)), lengths)
    x[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    x /= np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each the index of a smaller or equal node) after a and b are linked pairwise."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        for end in (a, b):
            np.minimum.at(labels, before[end], low)
            np.minimum.at(labels, end, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
        left = labels[a] != labels[b]
        a, b = a[left], b[left]
    return labels


def compare(index: MultiIndex, width: int, cosine: float, table):
    """Links between visitors and members of one block: (a, b, n), counts with b null and forest links with n 0."""
    import pyarrow as pa

    ids, copies, member = (table[c].to_numpy() for c in ("id", "copies", "member"))
    lists = _lists(table["vector"])
    lengths, x = lists[1], _unit(lists, width)
    m, v = np.flatnonzero(member), np.flatnonzero(~member)
    nodes, node = np.unique(ids, return_inverse=True)
    counts, labels = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
    if len(m) and len(v):
        home, first, second = index.bounds(x)
        n2 = len(index.codes[1])
        for k in range(0, len(v), 500):
            q = v[k : k + 500]
            at_q, at_m = np.nonzero(x[q] @ x[m].T >= cosine)
            a, b = q[at_q], m[at_m]
            fine = (ids[a] != ids[b]) & (lengths[a] == lengths[b])
            a, b = a[fine], b[fine]
            np.add.at(counts, node[a], copies[b])
            # a member that does not itself visit the visitor's cell learns of the link here
            if not len(a):
                continue
            blind = first[b, home[a] // n2] + second[b, home[a] % n2] > index.stop
            np.add.at(counts, node[b[blind]], copies[a[blind]])
            labels = _join(labels, node[a], node[b])
    hung, counted = np.flatnonzero(labels != np.arange(len(nodes))), np.flatnonzero(counts)
    return pa.table(
        {
            "a": pa.array(np.r_[nodes[hung], nodes[counted]]),
            "b": pa.array([*nodes[labels[hung]].tolist(), *[None] * len(counted)], pa.int64()),
            "n": pa.array(np.r_[np.zeros(len(hung), dtype=np.int64), counts[counted]]),
        }
    )


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept: near-duplicates by cosine over all rows.

    n_links counts the other vectors linked directly, component_id is the smallest vec_id reachable,
    kept says whether that is the row's own. Equal vectors are one node whose copies are counted, not
    paired. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Rows without vec_id link with nothing. An empty
    table gives no row; other columns are not read.
    """
    spark = vectors.sparkSession
    good = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and x > float('-inf') and x < float('inf')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = rows.where(good)
    nodes = stored(usable.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
    size = nodes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if size["n"] == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = int(size["width"])
    sample = [r["embedding"] for r in nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()]
    lengths = np.array([len(v) for v in sample])
    index = fit(_unit((np.array([x for v in sample for x in v], dtype=np.float64), lengths), width), size["n"], cosine, recall)

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own, n, cells = index.visits(_unit(_lists(part.column(2)), width))
                cells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(cells, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int64()), cells], ["id", "copies", "vector", "home", "cells"])

    kind = dict(nodes.dtypes)["embedding"]
    placed = stored(nodes.select("id", "copies", F.col("embedding").alias("vector")).mapInArrow(assign, f"id long, copies long, vector {kind}, home long, cells array<long>"), "placed")
    members = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / MEMBERS).alias("m_blocks"))
    visitors = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).alias("v_blocks"))
    blocks = members.join(visitors, "cell")
    if len(index.codes[0]) * len(index.codes[1]) <= BROADCAST_CELLS:
        blocks = F.broadcast(blocks)
    deal = F.xxhash64("id")
    as_member = placed.select("id", "copies", "vector", F.col("home").alias("cell")).join(blocks, "cell").select("cell", F.pmod(deal, "m_blocks").alias("m"), F.explode(F.expr("sequence(0L, v_blocks - 1)")).alias("v"), F.lit(True).alias("member"), "id", "copies", "vector")
    as_visitor = placed.select("id", "copies", "vector", F.explode("cells").alias("cell")).join(blocks, "cell").select("cell", F.explode(F.expr("sequence(0L, m_blocks - 1)")).alias("m"), F.pmod(deal, "v_blocks").alias("v"), F.lit(False).alias("member"), "id", "copies", "vector")
    found = stored(as_member.union(as_visitor).groupBy("cell", "m", "v").applyInArrow(lambda table: compare(index, width, cosine, table), "a long, b long, n long"), "found")
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("id"), "root")
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    named = nodes.join(counts, "id", "left").join(roots, "id", "left").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked = usable.join(named, "embedding").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where(f"not coalesce({good}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)
