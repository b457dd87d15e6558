"""A whole tree as one aggregate.

Every leaf owns a bit. Rows (value, mask) are combined by bit_or, partially before the single
shuffle, and the tree is a predicate on the mask. It is never true for mask 0, because there is no
complement, so values in no leaf need no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import inside, spread
from .tree import And, Diff, Empty, Expr, Leaf, Or, depth, fold, gathered, leaves, program, simplify

WORD = 62  # leaves in one mask column
#: Trees deeper than this are run step by step, as their predicates are too deep for the optimizer.
DEEP = 100


def _scans(used: list[Leaf]) -> list[list[int]]:
    """Leaves by the frame and value they read."""
    scans: dict[tuple, list[int]] = defaultdict(list)
    for k, leaf in enumerate(used):
        scans[leaf.frame_id, leaf.value].append(k)
    return list(scans.values())


def _rows(scan: list[Leaf], *columns: str) -> DataFrame:
    """The rows of one frame that any of its leaves holds, with their checked value and columns."""
    rows, conditions = scan[0].frame, [x.condition for x in scan]
    if None not in conditions:  # one text, which the parser makes a balanced tree of
        rows = rows.where(" OR ".join(f"({c})" for c in conditions))
    return rows.selectExpr(f"{inside(scan[0].value)} AS value", *columns).where("value IS NOT NULL")


def masks(spark: SparkSession, used: list[Leaf], keys: DataFrame | None = None) -> DataFrame:
    """value and m0, m1, ...: which of the leaves hold each value. keys: block keys outside of which nothing is read."""
    n = -(-len(used) // WORD)
    parts = []
    for ks in _scans(used):
        words = []
        for w in range(n):
            bits = [f"CASE WHEN {used[k].condition} THEN {1 << k % WORD}L ELSE 0L END" if used[k].condition else f"{1 << k % WORD}L" for k in ks if k // WORD == w]
            words.append(f"{' | '.join(bits) or '0L'} AS m{w}")
        parts.append(_rows([used[k] for k in ks], *words))
    rows = _within(reduce(DataFrame.union, parts), keys)
    return rows.groupBy("value").agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in range(n)])


def _within(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    if keys is None:
        return rows
    return rows.join(F.broadcast(keys), F.shiftright("value", 16) == F.col("key"), "left_semi")  # at most 65,536 keys, as values are checked


def predicate(tree: Expr, place: dict[Leaf, int]) -> Column:
    """The tree over mask columns; leaf operands of one node are tested together."""
    if depth(tree) > DEEP:
        return _stepwise(program(tree, place), len(place))

    def visit(node: Expr, below: list[Column]) -> Column:
        if isinstance(node, Leaf):
            k = place[node]
            return F.col(f"m{k // WORD}").bitwiseAND(F.lit(1 << k % WORD)) != 0
        if isinstance(node, Diff):
            return below[0] & ~below[1]
        bits: dict[int, int] = defaultdict(int)
        for child in node.children:
            if isinstance(child, Leaf):
                bits[place[child] // WORD] |= 1 << place[child] % WORD
        masked = [(F.col(f"m{w}").bitwiseAND(F.lit(b)), b) for w, b in sorted(bits.items())]
        rest = [c for c, x in zip(below, node.children, strict=True) if not isinstance(x, Leaf)]
        if isinstance(node, And):
            return reduce(lambda a, b: a & b, [m == F.lit(b) for m, b in masked] + rest)
        return reduce(lambda a, b: a | b, [m != 0 for m, _ in masked] + rest)

    return fold(tree, visit, lambda x: (x.left, x.right) if isinstance(x, Diff) else getattr(x, "children", ()))


def _stepwise(steps: list[int], n: int) -> Column:
    """The steps folded over a stack of truth values kept as the bits of one number."""
    words = f"array({', '.join(f'm{w}' for w in range(-(-n // WORD)))})"
    numbers = f"from_json('{list(steps)}', 'array<int>')"  # a constant, made once
    binary = "shiftleft(shiftright(s, 2), 1) | CASE x WHEN -1 THEN s & shiftright(s, 1) & 1 WHEN -2 THEN (s | shiftright(s, 1)) & 1 WHEN -3 THEN shiftright(s, 1) & ~s & 1 ELSE s & ~shiftright(s, 1) & 1 END"
    push = f"shiftleft(s, 1) | (shiftright({words}[x div {WORD}], x % {WORD}) & 1)"
    return F.expr(f"aggregate({numbers}, 0L, (s, x) -> CASE WHEN x >= 0 THEN {push} ELSE {binary} END) = 1")


def evaluate(spark: SparkSession, tree: Expr, keys: DataFrame | None = None) -> DataFrame:
    """The tree's values as a lazy DataFrame; it keeps its plan and can be run many times.

    Values are checked where they are read: ids outside the unsigned 32-bit range raise, null is no
    member. A leaf, or a union of leaves, needs no mask. The rest is one aggregate.
    """
    flat = gathered(simplify(tree))
    if isinstance(flat, Empty):
        return spark.range(0).select(F.col("id").alias("value"))
    used = leaves(flat)
    if isinstance(flat, Leaf) or isinstance(flat, Or) and len(used) == len(flat.children):
        rows = reduce(DataFrame.union, [_rows([used[k] for k in ks]) for ks in _scans(used)])
        return spread(_within(rows, keys), "value").distinct()
    return masks(spark, used, keys).where(predicate(flat, {leaf: k for k, leaf in enumerate(used)})).select("value")


def cached(leaf: Leaf) -> Leaf:
    """The leaf over its distinct values, kept in the executors' memory or disks for the trees that share it; leaf.frame.unpersist() lets them go."""
    return Leaf(leaf.name, _rows([leaf]).distinct().persist())


def block_keys(spark: SparkSession, tree: Expr) -> DataFrame:
    """Block keys that can hold members, from the leaves' keys alone: a superset of the result's blocks."""

    def visit(node: Expr, below: list[Expr]) -> Expr:
        if isinstance(node, Diff):
            return below[0]
        if isinstance(node, And | Or):
            return type(node)(tuple(below))
        return Leaf(node.name, node.frame, f"shiftright({inside(node.value)}, 16)", node.condition) if isinstance(node, Leaf) else node

    return evaluate(spark, fold(simplify(tree), visit)).select(F.col("value").alias("key"))


def counts(spark: SparkSession, trees: dict[str, Expr]) -> DataFrame:
    """Cardinality of many trees over one pool of leaves: (tree, n), from a histogram of masks.

    The values are aggregated to masks once and the masks to counts. The trees, as steps of a stack
    machine, are then run over batches of the histogram with numpy, so the plan is the same for one
    tree and for many thousands.
    """
    flat = {name: simplify(t) for name, t in trees.items()}
    used = list(dict.fromkeys(leaf for t in flat.values() for leaf in leaves(t)))
    if not used:
        return spark.createDataFrame([(n, 0) for n in flat], "tree string, n bigint")
    place = {leaf: k for k, leaf in enumerate(used)}
    words = [f"m{w}" for w in range(-(-len(used) // WORD))]
    histogram = masks(spark, used).groupBy(*words).agg(F.count("*").alias("n"))
    steps = [(name, [] if isinstance(t, Empty) else program(t, place)) for name, t in flat.items()]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(len(steps), dtype=np.int64)
        for batch in batches:
            columns = [batch.column(w).to_numpy() for w in range(len(words))]
            n = batch.column(len(words)).to_numpy()
            held: dict[int, np.ndarray] = {}
            for at, (_, todo) in enumerate(steps):
                stack: list[np.ndarray] = []
                for x in todo:
                    if x >= 0:
                        if x not in held:
                            held[x] = columns[x // WORD] >> x % WORD & 1 == 1
                        stack.append(held[x])
                        continue
                    second, first = stack.pop(), stack.pop()
                    stack.append(first & second if x == -1 else first | second if x == -2 else first & ~second if x == -3 else second & ~first)
                if stack:
                    total[at] += n[stack[0]].sum()
        yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in steps], pa.string()), pa.array(total)], ["tree", "n"])

    parts = histogram.mapInArrow(run, "tree string, n bigint")
    return parts.groupBy("tree").agg(F.sum("n").alias("n"))
