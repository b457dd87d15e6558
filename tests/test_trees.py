"""Trees and flat operators against Python sets."""

import random

import pytest

from setloom.functions.columns import ascending, values
from setloom.operators import intervals, setops
from setloom.plans.compile import counts, evaluate
from setloom.plans.tree import And, Diff, Empty, Leaf, Or, depth, leaves, simplify


@pytest.fixture(scope="module")
def pool(spark):
    rng = random.Random(7)
    sets = [set(rng.sample(range(3000), rng.randint(0, 900))) for _ in range(6)] + [{0, 0xFFFF, 0x10000, 2**32 - 1}, set()]
    return [(s, Leaf(f"s{k}", spark.createDataFrame([(v,) for v in s], "value bigint"))) for k, s in enumerate(sets)]


def of(tree, sets):
    if isinstance(tree, Leaf):
        return sets[tree.name]
    if isinstance(tree, Empty):
        return set()
    if isinstance(tree, Diff):
        return of(tree.left, sets) - of(tree.right, sets)
    parts = [of(c, sets) for c in tree.children]
    if not parts:
        return set()
    return set.intersection(*parts) if isinstance(tree, And) else set.union(*parts)


def drawn(rng, pool, depth):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(pool)[1]
    kids = tuple(drawn(rng, pool, depth - 1) for _ in range(rng.randint(1, 4)))
    kind = rng.choice("aod")
    return And(kids) if kind == "a" else Or(kids) if kind == "o" else Diff(kids[0], kids[-1])


def test_random_trees(spark, pool):
    rng, sets = random.Random(0x7BEE), {leaf.name: s for s, leaf in pool}
    trees = {f"t{k}": drawn(rng, pool, 4) for k in range(120)}
    for t in trees.values():
        assert of(simplify(t), sets) == of(t, sets)
    found = {r["tree"]: r["n"] for r in counts(spark, trees).collect()}
    assert found == {n: len(of(t, sets)) for n, t in trees.items()}
    for t in list(trees.values())[:4]:
        assert sorted(r.value for r in evaluate(spark, t).collect()) == sorted(of(t, sets))


def test_degenerate_and_flat(spark, pool):
    a, b = pool[0][1], pool[1][1]
    assert simplify(And(())) == simplify(Or(())) == simplify(Diff(a, a)) == Empty()
    assert simplify(And((a, And((b, a))))) == And((a, b))
    assert simplify(Diff(Diff(a, b), pool[2][1])) == Diff(a, Or((b, pool[2][1])))
    assert leaves(simplify(And((Diff(a, a), b)))) == []
    for op in ("and", "or", "diff"):
        assert setops.combine(spark, op, []).count() == 0
        frames = [leaf.frame for _, leaf in pool[:3]]
        rows = {s: sorted(r.value for r in setops.combine(spark, op, frames, s).collect()) for s in ("mask", "chain", "sql")}
        sets = [s for s, _ in pool[:3]]
        want = {"and": sets[0] & sets[1] & sets[2], "or": sets[0] | sets[1] | sets[2], "diff": sets[0] - sets[1] - sets[2]}[op]
        assert rows["mask"] == rows["chain"] == rows["sql"] == sorted(want)


def test_leaf_identity(spark):
    """Leaves of different frames are different, whatever their names; conditions on one frame are one scan."""
    a, b = (spark.createDataFrame([(x,) for x in v], "value bigint") for v in ([1, 2], [2, 3]))
    got = lambda t: sorted(r.value for r in evaluate(spark, t).collect())
    assert got(Or((Leaf("s", a), Leaf("s", b)))) == [1, 2, 3]
    assert got(Diff(Leaf("s", a), Leaf("s", b))) == [1]
    held = [Leaf("s", x, "value", "value > 0") for x in (a, b)]
    assert got(Or(tuple(held))) == [1, 2, 3] and got(And(tuple(held))) == [2]
    assert got(And((Leaf("x", a, "value", "value < 2"), Leaf("y", a, "value", "value > 0")))) == [1]
    assert simplify(And((Leaf("x", a), Leaf("y", a)))) == Leaf("x", a)
    with pytest.raises(Exception, match="unsigned"):
        got(Leaf("s", spark.createDataFrame([(-1,)], "value bigint")))


def test_deep_trees(spark, pool):
    """Chains of any depth are rewritten, counted and evaluated without recursion."""
    chain, held = pool[0][1], set(pool[0][0])
    for k in range(10_000):
        s, leaf = pool[1 + k % 5]
        chain, held = (Or((leaf, chain)), held | s) if k % 3 == 0 else (Diff(chain, leaf), held - s) if k % 3 == 1 else (Diff(Or((pool[0][1], leaf)), chain), (pool[0][0] | s) - held)
    assert depth(simplify(chain)) > 1000
    assert sorted(r.value for r in evaluate(spark, chain).collect()) == sorted(held)
    assert [r.n for r in counts(spark, {"deep": chain}).collect()] == [len(held)]


def test_one_exchange(spark, pool):
    tree = And((Or((pool[0][1], pool[1][1])), Diff(pool[2][1], pool[3][1])))
    plan = evaluate(spark, tree)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_domain(spark):
    df = spark.createDataFrame([(1,), (None,), (1,), (2**32 - 1,)], "value bigint")
    assert sorted(r.value for r in values(df).collect()) == [1, 2**32 - 1]
    with pytest.raises(Exception, match="unsigned"):
        values(spark.createDataFrame([(2**32,)], "value bigint")).collect()
    with pytest.raises(Exception, match="ascending"):
        ascending(spark.createDataFrame([("a", 1, 5), ("a", 2, 5)], "set_id string, seq int, value bigint")).collect()


def test_intervals(spark):
    rng = random.Random(3)
    for _ in range(2):
        runs = [sorted({(s := rng.randrange(60_000, 70_000), s + rng.randrange(0, 900))[0:2] for _ in range(12)}) for _ in range(2)]
        a, b = (spark.createDataFrame(r, "start bigint, stop bigint") for r in runs)
        sets = [{v for s, t in r for v in range(s, t + 1)} for r in runs]
        for f, want in ((intervals.intersect, sets[0] & sets[1]), (intervals.union, sets[0] | sets[1]), (intervals.difference, sets[0] - sets[1])):
            assert {v for r in f(a, b).collect() for v in range(r.start, r.stop + 1)} == want
