"""Registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns
from .operators import blocks, intervals, reads, setops, words
from .plans.bounds import tree_bounds
from .plans.compile import block_keys, cached, counts, evaluate
from .plans.tree import And, Diff, Expr, Leaf, Or
from .sources import blobs, roaring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Sets by name: table, value, condition; the SQL is both Spark's and DuckDB's.
SETS = {
    "high": ("orders", "o_orderkey", "o_totalprice > 100000"),
    "very_high": ("orders", "o_orderkey", "o_totalprice > 250000"),
    "done": ("orders", "o_orderkey", "o_orderstatus = 'F'"),
    "open": ("orders", "o_orderkey", "o_orderstatus = 'O'"),
    "partial": ("orders", "o_orderkey", "o_orderstatus = 'P'"),
    "low_priority": ("orders", "o_orderkey", "o_orderpriority = '5-LOW'"),
    "urgent": ("orders", "o_orderkey", "o_orderpriority = '1-URGENT'"),
    "orders": ("orders", "o_orderkey", "o_orderkey >= 0"),
    "returned": ("lineitem", "l_orderkey", "l_returnflag = 'R'"),
    "accepted": ("lineitem", "l_orderkey", "l_returnflag = 'A'"),
    "bulk": ("lineitem", "l_orderkey", "l_quantity > 40"),
    "discounted": ("lineitem", "l_orderkey", "l_discount > 0.05"),
    "nothing": ("orders", "o_orderkey", "o_totalprice < 0"),
    "scattered": ("lineitem", "(l_orderkey * 2654435761) % 4294967296", "l_returnflag = 'R'"),
    "scattered_bulk": ("lineitem", "(l_orderkey * 2654435761) % 4294967296", "l_quantity > 40"),
    "arrays": ("lineitem", "(l_orderkey * 2654435761) % 1048576", "l_returnflag = 'R'"),
    "arrays_bulk": ("lineitem", "(l_orderkey * 2654435761) % 1048576", "l_quantity > 40"),
    "bitmaps": ("lineitem", "l_orderkey * 8 + l_linenumber", "l_returnflag = 'R'"),
    "bitmaps_bulk": ("lineitem", "l_orderkey * 8 + l_linenumber", "l_quantity > 25"),
    "stretches": ("orders", "o_orderkey * 3 + 65000", "o_orderkey % 1000 < 700"),
    "runs": ("orders", "o_orderkey + 65000", "o_orderkey % 1000 < 700"),
    "other_runs": ("orders", "o_orderkey + 65000", "o_orderkey % 777 < 400"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leaf(spark: SparkSession, sf_dir: str, name: str, tables: dict[str, DataFrame]) -> Leaf:
    source, value, condition = SETS[name]
    if source not in tables:
        tables[source] = table(spark, sf_dir, source)
    return Leaf(name, tables[source], value, condition)


def rows(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """set_id, value rows of the sets named, repeats included."""
    out = None
    for name in names:
        source, value, condition = SETS[name]
        part = table(spark, sf_dir, source).where(condition).select(F.lit(name).alias("set_id"), F.expr(value).cast("bigint").alias("value"))
        out = part if out is None else out.union(part)
    return out


def members(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """set_id, value rows of the sets named, each distinct."""
    return columns.spread(rows(spark, sf_dir, *names), "set_id", "value").distinct()


def leaf_sql(name: str) -> str:
    source, value, condition = SETS[name]
    return f"SELECT DISTINCT CAST({value} AS BIGINT) AS value FROM {source} WHERE {condition}"


def members_sql(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS set_id, value FROM ({leaf_sql(n)})" for n in names)


# trees are written once, as nested tuples, and read both ways
def build(spark: SparkSession, sf_dir: str, spec, tables: dict[str, DataFrame] | None = None) -> Expr:
    """The tree of a spec; tables holds the frames made so far, one a table."""
    tables = {} if tables is None else tables
    if isinstance(spec, str):
        return leaf(spark, sf_dir, spec, tables)
    op, *rest = spec
    nodes = tuple(build(spark, sf_dir, x, tables) for x in rest)
    if op == "diff":
        return Diff(*nodes)
    return (And if op == "and" else Or)(nodes)


def tree_sql(spec) -> str:
    if isinstance(spec, str):
        return leaf_sql(spec)
    word = {"and": " INTERSECT ", "or": " UNION ", "diff": " EXCEPT "}[spec[0]]
    return "SELECT value FROM (" + word.join(f"(SELECT value FROM ({tree_sql(x)}))" for x in spec[1:]) + ")"


_EIGHT = ("high", "done", "returned", "accepted", "bulk", "discounted", "low_priority", "urgent")
TREES = {
    "tree_filter": ("and", "high", ("or", "done", "partial"), ("diff", "orders", "low_priority")),
    "tree_cnf3": ("and", ("or", "done", "open"), ("or", "returned", "bulk"), ("or", "urgent", "discounted")),
    "tree_dnf": ("or", ("and", "done", "returned", "bulk"), ("and", "open", "discounted"), ("and", "urgent", "accepted")),
    "tree_conj5": ("and", ("and", "high", "done"), ("and", "returned", ("and", "bulk", "discounted"))),
    "tree_diff_chain": ("diff", ("diff", ("diff", "orders", "returned"), "urgent"), "done"),
    "tree_right_diff": ("diff", "orders", ("diff", "returned", ("diff", "bulk", "urgent"))),
    "tree_short_circuit": ("and", ("diff", "high", "high"), ("or", "done", "open", "partial")),
    "tree_empty_left": ("diff", ("diff", "high", "high"), "orders"),
    "tree_shared": ("diff", ("or", ("and", "high", "done"), ("and", "high", "open")), ("and", "high", "urgent")),
    "tree_absorb": ("and", ("or", ("diff", "high", "high"), "orders"), "orders"),
}

FLAT = {
    "and2": ("and", ("high", "done")),
    "and_n4": ("and", ("high", "done", "returned", "bulk")),
    "and_n8": ("and", ("orders", "high", "done", "returned", "accepted", "bulk", "discounted", "orders")),
    "and_with_empty": ("and", ("high", "nothing")),
    "and_single": ("and", ("high",)),
    "or2": ("or", ("very_high", "urgent")),
    "or_n8": ("or", _EIGHT),
    "or_disjoint": ("or", ("done", "open", "partial")),
    "or_dup_operand": ("or", ("high", "high")),
    "or_single": ("or", ("urgent",)),
    "diff2": ("diff", ("high", "done")),
    "diff_n8": ("diff", ("orders", "very_high", "urgent", "low_priority", "partial", "nothing", "returned", "accepted")),
    "diff_self": ("diff", ("high", "high")),
    "diff_single": ("diff", ("high",)),
}


def _flat(op: str, names: tuple[str, ...], strategy: str):
    if strategy == "mask":  # predicates over one table are one scan
        return lambda spark, sf: evaluate(spark, build(spark, sf, (op, *names) if op != "diff" else names[0] if len(names) == 1 else ("diff", names[0], ("or", *names[1:]))))
    return lambda spark, sf: setops.combine(spark, op, [rows(spark, sf, n).select("value") for n in names], strategy)


for _name, (_op, _names) in FLAT.items():
    QUERIES[_name] = _flat(_op, _names, "mask")
    ORACLES[_name] = tree_sql((_op, *_names)) if len(_names) > 1 else leaf_sql(_names[0])
for _name in ("and_n4", "or_n8", "diff_n8"):
    for _strategy in ("chain", "sql"):
        QUERIES[f"{_name}_{_strategy}"] = _flat(*FLAT[_name], _strategy)
        ORACLES[f"{_name}_{_strategy}"] = ORACLES[_name]
for _name, _spec in TREES.items():
    QUERIES[_name] = lambda spark, sf, spec=_spec: evaluate(spark, build(spark, sf, spec))
    ORACLES[_name] = tree_sql(_spec)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("tree_holepunch", tree_sql(("and", "runs", ("or", "scattered", "bitmaps"), ("or", "arrays", "stretches", "runs"))))
def _holepunch(spark, sf):
    """Wide operands are read only in the blocks that can survive."""
    tree = build(spark, sf, ("and", "runs", ("or", "scattered", "bitmaps"), ("or", "arrays", "stretches", "runs")))
    return evaluate(spark, tree, block_keys(spark, tree))


_HUNDRED = [("orders", "o_orderkey", f"o_orderkey % 100 = {k} and o_totalprice > {1000 * k}") for k in range(100)]


@query("tree_100_leaves", " UNION ".join(f"SELECT CAST({v} AS BIGINT) AS value FROM {t} WHERE {c}" for t, v, c in _HUNDRED))
def _hundred(spark, sf):
    orders = table(spark, sf, "orders")
    return evaluate(spark, Or(tuple(Leaf(f"h{k}", orders, v, c) for k, (_, v, c) in enumerate(_HUNDRED))))


_POOL = {**TREES, "or_all": ("or", *_EIGHT), "and_all": ("and", *_EIGHT)}


@query("corpus_counts", " UNION ALL ".join(f"SELECT '{n}' AS tree, count(*) AS n FROM ({tree_sql(s)})" for n, s in _POOL.items()))
def _corpus(spark, sf):
    """Cardinalities of many trees from one histogram of masks."""
    tables: dict[str, DataFrame] = {}
    return counts(spark, {n: build(spark, sf, s, tables) for n, s in _POOL.items()})


_READ = ("high", "very_high", "done", "scattered", "bitmaps", "runs")


@query("contains_probe", f"SELECT p.set_id, p.value, EXISTS(SELECT 1 FROM ({members_sql(*_READ)}) m WHERE m.set_id = p.set_id AND m.value = p.value) AS found FROM (SELECT s.set_id, CAST(c_custkey * 7 AS BIGINT) AS value FROM customer, (VALUES {', '.join(f"('{n}')" for n in _READ)}) s(set_id)) p")
def _contains(spark, sf):
    names = F.explode(F.array(*[F.lit(n) for n in _READ])).alias("set_id")
    probes = table(spark, sf, "customer").select(names, (F.col("c_custkey") * 7).cast("bigint").alias("value"))
    return reads.contains(probes, members(spark, sf, *_READ))


_IDS = ", ".join(f"('{n}')" for n in (*_READ, "nothing"))


@query("card_min_max", f"SELECT i.set_id, count(m.value) AS n, min(m.value) AS lo, max(m.value) AS hi, count(m.value) = 0 AS is_empty FROM (VALUES {_IDS}) i(set_id) LEFT JOIN ({members_sql(*_READ, 'nothing')}) m ON m.set_id = i.set_id GROUP BY i.set_id")
def _summary(spark, sf):
    return reads.summary(members(spark, sf, *_READ, "nothing"), spark.createDataFrame([(n,) for n in (*_READ, "nothing")], "set_id string"))


@query("iter_sorted", f"SELECT set_id, value FROM ({members_sql('very_high', 'runs')}) ORDER BY set_id, value")
def _sorted(spark, sf):
    return reads.ordered(members(spark, sf, "very_high", "runs"))


@query("set_equality", f"WITH a AS ({members_sql('high', 'done')}), b AS (SELECT 'high' AS set_id, value FROM ({leaf_sql('high')}) UNION ALL SELECT 'done', value FROM ({leaf_sql('open')})) SELECT set_id, NOT EXISTS((SELECT value FROM a WHERE a.set_id = s.set_id EXCEPT SELECT value FROM b WHERE b.set_id = s.set_id) UNION ALL (SELECT value FROM b WHERE b.set_id = s.set_id EXCEPT SELECT value FROM a WHERE a.set_id = s.set_id)) AS equal FROM (VALUES ('high'), ('done')) s(set_id)")
def _equality(spark, sf):
    right = members(spark, sf, "high").union(members(spark, sf, "open").select(F.lit("done").alias("set_id"), "value"))
    return reads.equality(members(spark, sf, "high", "done"), right)


@query("set_digest", f"SELECT set_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, min(value) AS lo, max(value) AS hi, bit_xor((value * 2654435761) & 9007199254740991) AS mixed FROM ({members_sql('high', 'done', 'bitmaps', 'runs')}) GROUP BY set_id")
def _digest(spark, sf):
    return reads.digest(members(spark, sf, "high", "done", "bitmaps", "runs"))


_FORMS = ("scattered", "arrays", "bitmaps", "runs", "stretches", "high")
_RUNS = f"SELECT set_id, key, min(low) AS start, max(low) - min(low) AS length FROM (SELECT set_id, key, low, low - row_number() OVER (PARTITION BY set_id, key ORDER BY low) AS island FROM (SELECT set_id, value >> 16 AS key, value & 65535 AS low FROM ({members_sql(*_FORMS)}))) GROUP BY set_id, key, island"
_STATS = f"SELECT set_id, key, CAST(sum(length + 1) AS BIGINT) AS card, count(*) AS runs FROM ({_RUNS}) GROUP BY set_id, key"
_FORM = f"SELECT *, CASE WHEN 2 + 4 * runs <= 2 * card AND 2 + 4 * runs <= 8192 THEN 2 WHEN 2 * card <= 8192 THEN 0 ELSE 1 END AS form FROM ({_STATS})"
_BYTES = f"SELECT *, CAST(CASE form WHEN 2 THEN 2 + 4 * runs WHEN 0 THEN 2 * card ELSE 8192 END AS BIGINT) AS bytes FROM ({_FORM})"


@query("block_stats", f"SELECT set_id, CAST(key AS INTEGER) AS key, card, runs FROM ({_STATS})")
def _block_stats(spark, sf):
    return blocks.block_stats(members(spark, sf, *_FORMS)).select("set_id", "key", "card", "runs")


@query("container_form", f"SELECT set_id, CAST(key AS INTEGER) AS key, CAST(form AS INTEGER) AS form, bytes FROM ({_BYTES})")
def _form(spark, sf):
    return blocks.block_stats(members(spark, sf, *_FORMS)).select("set_id", "key", "form", "bytes")


# payload offsets without a loop: non-bitmaps add up between bitmaps, which start at multiples of 64
@query("encoding_choice", f"""
WITH RECURSIVE b AS (SELECT set_id, form, bytes, card, row_number() OVER (PARTITION BY set_id ORDER BY key) AS i, count(*) OVER (PARTITION BY set_id) AS c, max(CASE WHEN form = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY set_id) AS bm FROM ({_BYTES})),
w AS (SELECT set_id, i, c, bm, CAST(bytes AS BIGINT) AS at FROM b WHERE i = 1 UNION ALL SELECT b.set_id, b.i, b.c, b.bm, CAST(CASE WHEN b.form = 1 THEN (w.at + 63) // 64 * 64 ELSE w.at END + b.bytes AS BIGINT) FROM w JOIN b ON b.set_id = w.set_id AND b.i = w.i + 1),
s AS (SELECT w.set_id, w.c AS containers, CAST(w.at + CASE WHEN bm = 1 THEN (16 + 8 * c + 63) // 64 * 64 ELSE (16 + 8 * c + 7) // 8 * 8 END AS BIGINT) AS standard_bytes FROM w WHERE i = c),
t AS (SELECT set_id, CAST(sum(card) AS BIGINT) AS n FROM b GROUP BY set_id)
SELECT set_id, n, containers, standard_bytes, (4 + 4 * n + 7) // 8 * 8 AS inline_bytes, CASE WHEN n <= 65535 AND (4 + 4 * n + 7) // 8 * 8 < standard_bytes THEN 'inline' ELSE 'standard' END AS encoding,
CASE WHEN n <= 65535 AND (4 + 4 * n + 7) // 8 * 8 < standard_bytes THEN (4 + 4 * n + 7) // 8 * 8 ELSE standard_bytes END AS byte_len,
CASE WHEN n <= 65535 AND (4 + 4 * n + 7) // 8 * 8 < standard_bytes THEN 0 ELSE containers END AS num_containers FROM s JOIN t USING (set_id)""")
def _encoding(spark, sf):
    return blocks.encoding(members(spark, sf, *_FORMS))


@query("run_list", f"SELECT set_id, min(value) AS start, max(value) AS stop FROM (SELECT set_id, value, value - row_number() OVER (PARTITION BY set_id ORDER BY value) AS island FROM ({members_sql(*_FORMS)})) GROUP BY set_id, island")
def _run_list(spark, sf):
    return blocks.runs(members(spark, sf, *_FORMS))


_OPS = ("arrays", "arrays_bulk", "bitmaps")
_OP_STATS = _STATS.replace(members_sql(*_FORMS), members_sql(*_OPS))
_PLANS = {
    "and": f"SELECT CAST(key AS INTEGER) AS key, min(card) AS most FROM ({_OP_STATS}) GROUP BY key HAVING count(*) = 3",
    "or": f"SELECT CAST(key AS INTEGER) AS key, CAST(least(sum(card), 65536) AS BIGINT) AS most FROM ({_OP_STATS}) GROUP BY key",
    "diff": f"SELECT CAST(key AS INTEGER) AS key, card AS most FROM ({_OP_STATS}) WHERE set_id = 'arrays'",
}
for _op, _text in _PLANS.items():
    QUERIES[f"plan_{_op}_keys"] = lambda spark, sf, op=_op: blocks.plan_keys(blocks.block_stats(members(spark, sf, *_OPS)), op, _OPS)
    ORACLES[f"plan_{_op}_keys"] = _text

for _op in ("and", "or", "diff"):
    QUERIES[f"words_{_op}"] = lambda spark, sf, op=_op: words.to_values(words.combine_words(words.to_words(members(spark, sf, "bitmaps", "bitmaps_bulk")), op, ("bitmaps", "bitmaps_bulk")))
    ORACLES[f"words_{_op}"] = tree_sql((_op, "bitmaps", "bitmaps_bulk"))
    QUERIES[f"arrays_{_op}"] = lambda spark, sf, op=_op: blocks.container_values(blocks.container_combine(blocks.containers(members(spark, sf, "arrays")), blocks.containers(members(spark, sf, "arrays_bulk")), op))
    ORACLES[f"arrays_{_op}"] = tree_sql((_op, "arrays", "arrays_bulk"))
    _how = {"and": "intersect", "or": "union", "diff": "difference"}[_op]
    QUERIES[f"run_{_how}"] = lambda spark, sf, how=_how: getattr(intervals, how)(blocks.runs(members(spark, sf, "runs")), blocks.runs(members(spark, sf, "other_runs")))
    ORACLES[f"run_{_how}"] = f"SELECT min(value) AS start, max(value) AS stop FROM (SELECT value, value - row_number() OVER (ORDER BY value) AS island FROM ({tree_sql((_op, 'runs', 'other_runs'))})) GROUP BY island"


@query("words_cardinality", f"SELECT set_id, count(*) AS n FROM ({members_sql('bitmaps', 'bitmaps_bulk', 'runs')}) GROUP BY set_id")
def _popcount(spark, sf):
    return words.cardinality(words.to_words(members(spark, sf, "bitmaps", "bitmaps_bulk", "runs")))


for _keep in (True, False):
    QUERIES["filter_by_runs" if _keep else "drop_by_runs"] = lambda spark, sf, keep=_keep: intervals.filter_values(members(spark, sf, "bitmaps").select("value"), blocks.runs(members(spark, sf, "runs")), keep)
    ORACLES["filter_by_runs" if _keep else "drop_by_runs"] = tree_sql(("and" if _keep else "diff", "bitmaps", "runs"))


@query("expand_runs", leaf_sql("runs"))
def _expand(spark, sf):
    return intervals.expand(blocks.runs(members(spark, sf, "runs")))


@query("roundtrip_blob", members_sql(*_FORMS))
def _roundtrip(spark, sf):
    return blobs.decode(blobs.encode(members(spark, sf, *_FORMS)))


@query("blob_validity", f"SELECT set_id, true AS is_valid, count(*) AS n FROM ({members_sql(*_FORMS)}) GROUP BY set_id")
def _validity(spark, sf):
    return blobs.validity(blobs.encode(members(spark, sf, *_FORMS)))


@query("roundtrip_roaring", members_sql(*_FORMS))
def _roaring(spark, sf):
    return blobs.decode(blobs.encode(members(spark, sf, *_FORMS), write=roaring.assemble), read=roaring.decode)


@query("blob_hostile", "SELECT * FROM (VALUES ('cut', false), ('flipped', false), ('zeros', false), ('empty', false), ('whole', true), ('tail', true)) t(name, is_valid)")
def _hostile(spark, sf):
    sound = blobs.encode(members(spark, sf, "bitmaps"), standard=True)
    changes = {"cut": "substring(payload, 1, length(payload) - 9)", "flipped": "concat(X'00', substring(payload, 2))", "zeros": "X'0000000000000000'", "empty": "X''", "whole": "payload", "tail": "concat(payload, X'0102')"}
    each = F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in changes]), F.array(*[F.expr(e) for e in changes.values()])))
    return blobs.validity(sound.select(each.alias("set_id", "payload"))).select(F.col("set_id").alias("name"), "is_valid")


for _op in ("and", "or", "diff"):
    QUERIES[f"{_op}_compact"] = lambda spark, sf, op=_op: blobs.decode(setops.combine_blobs(spark, op, blobs.encode(members(spark, sf, *_OPS)), _OPS, "result")).select("value")
    ORACLES[f"{_op}_compact"] = tree_sql((_op, *_OPS))

for _keep in (True, False):
    QUERIES["filter_by_words" if _keep else "drop_by_words"] = lambda spark, sf, keep=_keep: words.filter_values(members(spark, sf, "arrays").select("value"), words.to_words(members(spark, sf, "bitmaps")), keep)
    ORACLES["filter_by_words" if _keep else "drop_by_words"] = tree_sql(("and" if _keep else "diff", "arrays", "bitmaps"))


def _run_words(spark, sf):
    return words.runs_to_words(blocks.runs(members(spark, sf, "runs")))


QUERIES["words_from_runs"] = lambda spark, sf: words.to_values(_run_words(spark, sf))
ORACLES["words_from_runs"] = leaf_sql("runs")
QUERIES["words_set_runs"] = lambda spark, sf: words.to_values(words.set_words(words.to_words(members(spark, sf, "bitmaps")), _run_words(spark, sf)))
ORACLES["words_set_runs"] = tree_sql(("or", "bitmaps", "runs"))
QUERIES["words_clear_runs"] = lambda spark, sf: words.to_values(words.clear_words(words.to_words(members(spark, sf, "bitmaps")), _run_words(spark, sf)))
ORACLES["words_clear_runs"] = tree_sql(("diff", "bitmaps", "runs"))
QUERIES["run_minus_values"] = lambda spark, sf: intervals.without_values(blocks.runs(members(spark, sf, "runs")), members(spark, sf, "bitmaps").select("value"))
ORACLES["run_minus_values"] = ORACLES["run_difference"].replace(tree_sql(("diff", "runs", "other_runs")), tree_sql(("diff", "runs", "bitmaps")))

_BOUNDED = ("diff", ("and", "arrays", ("or", "arrays_bulk", "bitmaps")), "runs")


@query("tree_bounds", f"WITH c AS (SELECT CAST(key AS INTEGER) AS key, max(CASE WHEN set_id = 'arrays' THEN card ELSE 0 END) AS a, sum(CASE WHEN set_id <> 'arrays' THEN card ELSE 0 END) AS b FROM ({_OP_STATS}) GROUP BY key) SELECT key, CAST(least(a, b, 65536) AS BIGINT) AS most, CASE WHEN least(a, b, 65536) > 4096 THEN 'words' ELSE 'values' END AS layout FROM c WHERE a > 0 AND b > 0")
def _bounds(spark, sf):
    return tree_bounds(spark, build(spark, sf, _BOUNDED))


@query("plan_layouts", f"SELECT CAST(key AS INTEGER) AS key, CAST(least(sum(card), 65536) AS BIGINT) AS most, CASE WHEN sum(card) > 1024 THEN 'words' ELSE 'values' END AS layout FROM ({_OP_STATS}) GROUP BY key")
def _layouts(spark, sf):
    return blocks.layouts(blocks.block_stats(members(spark, sf, *_OPS)), "or", _OPS)


@query("tree_cached_leaf", tree_sql(("diff", ("or", "returned", "bulk"), "high")))
def _cached(spark, sf):
    tables: dict[str, DataFrame] = {}
    shared = cached(build(spark, sf, "high", tables))
    return evaluate(spark, Or((Diff(build(spark, sf, "returned", tables), shared), Diff(build(spark, sf, "bulk", tables), shared))))


@query("push_ordered", members_sql("high", "done"))
def _push(spark, sf):
    return columns.ascending(members(spark, sf, "high", "done").withColumn("seq", F.col("value") * 2))


@query("extend_sorted", members_sql("orders"))
def _extend(spark, sf):
    rows = members(spark, sf, "orders")
    return columns.extended(rows.where("value < 500"), rows.where("value >= 500"))


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share, or a temporary one of a local session."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.gettempdir()
    return f"{top.rstrip('/')}/sets-{uuid.uuid4().hex}"


@query("files_roundtrip", members_sql(*_FORMS))
def _files(spark, sf):
    path = _folder(spark)
    blobs.write_files(blobs.encode(members(spark, sf, *_FORMS)), path)
    return blobs.decode(blobs.read_files(spark, path))


@query("packed_roundtrip", members_sql(*_FORMS))
def _packed(spark, sf):
    path = _folder(spark)
    return blobs.decode(blobs.read_packed(path, blobs.write_packed(blobs.encode(members(spark, sf, *_FORMS)), path, files=3)))
