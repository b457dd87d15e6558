"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from the base patterns and from looser ones. Labelers vote on each: the pattern
with its checks, gazetteers (top-level domains, issuers, calling codes, reserved networks), the words
before it and the characters around it. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, and a logistic span classifier is trained on the posteriors; it
sees the votes and what no labeler looks at: a span's length, share of digits, separators and the
characters beside it. Base spans always stay; the classifier adds loose candidates that it finds likelier than not.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: Leftmost matches of the contract's patterns. A match can only start at a run's start or where the
#: last match ended, and possessive repeats cannot fail later, so each is found in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}+ ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}+",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-])",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]| dot )[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_]|[\x20-]{2,3})[0-9]{4}(?:[./_]|[\x20-]{2,3})[0-9]{4}(?:[./_]|[\x20-]{2,3})[0-9]{4}(?![0-9])",
}
GATE = {"email": "contains(text, '@')", "ip": "text rlike '[0-9][.][0-9]'", "card": "text rlike '[0-9]'", "phone": "contains(text, '+')"}
LOOSE_GATE = {"email": "text rlike ' at |[(]at[)]|[\\\\[]at[\\\\]]'", "phone": "text rlike '[0-9]{3}[ .-][0-9]{4}'", "ip": "text rlike '[0-9][.][\\\\])]|[0-9](?:[\\\\[]dot|[(\\\\[][.]| dot )|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]'", "card": "text rlike '[0-9]{4}(?:[./_]|[ -]{2,3})[0-9]{4}'"}
TLDS = "com org net edu gov mil int info biz io dev app ai co uk de fr es it nl be ch at pl se no dk fi pt gr ie cz hu ro ru ua tr cn jp kr in au nz ca us mx br ar cl za eu me tv".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
WORDS = {"email": "mail|contact|write|address", "ip": "ip|host|server|addr|login|client", "card": "card|visa|credit|payment|debit|amex", "phone": "phone|tel|call|fax|mobile|cell|contact"}
AGAINST = "version|isbn|issn|order|invoice|sku|ref|page|doi|release|build"
LABELERS = ("pattern", "gazetteer", "context", "surroundings")
#: What the classifier sees of a span besides the votes, each with a few values from 0.
SHAPE = {
    "f0": ("length", 4, "case when length(x.hit) < 10 then 0 when length(x.hit) < 16 then 1 when length(x.hit) < 24 then 2 else 3 end"),
    "f1": ("digits", 3, "case when 10 * length(regexp_replace(x.hit, '[^0-9]', '')) >= 9 * length(x.hit) then 2 when 2 * length(regexp_replace(x.hit, '[^0-9]', '')) >= length(x.hit) then 1 else 0 end"),
    "f2": ("separators", 3, "case when x.hit rlike '[0-9A-Za-z][ ][0-9A-Za-z]' then 2 when x.hit rlike '[-./_]' then 1 else 0 end"),
    "f3": ("before", 3, "case when x.before = '' or x.before rlike '\\\\s$' then 0 when x.before rlike '[\\\\p{L}0-9]$' then 2 else 1 end"),
    "f4": ("after", 3, "case when x.after = '' or x.after rlike '^\\\\s' then 0 when x.after rlike '^[\\\\p{L}0-9]' then 2 else 1 end"),
}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
_ISSUERS = "^(?:4[0-9]{12}(?:[0-9]{3})?(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14})$"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and has body use it by name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _matches(pattern: str, gate: str) -> str:
    """SQL array of (start, end, hit, before, after) of the pattern's leftmost matches in text, code points.

    The texts between the matches give the places: lengths are summed within chunks of 64 matches and
    over chunks, so many matches take little more than linear time.
    """
    item = "struct(cast({end} - length(z.h[i]) as bigint) as start, cast({end} as bigint) as end, z.h[i] as hit, right(z.g[i], 40) as before, left(z.g[i + 1], 1) as after)"
    end = "(y.c[i div 64] + aggregate(slice(y.n, (i div 64) * 64 + 1, i % 64 + 1), 0L, (s, x) -> s + x))"
    sums = "transform(sequence(0, (size(n) - 1) div 64), k -> aggregate(slice(n, k * 64 + 1, 64), 0L, (s, x) -> s + x))"
    before = _let(sums, "t", "transform(sequence(0, size(t) - 1), k -> aggregate(slice(t, 1, k), 0L, (s, x) -> s + x))")
    lengths = "transform(z.h, (x, i) -> cast(length(z.g[i]) + length(x) as bigint))"
    body = _let(lengths, "n", _let(f"struct(n as n, {before} as c)", "y", f"transform(sequence(0, size(z.h) - 1), i -> {item.format(end=end)})"))
    none = "cast(array() as array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>)"
    found = _let(f"struct(split(text, {_sql(pattern)}, -1) as g, regexp_extract_all(text, {_sql(pattern)}, 0) as h)", "z", f"if(size(z.h) = 0, {none}, {body})")
    return f"if({gate}, {found}, {none})"


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: do the digits (12 to 19 of them) pass the Luhn check."""
    each = f"transform(sequence(1, length({digits})), i -> {_let(f'cast(substring({digits}, i, 1) as int) * (1 + (length({digits}) - i) % 2)', 'v', 'v div 10 + v % 10')})"
    return f"aggregate({each}, 0L, (s, x) -> s + x) % 10 = 0"


def _valid(kind: str, hit: str) -> str:
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"{hit} rlike {_sql(_OCTETS)}"
    if kind == "card":
        return _let(_digits(hit), "w", f"case when length(w) between 12 and 19 then {_luhn('w')} else false end")
    return f"length({_digits(hit)}) between 9 and 15"


def _gazetteer(kind: str) -> str:
    """SQL vote of the kind's word and number lists on x.hit."""
    if kind == "email":
        listed = ", ".join(_sql(t) for t in TLDS)
        return f"if(lower(regexp_extract(x.hit, '([A-Za-z0-9-]+)$', 1)) in ({listed}), 1, -1)"
    if kind == "ip":
        return "case when x.hit like '%:%' then if(x.hit rlike '^(?:fe80|fc|fd|0:)', -1, 1) when x.hit rlike '(?:^|[^0-9])(?:2(?:5[6-9]|[6-9][0-9])|[3-9][0-9]{2})(?:[^0-9]|$)' then -1 when x.hit rlike '^(?:0|10|127|22[4-9]|2[345][0-9])[^0-9]|^192[^0-9]+168[^0-9]|^172[^0-9]+(?:1[6-9]|2[0-9]|3[01])[^0-9]' then -1 else 1 end"
    if kind == "card":
        return f"if({_digits('x.hit')} rlike {_sql(_ISSUERS)}, 1, -1)"
    codes = "|".join(sorted(CALLING, key=len, reverse=True))
    return f"case when x.hit rlike '^[+](?:{codes})' then 1 when x.hit like '+%' then -1 when x.hit rlike '^[(]?[2-9]' then 1 else -1 end"


def _voted(kind: str, source: str, base: str, k: int) -> str:
    """SQL array of candidates (start, k, end, base, votes, shape) of matches."""
    context = f"case when lower(x.before) rlike '(?:{AGAINST})[^a-z]*$' then -1 when lower(x.before) rlike '{WORDS[kind]}' then 1 else 0 end"
    around = "if(x.before rlike '[A-Za-z0-9_#/=\"]$' or x.after rlike '^[A-Za-z0-9_#/=\"]', -1, 1)"
    pattern = f"if({base}, 1, -1)" if base != "false" else "0"
    return f"transform({source}, x -> struct(x.start as start, {k} as k, x.end as end, {base} as base, {pattern} as v0, {_gazetteer(kind)} as v1, {context} as v2, {around} as v3, {', '.join(f'{sql} as {f}' for f, (_, _, sql) in SHAPE.items())}))"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its base spans (start, k, end) and candidates with votes; text is read once."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(_voted(kind, _matches(BASE[kind], GATE[kind]), _valid(kind, "x.hit"), k))
        if kind in LOOSE:
            parts.append(_voted(kind, _matches(LOOSE[kind], LOOSE_GATE[kind]), "false", k))
    # a card match of few digits is no candidate at all
    every = f"filter(concat({', '.join(parts)}), c -> c.base or c.k <> 2 or c.end - c.start >= 13)"
    return text.select("doc_id", F.expr(every).alias("found"))


def reliabilities(patterns: list[tuple], rounds: int = 60) -> tuple[dict[str, float], dict[tuple, float]]:
    """EM over (k, v0..v3, n) rows: how often each labeler is right where it votes, and the posterior of each pattern.

    Labelers are independent given the truth and vote wrongly alike on either class; abstaining tells
    nothing. Each kind has its own share of true spans. The rows are at most 4 * 3^4, whatever the data.
    """
    right = {name: 0.9 if name == "pattern" else 0.7 for name in LABELERS}
    share = {k: 0.5 for k in range(len(KINDS))}
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for *key, _n in patterns:
            odds = math.log(share[key[0]] / (1 - share[key[0]]))
            for name, vote in zip(LABELERS, key[1:], strict=True):
                odds += vote * math.log(right[name] / (1 - right[name]))
            posterior[tuple(key)] = 1 / (1 + math.exp(-odds))
        for k in share:
            n = sum(p[-1] for p in patterns if p[0] == k)
            share[k] = min(0.99, max(0.01, (1 + sum(p[-1] * posterior[tuple(p[:-1])] for p in patterns if p[0] == k)) / (2 + n)))
        for at, name in enumerate(LABELERS):
            n = sum(p[-1] for p in patterns if p[1 + at])
            hits = sum(p[-1] * (posterior[tuple(p[:-1])] if p[1 + at] > 0 else 1 - posterior[tuple(p[:-1])]) for p in patterns if p[1 + at])
            right[name] = min(0.99, max(0.51, (7 + hits) / (10 + n)))
    return right, posterior


def features(k: int, votes: tuple, shape: tuple) -> list[float]:
    """The classifier's row of a span: bias, votes, kinds after the first, values after the first of each shape feature."""
    out = [1.0, *map(float, votes), *[float(k == j) for j in range(1, len(KINDS))]]
    for value, (_, values, _) in zip(shape, SHAPE.values(), strict=True):
        out += [float(value == j) for j in range(1, values)]
    return out


def train(spans: list[tuple], posterior: dict[tuple, float], rounds: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic regression of the posteriors on features(), over (k, v0..v3, f0.., n) rows, by gradient descent."""
    rows = [(features(p[0], p[1:5], p[5:-1]), posterior[tuple(p[:5])], math.log1p(p[-1])) for p in spans]
    width = len(features(0, (0,) * 4, (0,) * len(SHAPE)))
    weights = [0.0, 1.0, 0.5, 0.5, 0.5, *[0.0] * (width - 5)]
    total = sum(n for _, _, n in rows) or 1.0
    cells = [([j for j, v in enumerate(x) if v], x, y, n) for x, y, n in rows]
    for _ in range(rounds):
        slope = [0.0] * width
        for at, x, y, n in cells:
            error = n * (1 / (1 + math.exp(-sum(weights[j] * x[j] for j in at))) - y) / total
            for j in at:
                slope[j] += error * x[j]
        weights = [w - rate * (g + 0.001 * w) for w, g in zip(weights, slope, strict=True)]
    return weights


def odds_sql(w: list[float]) -> str:
    """SQL of the classifier's log odds for a candidate c."""
    parts = [repr(w[0]), *[f"{w[1 + j]!r} * c.v{j}" for j in range(len(LABELERS))]]
    at = 1 + len(LABELERS)
    parts.append("case c.k " + " ".join(f"when {k} then {w[at + k - 1]!r}" for k in range(1, len(KINDS))) + " else 0.0 end")
    at += len(KINDS) - 1
    for f, (_, values, _) in SHAPE.items():
        parts.append(f"case c.{f} " + " ".join(f"when {j} then {w[at + j - 1]!r}" for j in range(1, values)) + " else 0.0 end")
        at += values - 1
    return " + ".join(parts)


def free_spans(spans: DataFrame) -> DataFrame:
    """row, start, k, end of added spans that overlap no base span and no added one before them that stays.

    spans has row, start, k, end, base. Base spans that reach over a start, and those that begin before an
    end, are found by running extremes in order of places; what is left is taken greedily
    within groups of added spans that overlap in a chain, so a row takes n log n time.
    """
    by_row = Window.partitionBy("row").orderBy("start", "end", "k")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(by_row.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    alone = spans.withColumn("reach", reach).withColumn("next", following).where("not base and coalesce(reach <= start, true) and coalesce(next >= end, true)")
    earlier = F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    chained = alone.withColumn("new", F.when(F.col("start") < earlier, 0).otherwise(1)).withColumn("chain", F.sum("new").over(by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chains = chained.groupBy("row", "chain").agg(F.array_sort(F.collect_list(F.struct("start", "end", "k"))).alias("c"))
    taken = F.expr("aggregate(c, cast(array() as array<struct<start:bigint,end:bigint,k:int>>), (s, x) -> if(size(s) = 0 or element_at(s, -1).end <= x.start, array_append(s, x), s))")
    return chains.select("row", F.explode(F.when(F.size("c") == 1, F.col("c")).otherwise(taken)).alias("c")).select("row", "c.start", "c.k", "c.end")


def personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text.

    Counts and the digest are of the base spans; spans also has the added ones, none of which overlaps
    a base span or an earlier added one. Places are code points, ends exclusive. A null text is empty
    and has no spans; a null doc_id stays; repeated rows come out each; an empty table gives no row;
    other columns are not read. One pass over the texts and no shuffle of them; the driver gets the
    counts of vote patterns and shapes, at most 324 * 324 rows whatever the input.
    """
    found = stored(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "spans")
    shape = [f"c.{f}" for f in SHAPE]
    seen = found.select(F.explode("found").alias("c")).groupBy("c.k", "c.v0", "c.v1", "c.v2", "c.v3", *shape).agg(F.count("*").alias("n"))
    spans = sorted(tuple(r) for r in seen.collect())
    patterns: Counter[tuple] = Counter()
    for *key, n in spans:
        patterns[tuple(key[:5])] += n
    _, posterior = reliabilities([(*key, n) for key, n in sorted(patterns.items())])
    odds = odds_sql(train(spans, posterior))
    likely = math.log(least / (1 - least))
    names = " ".join(f"when {k} then '{kind}'" for k, kind in enumerate(KINDS))
    written = lambda spans: f"array_join(transform({spans}, c -> concat(case c.k {names} end, ':', c.start, ':', c.end)), ',')"
    place = "c -> struct(c.start, c.k, c.end)"
    both = found.select("row", "doc_id", F.expr(f"array_sort(transform(filter(found, c -> c.base), {place}))").alias("base"), F.expr(f"transform(filter(found, c -> not c.base and {odds} >= {likely!r}), {place})").alias("more"))
    split = stored(both, "split")
    wider = split.where("size(more) > 0")
    tagged = lambda column, is_base: wider.select("row", F.explode(column).alias("c")).select("row", "c.start", "c.k", "c.end", F.lit(is_base).alias("base"))
    added = free_spans(tagged("base", True).union(tagged("more", False))).groupBy("row").agg(F.collect_list(F.struct("start", "k", "end")).alias("added"))
    with_added = wider.join(added, "row", "left").select("doc_id", "base", F.expr("if(added is null, base, array_sort(concat(base, added)))").alias("all"))
    every = split.where("size(more) = 0").select("doc_id", "base", F.col("base").alias("all")).union(with_added)
    counts = [F.expr(f"cast(size(filter(base, c -> c.k = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return every.select("doc_id", *counts, F.sha2(F.expr(written("base")).cast("binary"), 256).alias("base_sha256"), F.expr(written("all")).alias("spans"))
