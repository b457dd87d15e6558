"""Operators of setloom.llm against brute force, on edge cases and on the smallest tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from setloom.llm import embedding_dedup, graph, html_text, language_id, line_dedup, lz_fingerprint, mixing, packing, pii, simhash, token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, a int"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names."""
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "and", "of", "alpha", "beta", "gamma", "delta", "été", "straße", "7", "x@y.org", "+1 (555) 123-4567"])
    texts = [" ".join(word() for _ in range(rng.randint(1, 80))) + "\n" + " ".join(word() for _ in range(9)) for _ in range(60)]
    texts += [None, "", " \n\t ", "...", texts[0], texts[0] + " more", "word " * 30_000, "<|endoftext|> inside", "a" * 3000]
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), len(t or ""), 1, "k", 2) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here at all today", "en", "s1", 3, 1, "k", 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (lz_fingerprint.lz_fingerprints, language_id.identify, mixing.mix, simhash.near_duplicates, line_dedup.repeated_lines, packing.pack, pii.personal_data, token_counts.token_counts):
        assert f(none).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_token_counts(edge, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (edge, docs):
        texts = [r.text or "" for r in df.collect()]
        want = sorted((len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for x in texts)
        assert sorted((r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df).collect()) == want


def test_packing(edge):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in packing.pack(edge).collect()]
    want = []
    for r in edge.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r.doc_id or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by) <= sum(r.length for r in rows) / 1024 * 1.05 + 2


@pytest.mark.parametrize("histogram", [{513: 3000, 340: 3000}, {600: 3000, 340: 3000}, {n: 20 + 3000 * (n == 520) for n in range(20, 900, 3)}])
def test_packing_of_skewed_lengths(histogram):
    need = np.array([histogram.get(n, 0) for n in range(1025)])
    groups = packing.configurations(histogram, 1024)
    assert (sum(c * n for c, n in groups) == need).all()
    assert all((c * np.arange(1025)).sum() <= 1024 for c, _ in groups)
    taken = sum(n for _, n in groups)
    pool, times, bound = packing.fractional(need, 1024)
    assert (times @ pool >= need[need > 0] * (1 - 1e-9)).all() and bound <= taken
    assert taken <= sum(n for _, n in packing.best_fit(need, 1024))
    assert taken <= 1.03 * bound + 1


def test_targets_and_mix(edge):
    rows = mixing.mix(edge).collect()
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(edge.repartition(5)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in rows}
    texts = edge.select("doc_id", "source", "text").collect()
    sizes: dict = {}
    for r in texts:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed, free = {}, set(names)
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: Fraction(rest * weight[s], sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
        free -= over
    want = {**fixed, **share}
    by_size = {sizes[s]: s for s in names}
    assert len(by_size) == len(names)
    taken: dict = {}
    for r in rows:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(float(want[s])) and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in names:
        assert abs(taken[s] - float(want[s])) <= 4
    out = mixing.mixed_documents(edge).collect()
    words: dict = {}
    for r in out:
        words[r.source] = words.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {s: n for s, n in taken.items() if n}


def components_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    edges = {frozenset(p) for p in pairs}
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == components_of(nodes, lambda a, b: frozenset((a, b)) in edges)


def test_covering_masks_miss_nothing():
    rng = random.Random(4)
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << b
        assert any((x ^ y) & m == 0 for m in masks)


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, edge, docs):
    for df in (edge, docs):
        rows = df.select("doc_id", "text").collect()
        prints = {(r.doc_id, r.text): brute_fingerprint(r.text) for r in rows}
        ids: dict = {}
        for (d, _), f in prints.items():
            if d is not None:
                ids[f] = min(ids.get(f, d), d)
        roots = components_of(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
        low: dict = {}
        for f, d in ids.items():
            low[roots[f]] = min(low.get(roots[f], d), d)
        want = sorted((-1 if r.doc_id is None else r.doc_id, f"{prints[r.doc_id, r.text]:016x}", low.get(roots[prints[r.doc_id, r.text]])) for r in rows)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()) == want


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", 4)
    rng = random.Random(6)
    base = rng.getrandbits(63)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for _ in range(300)})
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.node: r.root for r in graph.components(links).collect()}
    want = components_of(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {p: got.get(p, p) for p in prints} == want


def test_lz(edge):
    rows = lz_fingerprint.lz_fingerprints(edge).collect()
    order = sorted(((r.doc_id is None, r.doc_id or 0, r.text or ""), r.doc_id, r.text or "") for r in edge.select("doc_id", "text").collect())
    want = []
    for (_, d, text), (_, _, after) in zip(order, order[1:] + order[:1], strict=True):
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        own, other, following = map(lz_fingerprint.fingerprint, (text, edited, after))
        alike = (lz_fingerprint.likeness(own, other), lz_fingerprint.likeness(own, following))
        want.append((-1 if d is None else d, len(text), hashlib.sha256(edited.encode()).hexdigest(), lz_fingerprint.written(own), lz_fingerprint.written(other), *alike))
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in rows) == sorted(want)


def test_language(edge, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in language_id.identify(edge).collect()}
    assert [by[k].lang_pred for k in (60, 61, 62, 63)] == ["und"] * 4 and by[60].score == 0
    assert all(0 <= r.score <= 1 for r in by.values())


def test_pages(spark):
    cases = {
        None: "",
        "": "",
        "<p>One<p>Two &amp; <b>three</b>": "One\n\nTwo & three",
        "<nav><a href=x>menu</a></nav><article><h1>T</h1><p>Text, of some length, here.</p><p>Short</p></article><aside>Side, side, side</aside>": "T\n\nText, of some length, here.\n\nShort",
        "<body><header>Site</header><div id=c><p>Body text, long enough to count.</p><div class='comments'><p>Reader, writes, more</p></div><form>Name</form></div><script>var a='<p>no</p>'</script><footer>Foot</footer>": "Body text, long enough to count.",
        "<div><ul><li><a href=1>only</a></li><li><a href=2>links</a></li></ul></div>": "",
    }
    df = spark.createDataFrame([(k, None, p) for k, p in enumerate(cases)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == dict(enumerate(cases.values()))


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog again and again until night falls on all of them"
    rows = [(2, line + "\nshort one\n" + line.upper() + "!"), (1, "unique words stand here in this line\n" + line), (3, None), (4, ""), (5, "short one"), (5, "short one")]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.dropped) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2, 0, ""), (2, 3, 2, "0,2"), (3, 0, 0, ""), (4, 1, 0, ""), (5, 1, 0, ""), (5, 1, 0, "")]


def brute_lines(rows):
    """doc_id -> dropped positions, by comparing all lines of at least five words with each other."""
    places = [(d, k, tuple(re.findall(r"[^\W_]+", line.lower()))) for d, text in rows for k, line in enumerate(text.split("\n"))]
    places = sorted(p for p in places if len(p[2]) >= 5)

    def alike(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return row[-1] <= max(len(x), len(y)) // 5

    roots = components_of(sorted({p[2] for p in places}), alike)
    seen, gone = set(), {}
    for d, k, words in places:
        if roots[words] in seen:
            gone.setdefault(d, []).append(k)
        seen.add(roots[words])
    return gone


def dropped_lines(spark, rows):
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: [int(k) for k in r.dropped.split(",")] for r in got if r.dropped}


def test_edited_lines(spark):
    """Lines with words replaced, left out, put in and swapped: every line within the similarity is found."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    rows, k = [], 0
    for _ in range(60):
        base = [word() for _ in range(rng.randint(5, 40))]
        for _ in range(rng.randint(1, 5)):
            line = list(base)
            for _ in range(rng.randint(0, len(base) // 4)):
                at, how = rng.randrange(len(line)), rng.randrange(4)
                line[at : at + 1] = [[word()], [], [line[at], word()], line[at : at + 1]][how]
            rows.append((k := k + 1, " ".join(line)))
    want = brute_lines(rows)
    assert len(want) > 80
    assert dropped_lines(spark, rows) == want


def test_lines_of_one_crowded_key(spark, monkeypatch):
    """Numeric rows share most of their words: links between any two of them count, not only those with the least."""
    rows = [(1, "0 0 0 0 0 0 5 7\n0 0 0 0 0 0 5 9\n0 0 0 0 0 0 1 2"), (2, "3 0 0 0 0 0 0 4\n8 8 8 8 8 8 8 8\n8 8 8 8 8 8 8 1")]
    rng = random.Random(9)
    rows += [(k, " ".join(str(rng.choice([0, 0, 0, 1])) for _ in range(10)) + f" {rng.randint(0, 9)}" * 4) for k in range(3, 60)]
    want = brute_lines(rows)
    assert want[1] == [1]
    assert dropped_lines(spark, rows) == want
    monkeypatch.setattr(line_dedup, "CROWDED", 2)
    assert dropped_lines(spark, rows) == want


def test_lines_that_share_two_crowded_keys_only(spark, monkeypatch):
    """Lines alike whose common keys are all crowded count, however few these keys are."""
    rng = random.Random(5)
    kinds = [[f"k{rng.randrange(10**6)}" for _ in range(n)] for n in (6, 6, 10, 10, 13)]
    rows = []
    for k in range(240):
        line = list(kinds[k % 5])
        for at in rng.sample(range(len(line)), len(line) // 5 + rng.randint(0, 2)):
            line[at] = f"w{rng.randrange(40)}"
        rows.append((k, " ".join(line)))
    monkeypatch.setattr(line_dedup, "CROWDED", 4)
    assert dropped_lines(spark, rows) == brute_lines(rows)


def test_lines_with_crowded_keys_are_not_all_compared(spark, monkeypatch):
    """Lines that share one crowded key and common words, but no two keys, are no pairs; those alike among them are found."""
    rng = random.Random(3)
    words = [f"w{k:03}" for k in range(200)]
    lines = [["crowdedone", "crowdedtwo", *rng.sample(words, 10)] for _ in range(300)]
    for line in lines[:30]:
        lines.append(line[:])
        lines[-1][rng.randrange(12)] = "w999"
    rows = [(k, " ".join(line)) for k, line in enumerate(lines)]
    made, keep = {}, line_dedup.stored

    def counted(df, name):
        out = keep(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    want = brute_lines(rows)
    assert len(want) >= 30
    assert dropped_lines(spark, rows) == want
    assert made["pairs"] < 10 * len(rows), made


def test_no_key_that_is_needed_is_left_out(spark):
    """Lines of up to WORDS words, some put in and left out as well: two common keys, or one of lines of five words."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9)))
    texts = []
    for n in range(5, line_dedup.WORDS + 1):
        for _ in range(60):
            x = [word() for _ in range(n)]
            y = list(x)
            for _ in range(n // 5):
                at = rng.randrange(len(y))
                y[at : at + 1] = [[word()], [], [y[at], word()]][rng.randrange(3)]
            if 5 <= len(y) <= line_dedup.WORDS:
                texts.append((" ".join(x) + "\n" + " ".join(y), min(len(x), len(y))))
    keys = {}
    for r in line_dedup._lines(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")).collect():
        keys.setdefault(r.d, []).append({b >> line_dedup.SIZE_BITS for b in r.buckets})
    for k, (text, n) in enumerate(texts):
        x, y = (line.split() for line in text.split("\n"))
        if brute_lines([(1, text)]):
            assert len(keys[k][0] & keys[k][1]) >= 1 + (n > 5), (x, y)


def test_lines_without_spaces(spark):
    line = "我们今天在这里讨论数据清理的方法和结果"
    rows = [(1, line), (2, line + "。"), (3, line[:9] + "新" + line[10:]), (4, "短句\n短句"), (5, "ภาษาไทยไม่มีช่องว่าง\nภาษาไทยไม่มีช่องว่าง")]
    assert dropped_lines(spark, rows) == {2: [0], 3: [0], 5: [1]}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.15 * rng.standard_normal((20, 16)), base[:5]]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, []), (104, [None] * 16), (105, x[0].tolist()[:8])]
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    want = components_of(list(range(len(x))), lambda a, b: bool(linked[a, b]))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows)
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (linked[k].sum() - 1, want[k], want[k] == k)
    assert all((got[k].n_links, got[k].component_id) == (0, k) for k in range(100, 106))


def brute_spans(text):
    def luhn(h):
        d = [int(c) for c in h if c.isdigit()][::-1]
        return 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(x) <= 255 for x in h.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 9 <= sum(map(str.isdigit, h)) <= 15),
    ]
    return sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group()))


def test_personal_data(spark):
    rng = random.Random(3)
    parts = ["a", "b.", "@", "x-y", "com", ".", "1", "22", "333", "+", " ", "-", "(", ")", "256", "4111111111111111", "é", "😀", "\n", "%", "1.2.3.4", "+1 ", "555-1234 "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(1500)] + [None, "", "9" * 20_000, "1.2.3.4 " * 300, "call me: (212) 555-0187 now"]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        spans = brute_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        written = [f"{n}:{s}:{e}" for s, _, e, n in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",")) | {""}


def test_pipeline(spark, docs):
    taken = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        taken = stage(spark, taken, SF)
        assert taken.columns == list(corpus_pipeline.COLUMNS) and taken.count() > 0
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_edges(spark, edge):
    taken = edge
    for _, stage in corpus_pipeline.STAGES:
        taken = stage(spark, taken, SF)
    assert taken.count() > 0
