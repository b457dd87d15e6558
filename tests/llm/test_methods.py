"""The methods themselves against definitions written out here, and the edge cases of each operator."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from setloom.llm import common, embedding_dedup, html_text, language_id, line_dedup, lz_fingerprint, mixing, packing, pii, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_phrases(text):
    """The phrases of an LZ78 parse over words of at most 16 characters, the last one possibly open and left out."""
    symbols = [w[k : k + 16] for w in text.split() for k in range(0, len(w), 16)]
    known, phrase, out = {()}, (), []
    for s in symbols:
        phrase += (s,)
        if phrase not in known:
            known.add(phrase)
            out.append(phrase)
            phrase = ()
    return set(out) | ({phrase} if phrase else set())


def plain_signature(phrases):
    least = {}
    for phrase in phrases:
        h = 0
        for s in phrase:
            h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(s) + 1) % 2**64
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD % 2**64
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 % 2**64
        h ^= h >> 33
        least[h >> 57] = min(least.get(h >> 57, 2**64), h)
    return "".join(f"{least[b] & 0xFFFF:04x}" if b in least else "----" for b in range(128))


def test_phrases_and_their_signatures():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(30)] + ["x" * 40]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 2000))) for _ in range(40)] + ["", "  ", "a", "a a a a a a"]
    for text in texts:
        assert lz_fingerprint.written(lz_fingerprint.fingerprint(text)) == plain_signature(plain_phrases(text))
    for a, b in itertools.pairwise(texts[:40]):
        x, y = plain_phrases(a + " " + b), plain_phrases(a)
        true = len(x & y) / max(1, len(x | y))
        got = lz_fingerprint.likeness(lz_fingerprint.fingerprint(a + " " + b), lz_fingerprint.fingerprint(a))
        assert abs(got - true) < 0.25


def test_kernel_regression_written_out():
    """Scores against n-gram sets, the kernel matrix and the Nystroem regression computed outright."""
    rng = random.Random(2)
    stems = {"en": ["the", "and", "with", "house", "water"], "de": ["der", "und", "mit", "haus", "wasser"], "fr": ["le", "et", "avec", "maison", "eau"]}
    rows = [(" ".join(rng.choice(stems[k]) for _ in range(rng.randint(3, 12))), k) for k in stems for _ in range(20)]
    asked = [" ".join(rng.choice(stems[k]) for _ in range(6)) for k in stems for _ in range(5)]

    def grams(text):
        t = re.sub(r"[^a-z]+", " ", text.lower())
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    sets = [grams(t) for t, _ in rows]
    marks = [k for j in stems for k in [i for i, r in enumerate(rows) if r[1] == j][:6]]
    marks.sort()
    pool = set().union(*[sets[k] for k in marks])
    kernel = lambda a, b: len(a & b & pool) / math.sqrt(len(a) * len(b))
    small = np.array([[kernel(sets[a], sets[b]) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(small)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = np.array([[kernel(s, sets[b]) for b in marks] for s in sets]) @ whiten
    names = sorted(stems)
    y = np.array([[float(r[1] == n) for n in names] for r in rows])
    w = np.linalg.solve(phi.T @ phi + language_id.RIDGE * len(rows) * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ y)
    want = np.array([[kernel(grams(t), sets[b]) for b in marks] for t in asked]) @ whiten @ w
    got = language_id.fit(rows, landmarks=6).predict(asked)
    assert [g for g, _ in got] == [names[k] for k in want.argmax(1)]
    assert np.allclose([s for _, s in got], np.clip(want.max(1), 0, 1), atol=0.02)


def test_grams_of_pieces(monkeypatch):
    """Texts cut into pieces give the n-grams of the whole text, across any white space."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \n.é") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a" + " " * 50 + "b", " " * 30, ""]
    whole = [set(language_id.gram_codes(t).tolist()) for t in texts]
    monkeypatch.setattr(language_id, "MOST_LETTERS", 7)
    assert [set(language_id.gram_codes(t).tolist()) for t in texts] == whole


def test_many_languages(spark):
    rows = [(k, "wort eins zwei drei", f"l{k % 600}", "s", 1) for k in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    assert len(language_id.learn(docs).languages) <= language_id.MOST_LANGUAGES


def test_traversal_is_nearest_first():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_dedup.MultiIndex((embedding_dedup._codebook(x[:, :6], 7, rng), embedding_dedup._codebook(x[:, 6:], 5, rng)), 0.05)
    own, n, cells = index.visits(x)
    home, first, second = index.bounds(x)
    assert (own == home).all()
    for r, part in enumerate(np.split(cells, np.cumsum(n)[:-1])):
        sums = {int(i * second.shape[1] + j): first[r, i] + second[r, j] for i in range(first.shape[1]) for j in range(second.shape[1])}
        assert sorted(part.tolist()) == sorted(c for c, s in sums.items() if s <= index.stop) and part[0] == home[r]
        order = [sums[int(c)] for c in part]
        assert order == sorted(order)


def test_many_cells(spark, monkeypatch):
    """Thousands of vectors in a grid of many cells, with planted partners, repeated ids and null ids, against brute force."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 25)
    monkeypatch.setattr(embedding_dedup, "MEMBERS", 20)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((2500, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.standard_normal((700, 32))
    noise -= (noise * base[:700]).sum(1, keepdims=True) * base[:700]
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    cosine = rng.uniform(0.88, 0.95, 700)[:, None]
    x = np.concatenate([base, cosine * base[:700] + np.sqrt(1 - cosine**2) * noise]).astype(np.float32)
    ids = np.arange(len(x)) * 3
    rows = [(int(i), v.tolist(), 1, "k") for i, v in zip(ids, x, strict=True)] + [(0, x[0].tolist(), 1, "k"), (None, x[1].tolist(), 1, "k"), (9999, x[5].tolist()[:20], 1, "k")]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, vector string"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = got.collect()
    assert len(got) == len(rows) and sum(r.vec_id is None for r in got) == 1
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    want = dict(zip(ids.tolist(), linked.sum(1).tolist(), strict=True))
    n = {r.vec_id: r.n_links for r in got}
    for k in [0, *np.flatnonzero(linked[0]).tolist()]:
        want[int(ids[k])] += 1  # the row that repeats vector 0
    found = sum(n[k] for k in want)
    assert all(n[k] <= w for k, w in want.items())
    assert found >= 0.99 * sum(want.values()) and sum(want.values()) > 800
    assert {r.n_links for r in got if r.vec_id in (None, 9999)} == {0}


def test_pages_long_repeated_and_wide(spark):
    blocks = "".join(f"<p>Paragraph {k}, with a few words, and a comma.</p>" for k in range(3000))
    nested = "<div>" * 3000 + "<p>Deep text, long enough, to be found here.</p>" + "</div>" * 3000
    wide = "<body><div class='layout has-sidebar'><div><p>Main text, of the page, as it should be.</p><p>More of it, here, and on.</p></div><div class='sidebar'><p>Aside, aside, aside, aside.</p></div></div></body>"
    pages = [blocks, blocks, nested, wide, "<svg>" * 2000 + "<p>After it, some text, here it is.</p>"]
    rows = [(1 if k < 2 else k, f"u{k}", p, "x", 5) for k, p in enumerate(pages)] + [(None, None, None, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    by = {r.url: r for r in got}
    assert len(got) == len(rows) and by["u0"].text == by["u1"].text and by["u0"].text.count("\n\n") == 2999
    assert by["u2"].text == "Deep text, long enough, to be found here."
    assert by["u3"].text == "Main text, of the page, as it should be.\n\nMore of it, here, and on."
    assert by[None].text == "" and by[None].page_id is None and all(r.n_chars == len(r.text) for r in got)


def test_lines_with_nulls_ties_and_long_lines(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    long = [word() for _ in range(3000)]
    edited = [word() if k % 7 == 0 else w for k, w in enumerate(long)]
    other = [word() if k % 3 == 0 else w for k, w in enumerate(long)]
    swapped = [[word() for _ in range(20)] for _ in range(10)]
    pairs = []
    for line in swapped:  # ten orders of other words, each with two neighbours swapped
        turned = line[:]
        turned[9], turned[10] = turned[10], turned[9]
        pairs += [" ".join(line), " ".join(turned)]
    one = "the same line of some words"
    rows = [(None, one), (5, one), (5, one), (5, one + "\n" + one), (7, " ".join(long)), (8, " ".join(edited)), (9, " ".join(other)), (10, "\n".join(pairs)), (11, ""), (12, None)]
    docs = spark.createDataFrame([(d, t, "x", 1, "k") for d, t in rows], "doc_id long, text string, key string, n int, pos string")
    got = [(r.doc_id, r.n_lines, r.dropped) for r in line_dedup.repeated_lines(docs).collect()]
    want = [(None, 1, ""), (5, 1, "0"), (5, 1, "0"), (5, 2, "0,1"), (7, 1, ""), (8, 1, "0"), (9, 1, ""), (10, 20, ",".join(str(k) for k in range(1, 20, 2))), (11, 1, ""), (12, 0, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_recall_of_line_keys(spark):
    """Sketches of lines exactly at the similarity: how many pairs share two keys, by length and kind of edit."""
    rng = random.Random(7)
    fresh = itertools.count(10**6)
    rows, texts = [], []
    for n in (5, 6, 9, 10, 12, 15, 18, 20, 30, 60, 200):
        for spread in (True, False):
            for _ in range(120):
                x = [f"w{rng.randrange(10**6)}" if rng.random() < 0.95 or n > 18 else "so" for _ in range(n)]
                y = list(x)
                where = range(2, n, 5) if spread else rng.sample(range(n), n // 5)
                for at in list(where)[: n // 5]:
                    y[at] = f"w{next(fresh)}"
                rows.append((n, spread))
                texts.append(" ".join(x) + "\n" + " ".join(y))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {}
    for r in line_dedup._lines(docs).collect():
        keys.setdefault(r.d, []).append({b >> line_dedup.SIZE_BITS for b in r.buckets})
    hits = {}
    for k, kind in enumerate(rows):
        hits.setdefault(kind, []).append(len(keys[k][0] & keys[k][1]) >= 1 + (kind[0] > 5) if len(keys[k]) == 2 else True)
    for (n, spread), found in hits.items():
        assert all(found) if n <= line_dedup.WORDS else sum(found) >= 0.97 * len(found), (n, spread, sum(found))


def test_shared_keys_of_lines_that_cannot_be_alike(spark):
    """They go before any pair is made; of lines that are alike, by edits of any kind, no sketch tells that they are not."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = " ".join(c * 9 for c in "xyz")
    by_chance = spark.createDataFrame([(k, f"{common} {' '.join(word() for _ in range(9))}") for k in range(line_dedup.CROWDED - 10)], "doc_id long, text string")
    lines = line_dedup._lines(by_chance)
    firsts = lines.select("key", F.struct("d", "pos", "h").alias("first"), F.lit(1).cast("long").alias("n"))
    assert lines.select(F.explode("buckets").alias("b")).groupBy(F.shiftright("b", line_dedup.SIZE_BITS)).count().where("count > 30").count() >= 2
    assert line_dedup._shared(lines, firsts).count() == 0
    texts = []
    for n in [*range(5, 24), 40, 55, 60, 63, 64, 65, 66, 70, 78, 130] * 12:
        x = [word() for _ in range(n)]
        y = list(x)
        for _ in range(n // 5):
            at, kind = rng.randrange(len(y)), rng.randrange(3)
            y[at : at + (kind < 2)] = [word()] if kind else []
        texts.append("\n".join(rng.sample([" ".join(x), " ".join(y)], 2)))
    sides = line_dedup._lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("d", "pos", "size", "sketch")
    pairs = sides.where("pos = 0").join(sides.where("pos = 1").select("d", F.col("size").alias("b_size"), F.col("sketch").alias("b_sketch")), "d")
    alike = "5 * abs(size - b_size) <= greatest(size, b_size)"  # else the edits are too many for the larger size
    assert pairs.where(alike).count() > 250
    assert pairs.where(f"{alike} and not {line_dedup._may_be_alike('size', 'b_size', 'sketch', 'b_sketch')}").count() == 0


def test_token_ids_of_long_white_space(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 2_000_000, "\n" * 1_200_000 + "x", "word " + " " * 1_000_001 + "word"]
    rows = packing.pack(spark.createDataFrame([(k, x, "s", 1) for k, x in enumerate(texts)], "doc_id long, text string, length string, bucket int")).collect()
    for k, x in enumerate(texts):
        assert sum(r.length for r in rows if r.doc_id == k) == len(t.encode(x, add_special_tokens=False).ids) + 1


def test_ids_of_documents(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for r in packing.pack(docs).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        for piece, start, length, crc in got[r.doc_id]:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) and piece >= 0
        assert sum(x[2] for x in got[r.doc_id]) == len(ids)


def test_expectation_maximisation():
    """Shares, reliabilities and posteriors after each number of rounds against the same computed over single spans."""
    rng = random.Random(8)
    spans = [(rng.randrange(4), *[rng.choice([-1, 0, 1]) for _ in range(4)]) for _ in range(60)] * 3
    patterns = [(*s, spans.count(s)) for s in sorted(set(spans))]
    right, share = [0.9, 0.7, 0.7, 0.7], [0.5] * 4
    post = []
    for _ in range(25):
        post = []
        for k, *votes in spans:
            odds = share[k] / (1 - share[k])
            for v, r in zip(votes, right, strict=True):
                odds *= (r / (1 - r)) ** v
            post.append(odds / (1 + odds))
        for k in range(4):
            own = [p for s, p in zip(spans, post, strict=True) if s[0] == k]
            share[k] = min(0.99, max(0.01, (1 + sum(own)) / (2 + len(own))))
        for j in range(4):
            hits = [p if s[1 + j] > 0 else 1 - p for s, p in zip(spans, post, strict=True) if s[1 + j]]
            right[j] = min(0.99, max(0.51, (7 + sum(hits)) / (10 + len(hits))))
    got, posterior = pii.reliabilities(patterns, rounds=25)
    assert [got[n] for n in pii.LABELERS] == pytest.approx(right)
    assert [posterior[s] for s in spans] == pytest.approx(post)


def test_classifier_learns_shape():
    """With votes that tell nothing apart, the classifier follows the shape that the posteriors follow."""
    blank = (0,) * len(pii.SHAPE)
    spans = [(0, 0, 0, 0, 0, *(1, *blank[1:]), 50), (0, 1, 1, 1, 1, *(1, *blank[1:]), 50), (0, -1, -1, -1, -1, *(2, *blank[1:]), 50), (0, 0, 0, 0, 0, *(2, *blank[1:]), 50)]
    posterior = {(0, 0, 0, 0, 0): 0.5, (0, 1, 1, 1, 1): 0.99, (0, -1, -1, -1, -1): 0.01}
    w = pii.train(spans, posterior)
    odds = lambda p: sum(a * b for a, b in zip(w, pii.features(p[0], p[1:5], p[5:-1]), strict=True))
    assert odds(spans[1]) > 1 and odds(spans[2]) < -1 and odds(spans[0]) > odds(spans[3])


def test_free_spans(spark):
    rng = random.Random(9)
    rows, want = [], []
    for row in range(60):
        spans = [(rng.randrange(80), rng.randrange(4), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 14))]
        base = [(s, k, s + n) for s, k, n in spans[::3]]
        more = sorted({(s, k, s + n) for s, k, n in spans} - set(base))
        rows += [(row, *x, True) for x in base] + [(row, *x, False) for x in more]
        end = -1
        for s, k, e in sorted(more, key=lambda x: (x[0], x[2], x[1])):
            if s >= end and not any(b[0] < e and s < b[2] for b in base):
                want.append((row, s, k, e))
                end = e
    got = pii.free_spans(spark.createDataFrame(rows, "row long, start long, k int, end long, base boolean"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_added_spans(spark):
    """Loose spans of all kinds are found where the words around them speak for them; texts may repeat and be long."""
    hits = ["call me on phone 212 555 0187 now", "mail: jane dot doe at example dot org", "write to jane at example dot org today", "my ip address is 8[.]8[.]4[.]4 ok", "credit card 4111/1111/1111/1111 here"]
    clean = ["it is 5 at home dot", "version 1[.]2[.]3[.]4 of it", "order 4111-1111", "nothing here"]
    texts = (hits + clean) * 4 + ["a@b.org " * 6000, "call 212 555 0187 " * 3000, None, ""]
    docs = spark.createDataFrame([(k if k else None, t, "x", 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, row string, start int, k int")
    rows = sorted(pii.personal_data(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert len(rows) == len(texts) and rows[0].doc_id is None
    found = lambda k: [x.split(":") for x in rows[k].spans.split(",") if x]
    for k, kind in ((0, "phone"), (2, "email"), (3, "ip"), (4, "card")):
        got = [(texts[k][int(s) : int(e)], n) for n, s, e in found(k)]
        assert [n for _, n in got] == [kind], (texts[k], got)
    assert found(8) == [] and rows[36].n_email == 6000 and len(found(37)) == 3000


@pytest.fixture
def raw(spark):
    rng = random.Random(10)
    word = lambda: rng.choice(["the", "and", "house", "water", "river", "with", "alpha", "beta", "gamma", "delta"]) + rng.choice("abcdefghij")
    texts = ["\n".join(" ".join(word() for _ in range(rng.randint(6, 30))) for _ in range(rng.randint(1, 4))) for _ in range(50)]
    rows = [(k, t, "en", rng.choice(["a", "b", None]), len(t)) for k, t in enumerate(texts)]
    rows += [(3, "another text of id three with other words in it", "en", "a", 9), (3, texts[3], "en", "b", 9), (None, texts[4], "en", "a", 1), (None, "text without any id but all alone here", None, None, 1), (60, None, "en", "a", 0), (61, "", "en", "a", 0), (62, " \n ", "fr", "a", 3)]
    return rows, spark.createDataFrame(rows, DOCS)


def plain(rows):
    return sorted(map(tuple, rows), key=str)


def test_stages_against_brute_force(spark, raw):
    rows, docs = raw
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language ID"](spark, docs, SF)
    model = language_id.learn(docs)
    said = model.predict([t or "" for _, t, *_ in rows])
    want = [r for r, (name, score) in zip(rows, said, strict=True) if name != "und" and score >= language_id.LEAST_SCORE]
    assert plain(kept.collect()) == plain(want) and {r[1] for r in rows} - {r[1] for r in want} >= {None, "", " \n "}

    lines = stages["line dedup"](spark, spark.createDataFrame(want, DOCS), SF).collect()
    seen, after = set(), []
    order = sorted(want, key=lambda r: (r[0] is not None, r[0] or 0))
    keep = {}
    for d, t, *_ in order:  # no two lines here are alike but not equal
        for at, line in enumerate(t.split("\n")):
            words = tuple(re.findall(r"[^\W_]+", line.lower()))
            if len(words) >= 5:
                keep.setdefault(words, (d, at, t))
    for d, t, lang, source, n in want:
        split = t.split("\n")
        left = [x for at, x in enumerate(split) if len(w := tuple(re.findall(r"[^\W_]+", x.lower()))) < 5 or keep[w][:2] == (d, at) and keep[w][2] == t]
        new = "\n".join(left)
        if len(left) == len(split):
            after.append((d, t, lang, source, n))
        elif new.strip():
            after.append((d, new, lang, source, len(new)))
    assert plain(lines) == plain(after) and not seen

    near = stages["SimHash near-dedup"](spark, docs, SF).collect()
    prints = [simhash.fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
            old, new = root[j], root[i]
            root = [new if x == old else x for x in root]
    firsts = {}
    for k, (d, *_) in enumerate(rows):
        firsts.setdefault(root[k], []).append(((d is None, d or 0), k))
    assert len(near) == len(firsts)
    by = {}
    for r in near:
        k = next(i for i, x in enumerate(rows) if x[1] == r.text)
        by[root[k]] = r.doc_id
    assert by == {g: None if min(m)[0][0] else min(m)[0][1] for g, m in firsts.items()}

    mixed = stages["mixing"](spark, docs, SF).collect()
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    got = {}
    for r in mixed:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in taken.items() if v}

    packed = stages["packing"](spark, docs, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, *_ in rows)


def test_a_line_feed_is_nothing_left(spark):
    line = "one line that is there twice in all"
    docs = spark.createDataFrame([(1, line, "en", "a", 1), (2, line + "\n\n \t", "en", "a", 1), (3, "\n", "en", "a", 1)], DOCS)
    assert sorted(r.doc_id for r in line_dedup.deduplicated_documents(docs).collect()) == [1, 3]


def test_empty_stages(spark):
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class Context:
                        isLocal = staticmethod(lambda: False)

                        @staticmethod
                        def getCheckpointDir():
                            class Nothing:
                                isDefined = staticmethod(lambda: False)

                            return Nothing

                    return Context

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
