"""Language identification with string kernels.

Two texts are compared by the n-grams (one to three letters, blended) that are present in both,
normalised by how many each has. A bounded sample of labelled rows gives Nystroem landmarks and a
one-versus-rest kernel ridge regression on them. The kernel is linear in the presence vector, so the
landmarks, the whitening and the regression fold into one matrix from n-grams to languages and a
batch of documents is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows learned from, at most, and landmarks among them, by language.
SAMPLE_ROWS, LANDMARKS = 400, 48
#: Languages learned, those of most labelled rows, and rows learned from in all, at most.
MOST_LANGUAGES, MOST_ROWS = 500, 20_000
RIDGE = 1e-3
#: N-grams are told apart by a hash of this many bits.
HASH_BITS = 18
MOST_LETTERS = 1_000_000
#: Documents below this score are rejected by the filter.
LEAST_SCORE = 0.1

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case letter of each code point; a space for all that is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def gram_codes(text: str) -> np.ndarray:
    """Hashes of all n-grams of the text's letters, with repeats; empty if it has no letter."""
    found, table, some = [], letters(), False
    shift = np.uint32(32 - HASH_BITS)
    codes = np.empty(0, dtype=np.uint32)
    for at in range(0, len(text), MOST_LETTERS):  # the last two letters before a piece go with it, one space between words counted once
        piece = table[np.frombuffer(text[at : at + MOST_LETTERS].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        codes = np.concatenate([codes[-2:], piece])
        spaced = codes == 32
        some = some or not spaced.all()
        codes = codes[~(spaced & np.r_[False, spaced[:-1]])]
        one = codes * _FACTORS[0]
        found.append(one >> shift)
        if len(codes) > 1:
            two = one[:-1] ^ (codes[1:] * _FACTORS[1] + np.uint32(1))
            found.append((two * _FACTORS[2]) >> shift)
        if len(codes) > 2:
            three = two[:-1] * _FACTORS[1] ^ (codes[2:] * _FACTORS[2] + np.uint32(3))
            found.append((three * _FACTORS[0]) >> shift)
    return np.concatenate(found) if some else np.empty(0, dtype=np.uint32)


@dataclass
class KernelModel:
    languages: list[str]
    columns: np.ndarray  # the n-gram codes that any landmark has
    weights: np.ndarray  # columns x languages

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; ("und", 0.0) for one without letters or an empty model."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        flags = np.zeros(1 << HASH_BITS, dtype=bool)
        for at in range(0, len(texts), 256):
            rows, present, sizes = [], [], []
            for k in range(at, min(at + 256, len(texts))):
                codes = gram_codes(texts[k])
                if len(codes):
                    flags[codes] = True
                    rows.append(k)
                    present.append(flags[self.columns])
                    sizes.append(np.count_nonzero(flags))
                    flags[codes] = False
            if rows:
                scores = np.array(present, dtype=np.float32) @ self.weights / np.sqrt(np.array(sizes, dtype=np.float64))[:, None]
                for k, best, score in zip(rows, scores.argmax(1).tolist(), scores.max(1).tolist(), strict=True):
                    out[k] = (self.languages[best], min(1.0, max(0.0, score)))
        return out


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """A model of (text, language) rows, the first ones of each language being its landmarks; texts without letters are skipped."""
    sets, names = [], []
    for text, name in rows:
        codes = np.unique(gram_codes(text))
        if len(codes):
            sets.append(codes)
            names.append(name)
    languages = sorted(set(names))
    if not languages:
        return KernelModel([], np.empty(0, dtype=np.int64), np.empty((0, 0), dtype=np.float32))
    seen: dict[str, int] = {}
    chosen = []
    for k, name in enumerate(names):
        seen[name] = seen.get(name, 0) + 1
        if seen[name] <= landmarks:
            chosen.append(k)
    columns = np.unique(np.concatenate([sets[k] for k in chosen]))
    place = np.full(1 << HASH_BITS, -1, dtype=np.int64)
    place[columns] = np.arange(len(columns))

    def presence(some: list[int]) -> np.ndarray:
        out = np.zeros((len(some), len(columns)), dtype=np.float32)
        for r, k in enumerate(some):
            at = place[sets[k]]
            out[r, at[at >= 0]] = 1
        return out

    sizes = np.sqrt(np.array([len(s) for s in sets], dtype=np.float64))
    marks = presence(chosen) / sizes[chosen][:, None].astype(np.float32)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([presence(list(range(k, min(k + 256, len(sets))))) @ marks.T for k in range(0, len(sets), 256)]) / sizes[:, None]
    features = kernel @ whiten
    wanted = (np.array(names)[:, None] == np.array(languages)[None, :]).astype(np.float64)
    solved = np.linalg.solve(features.T @ features + ridge * len(sets) * np.eye(features.shape[1]) / features.shape[1], features.T @ wanted)
    return KernelModel(languages, columns.astype(np.int64), (marks.T.astype(np.float64) @ (whiten @ solved)).astype(np.float32))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> KernelModel:
    """Fit on at most sample_rows labelled rows a language, drawn by a hash of doc_id from those not held out, and at most MOST_ROWS in all."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).where(~_held_out())
    counts = chosen.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    each = counts.withColumn("most", F.least(F.lit(sample_rows), F.lit(MOST_ROWS) / F.count("*").over(Window.partitionBy())))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    near = F.col("drawn") < F.least(F.lit(1.0), F.col("most") * 1.5 / F.col("n") + F.lit(20.0) / F.col("n")) * (1 << 20)
    picked = chosen.withColumn("drawn", drawn).join(F.broadcast(each.withColumnRenamed("lang", "known")), F.col("lang") == F.col("known")).where(near)
    rows = sorted((r["drawn"], r["doc_id"], r["text"], r["lang"], int(r["most"])) for r in picked.select("drawn", "doc_id", "text", "lang", "most").collect())
    taken: dict[str, int] = {}
    sample = []
    for _, _, text, name, most in rows:
        taken[name] = taken.get(name, 0) + 1
        if taken[name] <= most:
            sample.append((text, name))
    return fit(sample)


def _scored(docs: DataFrame, model: KernelModel, columns: list[str]) -> DataFrame:
    """The given columns of docs with lang_pred and score; text is the last column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = shared.value.predict([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])
                kept = [part.column(part.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*columns, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    Learned from text and lang of the rows whose crc32 of doc_id mod 4 is not 2; a prediction sees the
    text only. Null and letterless texts are und with score 0, as is everything if no row is
    labelled. A row without doc_id is neither learned from nor held out. Repeated rows come out each,
    an empty table gives no row, other columns are not read. The driver gets the bounded sample and
    one count a language; documents are scored where they lie, without a shuffle.
    """
    model = learn(docs, sample_rows)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _scored(slim, model, ["doc_id"]).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def identified_documents(docs: DataFrame, least_score: float = LEAST_SCORE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose language is known: not und, and scored least_score or more; their lang stays as it is.

    Null, empty and letterless texts are und and go. Rows without lang or doc_id are judged like all
    others. Repeated rows are judged alike; an empty table gives no row, one without labelled rows none either.
    """
    model = learn(docs, sample_rows)
    slim = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return _scored(slim, model, slim.columns).where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select(*slim.columns)
