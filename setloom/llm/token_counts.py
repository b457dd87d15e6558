"""Token counts by rank-synchronous merging of ragged symbol arrays.

A byte-level BPE vocabulary (a ``tokenizers`` .json file) is read as three arrays: pair keys
(a hash table), their ranks and the symbols they make. Pre-tokens not seen before are laid out end to end
in one flat symbol array with a sequence number per symbol. Each round looks up the rank of every
new adjacent pair at once, finds each sequence's lowest rank by a segmented minimum and merges all of
that pair's occurrences in every sequence at the same time; sequences without a mergeable pair
leave with their number of surviving symbols. Counts of pre-tokens are kept per worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from .common import tokenizer_file

#: Pre-tokens whose counts a worker keeps; beyond that it starts anew (results do not change).
CACHE_ENTRIES = 300_000
#: Code points of text whose pre-tokens are held at once.
CHUNK_CHARS = 2_000_000

_NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class RankMerger:
    """Counts tokens of texts as the vocabulary's library gives them."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not a byte-level BPE vocabulary without a prefix space")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # open addressing with linear probing, filled and searched in whole arrays
        self.mask = (1 << max(10, (4 * len(pairs)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.rank_at = np.full(self.mask + 1, _NONE, dtype=np.int64)
        wanted, slot, rank = left * self.size + right, self._slot(left, right), np.arange(len(pairs))
        while len(rank):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.rank_at[slot[put]] = wanted[put], rank[put]
            rest = np.setdiff1d(np.arange(len(rank)), put)
            wanted, rank, slot = wanted[rest], rank[rest], (slot[rest] + 1) & self.mask
        self.split = regex.compile(public_tokenizers.PATTERN)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache: dict[str, int] = {}

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left * 0x9E3779B1 + right * 0x85EBCA77) >> 12) & self.mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; _NONE where the vocabulary has no such merge."""
        wanted, slot = left * self.size + right, self._slot(left, right)
        out = np.full(len(wanted), _NONE, dtype=np.int64)
        todo = np.arange(len(wanted))
        while len(todo):
            key = self.keys[slot]
            found = key == wanted
            out[todo[found]] = self.rank_at[slot[found]]
            more = np.flatnonzero(~found & (key != -1))
            todo, wanted, slot = todo[more], wanted[more], (slot[more] + 1) & self.mask
        return out

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each non-empty pre-token."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, word = np.empty_like(sizes), np.arange(len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.zeros(len(symbols), dtype=bool)
        ends[np.cumsum(sizes) - 1] = True
        ranks = np.full(len(symbols), _NONE)
        open_pairs = np.flatnonzero(~ends)
        ranks[open_pairs] = self.pair_ranks(symbols[open_pairs], symbols[open_pairs + 1])
        while len(word):
            lowest = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
            alive = lowest < _NONE
            if not alive.all():
                counts[word[~alive]] = sizes[~alive]
                keep = np.repeat(alive, sizes)
                symbols, ranks, ends = symbols[keep], ranks[keep], ends[keep]
                word, sizes, lowest = word[alive], sizes[alive], lowest[alive]
                if not len(word):
                    break
            hits = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            beside = np.diff(hits) == 1
            if beside.any():
                # overlapping hits (a pair of equal symbols in a run) merge from the left, every second one
                step = np.arange(len(hits))
                begin = np.maximum.accumulate(np.where(np.r_[True, ~beside], step, 0))
                hits = hits[(step - begin) % 2 == 0]
            symbols[hits] = self.made[ranks[hits]]
            ends[hits] = ends[hits + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hits + 1] = False
            sizes = np.add.reduceat(keep.astype(np.int64), np.cumsum(sizes) - sizes)
            symbols, ranks, ends = symbols[keep], ranks[keep], ends[keep]
            at = hits - np.arange(len(hits))
            ranks[at[ends[at]]] = _NONE
            before = at[at > 0] - 1
            near = np.concatenate([at[~ends[at]], before[~ends[before]]])
            ranks[near] = self.pair_ranks(symbols[near], symbols[near + 1])
        return counts

    def learn(self, words: set[str]) -> None:
        missing = [w for w in words if w not in self.cache]
        if missing:
            if len(self.cache) + len(missing) > CACHE_ENTRIES:
                self.cache.clear()
                missing = list(words)
            self.cache.update(zip(missing, self.survivors([w.encode() for w in missing]).tolist(), strict=True))

    def _pieces(self, text: str) -> tuple[int, list[str]]:
        if self.special is None:
            return 0, [text]
        parts = self.special.split(text)
        return len(parts) - 1, parts

    def count(self, texts: list[str]) -> list[int]:
        out, pending, held = [0] * len(texts), [], 0

        def settle() -> None:
            nonlocal held
            if pending:
                self.learn({w for _, words in pending for w in words})
                get = self.cache.__getitem__
                for k, words in pending:
                    out[k] += sum(map(get, words))
            pending.clear()
            held = 0

        for k, text in enumerate(texts):
            n, parts = self._pieces(text)
            out[k] += n
            for part in parts:
                if len(part) <= CHUNK_CHARS:
                    pending.append((k, self.split.findall(part)))
                    held += len(part)
                    if held >= CHUNK_CHARS:
                        settle()
                    continue
                settle()
                found = self.split.finditer(part)
                while words := [m.group() for m in islice(found, CHUNK_CHARS // 8)]:
                    pending.append((k, words))
                    settle()
        settle()
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    """One merger a worker and vocabulary."""
    return RankMerger(path)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; a null doc_id
    stays null; other columns are not read. Strings of special tokens inside a text are one token
    each, as the library's default has it. No shuffle: one pass over two columns.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = merger(tokenizer_file(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = counts.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
