"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the split pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Counts of pre-tokens kept by a worker; the table is emptied when it is full.
CACHE = 300_000
# Pre-token bytes merged at once.
MERGE_BYTES = 4_000_000

_BITS = 18
_NONE = np.int64(2**62)


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """Merge table of a vocabulary as sorted arrays; small and fixed, so it is sent with the task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = len(vocab) + 1
        symbols = _byte_symbols()
        self.first = np.array([vocab[symbols[b]] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # One slot per hash; keys that lost their slot are found by binary search.
        self.slot_key = np.full(2**_BITS, -1, dtype=np.int64)
        self.slot_rank = np.zeros(2**_BITS, dtype=np.int64)
        slot = self._slot(self.keys)
        self.slot_key[slot], self.slot_rank[slot] = self.keys, self.ranks
        self.shared = np.bincount(slot, minlength=2**_BITS) > 1
        self.counter: Counter | None = None
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        slot = self._slot(wanted)
        found = self.slot_key[slot] == wanted
        rank = np.where(found, self.slot_rank[slot], _NONE)
        rest = np.flatnonzero(self.shared[slot] & ~found)
        if len(rest):
            at = np.minimum(np.searchsorted(self.keys, wanted[rest]), len(self.keys) - 1)
            rank[rest] = np.where(self.keys[at] == wanted[rest], self.ranks[at], _NONE)
        return rank

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def count(self, parts: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte string after all merges.

        All strings advance together: in each round every string merges all places of its own
        lowest-rank pair (of overlapping places, every other one from the left). Strings with no
        pair left drop out of the arrays.
        """
        out = np.zeros(len(parts), dtype=np.int64)
        if not parts:
            return out
        length = np.array([len(p) for p in parts], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        who = np.arange(len(parts))
        while len(who):
            begin = np.concatenate(([0], np.cumsum(length)[:-1]))
            rank = np.full(len(symbols), _NONE, dtype=np.int64)
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[begin + length - 1] = _NONE
            lowest = np.minimum.reduceat(rank, begin)
            owner = np.repeat(np.arange(len(who)), length)
            hit = (rank == lowest[owner]) & (rank != _NONE)
            ahead = np.concatenate(([False], hit[:-1]))
            if (hit & ahead).any():
                places = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~ahead, places, 0))
                hit &= (places - run) % 2 == 0
            symbols = np.where(hit, self.made[np.where(hit, rank, 0)], symbols)
            keep = ~np.concatenate(([False], hit[:-1]))
            merged = np.bincount(owner[hit], minlength=len(who))
            done = lowest == _NONE
            out[who[done]] = length[done]
            length = length - merged
            keep &= ~done[owner]
            symbols, who, length = symbols[keep], who[~done], length[~done]
        return out


class Counter:
    """Counts tokens of texts, remembering the counts of common pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
        self.known: dict[str, int] = {}

    def learn(self, missing: list[str]) -> None:
        parts = [m.encode() for m in missing]
        lo, size = 0, 0
        for i, p in enumerate(parts):
            size += len(p)
            if size >= MERGE_BYTES or i == len(parts) - 1:
                counts = self.merges.count(parts[lo : i + 1])
                self.known.update(zip(missing[lo : i + 1], counts.tolist(), strict=True))
                lo, size = i + 1, 0

    def count(self, texts: list[str | None]) -> list[int]:
        out, block, size = [], [], 0
        for i, t in enumerate(texts):
            block.append(t or "")
            size += len(block[-1])
            if size >= MERGE_BYTES or i == len(texts) - 1:
                out += self._count(block)
                block, size = [], 0
        return out

    def _count(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for t in texts:
            pieces = self.special.split(t) if self.special else [t]
            extra.append(len(pieces) - 1)
            found = self.split.findall(pieces[0])
            for p in pieces[1:]:
                found += self.split.findall(p)
            split.append(found)
        distinct: set[str] = set()
        distinct.update(*split)
        if len(self.known) > CACHE:
            self.known = {}
        self.learn([t for t in distinct if t not in self.known])
        get = self.known.__getitem__
        return [sum(map(get, found)) + e for found, e in zip(split, extra, strict=True)]


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row.

    `tokenizer` is a byte-level BPE file; it is read on the driver and its merge arrays (a few MB,
    fixed by the vocabulary) go to the tasks. One narrow pass, no shuffle. A null text counts as empty;
    ids may be null or repeated, every row gets its own result; other columns are not read.
    """
    merges = docs.sparkSession.sparkContext.broadcast(Merges(tokenizer))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Kept with the broadcast value, so that later tasks of this worker know its counts.
        counter = merges.value.counter = merges.value.counter or Counter(merges.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_tokens = counter.count(texts)
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
