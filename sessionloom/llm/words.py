"""Vectorised word splitting and hashing over whole Arrow batches.

Texts are handled as UTF-8 bytes. Both word classes used here are classes of bytes (every byte of a
non-ASCII character is above 0x7F), so a batch is split with a few numpy passes over its bytes, without
a Python loop over words. A word's hash is a polynomial over random byte values, taken from prefix sums
modulo 2**64, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once; a longer text is a slice of its own.
SLICE = 1_000_000

_rng = np.random.default_rng(20240611)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# [^\x20\x09-\x0D]
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

# [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n; grown on demand."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        steps = np.full(size, _BASE, dtype=np.uint64)
        back = np.full(size, _BASE_INVERSE, dtype=np.uint64)
        steps[0] = back[0] = 1
        _powers = (np.multiply.accumulate(steps), np.multiply.accumulate(back))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a slice: byte ranges, hashes, and where each text's words begin (n + 1 offsets)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


def split(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    """Words of the texts data[bounds[i]:bounds[i + 1]], A-Z lower-cased."""
    low = _LOWER[data]
    inside = table[low]
    n = len(low)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = bounds[:-1] < bounds[1:]
    heads, tails = bounds[:-1][full], bounds[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[low] * powers[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(low, start, end, hashes, np.searchsorted(start, bounds))


def prefix_hashes(words: Words, k: int) -> np.ndarray:
    """Hash of the first k bytes of each word (of all of a shorter one)."""
    n = len(words.data)
    powers, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[words.data] * powers[:n], out=total[1:])
    end = np.minimum(words.end, words.start + k)
    return (total[end] - total[words.start]) * inverse[words.start]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `size` bytes each."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_slices(texts: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, words) for slices of a batch."""
    data, bounds = buffers(texts)
    for lo, hi in slices(bounds):
        yield lo, hi, split(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], table)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive words at each position; the caller masks positions near a text's end."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * _STEP + hashes[j : j + n]
    return mix(out + np.uint64(k))


def owners(offsets: np.ndarray) -> np.ndarray:
    """Text number of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def hash_text(text: str, table: np.ndarray) -> np.ndarray:
    """Word hashes of one text; for small driver-side tables such as phrase lists."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return split(data, np.array([0, len(data)]), table).hashes
