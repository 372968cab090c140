"""Words of whole texts as numpy arrays over Arrow string buffers, for the operators that run in Arrow batches.

A word is identified by a 64-bit polynomial hash of its bytes, so that windows and shingles of words can be hashed with a
few vector operations. Batches are cut into slices of bounded bytes; a single text may exceed the bound, and is then a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
HASH_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = [not chr(c).isalnum() for c in range(0x80)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalize 64-bit values so that every bit depends on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and its inverse modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, HASH_BYTES + 4096)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", inverse)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """hashes, first byte and end byte of every word of a slice; words of text i are ``of[i]:of[i + 1]``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    data: np.ndarray
    text_at: np.ndarray


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts hold about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64).cumsum()
        first = 0
        while first < batch.num_rows:
            base = at[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(at, base + size, "right")))
            yield batch.slice(first, last - first)
            first = last


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    texts = texts if pa.types.is_large_binary(texts.type) else pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at - at[0]


def words(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    data, at = buffers(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~separators[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    stops = inside[:n].copy()
    stops[:-1] &= ~inside[1:n]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(byte_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, at), data, at)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes ``starts[i]:ends[i]``, given in order."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            base = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, base + HASH_BYTES, "right")))
            piece = data[base : ends[last - 1]]
            up, down = _power_tables(len(piece))
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
            a, b = starts[first:last] - base, ends[first:last] - base
            out[first:last] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            first = last
    return out


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words; runs that cross texts are the caller's to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(seed), np.uint64)
        for i in range(k):
            total = total * BASE + hashes[i : i + n]
            total ^= total >> np.uint64(29)
        return mix(total)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))
