"""Array kernels over the UTF-8 bytes of many texts at once: word spans and 64-bit hashes.

A hash of any byte span comes from prefix sums of a polynomial over random byte values
(arithmetic modulo 2^64, odd base), so all words and shingles of a piece of a batch cost a
few passes over its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters; bytes of other scripts count as letters.
NOT_LETTER = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, 256, dtype=U64)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[U64(1)], np.full(n, x, U64)]), dtype=U64) for x in (BASE, pow(BASE, -1, 2**64)))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others (a bijection)."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


#: Bytes whose prefix sums are held at once; longer arrays are summed block by block, with the same results.
BLOCK_BITS = 21


class Rolling:
    """Hashes of spans of one byte array."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.data, self.seed, self.block = data, seed, 1 << BLOCK_BITS
        self.up, self.down = _powers(BLOCK_BITS)
        self.sums = self._summed(data) if len(data) <= self.block else None

    def _summed(self, part: np.ndarray, scale: int = 1) -> np.ndarray:
        values = _byte_values(self.seed)[part]
        values *= self.up[: len(part)]
        out = np.zeros(len(part) + 1, U64)
        np.cumsum(values, out=out[1:])
        return out * U64(scale) if scale != 1 else out

    def _at(self, places: np.ndarray) -> np.ndarray:
        """Prefix sums at these places."""
        if self.sums is not None:
            return self.sums[places]
        order = np.argsort(places, kind="stable")
        ordered, out, total = places[order], np.zeros(len(places), U64), U64(0)
        for begin in range(0, len(self.data), self.block):
            sums = self._summed(self.data[begin : begin + self.block], pow(BASE, begin, 2**64)) + total
            i, j = np.searchsorted(ordered, [begin, begin + len(sums)])
            out[order[i:j]] = sums[ordered[i:j] - begin]
            total = sums[-1]
        return out

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high = starts >> BLOCK_BITS
        back = self.down[starts & (self.block - 1)]
        if self.sums is None:
            step = pow(pow(BASE, -1, 2**64), self.block, 2**64)
            back = back * np.array([pow(step, k, 2**64) for k in range((len(self.data) >> BLOCK_BITS) + 1)], U64)[high]
        elif len(self.data) == self.block:
            back = np.where(high > 0, self.down[self.block], back)
        return mix((self._at(ends) - self._at(starts)) * back)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and where each row begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts in order: bytes, span ends, row, and first word of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def hashes(self, seed: int = 1) -> np.ndarray:
        return Rolling(self.data, seed).spans(self.starts, self.ends)


def words_of(column: pa.Array, lower: bool = True, breaks: np.ndarray = SPACE) -> Words:
    data, at = flat(column)
    if lower:
        data = LOWER[data]
    inside = ~breaks[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    heads = at[:-1][at[:-1] < at[1:]]
    begins[heads] = inside[heads]
    tails = at[1:][at[:-1] < at[1:]] - 1
    stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(data, starts, ends, row, first)


def shingles(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of n words within a row."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.zeros(len(hashes) - n + 1, U64)
    for i in range(n):
        h = mix(h * U64(BASE) + hashes[i : len(hashes) - n + 1 + i])
    whole = words.row[: len(h)] == words.row[n - 1 :]
    return h[whole], words.row[: len(h)][whole]


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in a sorted array, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys, at


class Lookup:
    """A sorted array of hashes with a directory over its leading bits, for fast membership of
    very many keys: a key not there usually costs one look at the directory."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, U64)
        self.bits = max(8, min(22, len(keys).bit_length() + 2))
        bucket = (self.keys >> U64(64 - self.bits)).astype(np.int64)
        self.at = np.searchsorted(bucket, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.at).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        bucket = (keys >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.at[bucket], self.at[bucket + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        at, end, key = at[left], end[left], keys[left]
        for _ in range(self.longest):
            hit = self.keys[at] == key
            out[left[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end)
            if not go.any():
                break
            left, at, end, key = left[go], at[go], end[go], key[go]
        return out
