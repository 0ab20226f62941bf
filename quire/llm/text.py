"""Vectorised tokenisation and hashing shared by the text operators.

A word is a maximal run of characters other than ASCII space, tab, newline, carriage
return and form feed, as in SQL; unless stated otherwise texts are lower-cased first. All arithmetic is on whole Arrow batches in
numpy: no Python code runs per word or per character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, _U)


def powers(n: int) -> np.ndarray:
    """The first n powers of the odd multiplier, modulo 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1] * _ODD)])
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the 64-bit murmur one)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@dataclass
class Words:
    """Words of a batch: hash, byte range in `data`, and for each text its range of words."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def count(self) -> np.ndarray:
        return np.diff(self.bounds)

    def piece(self, first: int, last: int) -> str:
        """The text from word `first` up to word `last` (exclusive), both of the whole batch."""
        return "" if last <= first else self.data[self.start[first] : self.end[last - 1]].tobytes().decode("utf-8", "replace")


def to_array(column) -> pa.Array:
    """A string array without chunks, NULL read as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not isinstance(column, pa.Array):
        column = pa.array(column, pa.large_string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def words(column, lower: bool = True) -> Words:
    texts = to_array(column)
    if lower:
        texts = pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base, stop = int(offsets[0]), int(offsets[-1])
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[base:stop] if raw is not None and stop > base else np.zeros(0, np.uint8)
    cuts = offsets - base
    solid = (data != 32) & (data != 9) & (data != 10) & (data != 12) & (data != 13)
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    begins = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    bounds = np.searchsorted(begins, cuts)
    return Words(_hash(data, begins, ends), begins, ends, bounds, data)


def _hash(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte range."""
    out = np.zeros(len(begins), _U)
    step = 200_000
    for k in range(0, len(begins), step):
        b, e = begins[k : k + step], ends[k : k + step]
        size = e - b
        at = np.zeros(len(b) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        within = np.arange(at[-1], dtype=np.int64) - np.repeat(at[:-1], size)
        letters = data[within + np.repeat(b, size)].astype(_U) + _U(1)
        table = mix(powers(int(size.max()) + 1))
        out[k : k + step] = mix(np.add.reduceat(letters * table[within], at[:-1]) + size.astype(_U))
    return out


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text in order, and their bounds by text.

    A text of 1 to n - 1 words has one gram, all its words; a text without words has none.
    """
    count = w.count()
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.zeros(len(count) + 1, np.int64)
    np.cumsum(grams, out=bounds[1:])
    first = np.repeat(w.bounds[:-1] - bounds[:-1], grams) + np.arange(bounds[-1])
    last = np.repeat(w.bounds[1:], grams)
    salt = mix(powers(n + 1))
    out = np.zeros(len(first), _U)
    padded = np.concatenate([w.hash, np.zeros(n, _U)])
    for j in range(n):
        out += np.where(first + j < last, padded[first + j] * salt[j], salt[n])
    return mix(out), bounds
