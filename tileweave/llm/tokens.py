"""Vectorised words, lines and shingles of many texts at once (numpy over the UTF-8 bytes of a chunk).

Equality of words, lines and shingles is equality of 64-bit hashes: polynomial prefix sums over the bytes,
finished by a bijective mixer. Only local memory is used, a few dozen bytes per byte of a chunk, so chunks
are cut at ``CHUNK`` bytes between texts; a single longer text is a chunk of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int):
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _BACK))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Texts:
    """The bytes of consecutive texts: ``data``, and ``at`` with the offset of each text and the end."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        self.n = len(at) - 1
        self.white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        self._sums = None

    def edges(self) -> np.ndarray:
        """True at the first byte of each text."""
        first = np.zeros(len(self.data) + 1, bool)
        first[self.at] = True
        return first[:-1]

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position, "right") - 1

    def words(self):
        """Start, end and text number of each word."""
        solid, first = ~self.white, self.edges()
        before = np.concatenate([[False], solid[:-1]]) & ~first
        start = np.flatnonzero(solid & ~before)
        last = np.concatenate([first[1:], [True]])
        after = np.concatenate([solid[1:], [False]]) & ~last
        end = np.flatnonzero(solid & ~after) + 1
        return start, end, self.text_of(start)

    def lines(self):
        """Start, end and text number of each line; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 0x0A)
        owner = self.text_of(breaks)
        start = np.concatenate([self.at[:-1], breaks + 1])
        text = np.concatenate([np.arange(self.n), owner])
        order = np.lexsort((start, text))
        start, text = start[order], text[order]
        end = np.concatenate([start[1:] - 1, self.at[-1:]]) if len(start) else start
        if len(start):
            closing = np.concatenate([text[1:] != text[:-1], [True]])
            end[closing] = self.at[text[closing] + 1]
        return start, end, text

    def hashes(self, start: np.ndarray, end: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """A hash of the bytes of each range."""
        power, back = _power_tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            sums = self._sums if data is None else None
            if sums is None:
                source = self.data if data is None else data
                sums = np.zeros(len(source) + 1, np.uint64)
                np.cumsum((source.astype(np.uint64) + np.uint64(1)) * power[: len(source)], out=sums[1:])
                if data is None:
                    self._sums = sums
            raw = (sums[end] - sums[start]) * back[start]
            return mix(raw ^ mix((end - start).astype(np.uint64)))

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte for each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    return out


def shingles(word_hash: np.ndarray, text: np.ndarray, k: int):
    """Hash, first word and text number of each window of ``k`` words inside one text."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(k))
        for i in range(k):
            h = mix(h * _BASE + word_hash[i : i + n])
    first = np.flatnonzero(text[:n] == text[k - 1 :])
    return h[first], first, text[first]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK):
    """Pairs (first row, Texts) over a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, Texts(data[at[row] : at[stop]], at[row : stop + 1] - at[row])
        row = stop


def repeats(keys: np.ndarray, text: np.ndarray):
    """Two flags per entry: another entry of its text has the same key; an earlier one has."""
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    same = np.zeros(len(keys), bool)
    same[1:] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    any_ = same.copy()
    any_[:-1] |= same[1:]
    shared, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    shared[order], later[order] = any_, same
    return shared, later
