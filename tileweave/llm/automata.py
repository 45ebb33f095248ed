"""Weighted acyclic automata of word n-grams, three levels deep, in numpy.

A table of counted paths (``g, h2, h3, n``: first word, next words or 0 where a path ends) is kept sorted by its labels.
``encode`` turns it into a transducer: the arcs of the root carry first words, every arc carries the number of
occurrences of the path up to it, and states with equal arcs are one state. ``decode`` gives the table back, ``condense``
sums weights of a union, ``weigh`` composes a transducer with an acceptor of requested paths.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .tokens import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Names:
    """What the first labels stand for: ``g`` (ascending), the word's own hash ``h``, its bytes and its language."""

    g: np.ndarray
    h: np.ndarray
    word: pa.Array
    lang: pa.Array

    def take(self, at: np.ndarray) -> "Names":
        return Names(self.g[at], self.h[at], self.word.take(pa.array(at)), self.lang.take(pa.array(at)))

    @staticmethod
    def union(parts: list["Names"]) -> "Names":
        both = Names(np.concatenate([p.g for p in parts]), np.concatenate([p.h for p in parts]), pa.concat_arrays([p.word for p in parts]), pa.concat_arrays([p.lang for p in parts]))
        return both.take(np.unique(both.g, return_index=True)[1])


@dataclass
class Paths:
    """Distinct counted paths, sorted by ``g, h2, h3``."""

    g: np.ndarray
    h2: np.ndarray
    h3: np.ndarray
    n: np.ndarray

    def __len__(self):
        return len(self.g)

    def at(self, rows) -> "Paths":
        return Paths(self.g[rows], self.h2[rows], self.h3[rows], self.n[rows])


def condense(parts: list[Paths]) -> Paths:
    """The union of tables in any order, weights of equal paths summed."""
    g, h2, h3, n = (np.concatenate([getattr(p, c) for p in parts]) for c in ("g", "h2", "h3", "n"))
    # The callers' tables are not needed any more.
    parts.clear()
    if not len(g):
        return Paths(g, h2, h3, n)
    packed, fits = np.zeros(len(g), np.int64), True
    for x in (g, h2, h3):
        labels, code = np.unique(x, return_inverse=True)
        fits &= len(labels) <= 1 << 21
        packed = packed << 21 | code
    order = np.argsort(packed, kind="stable") if fits else np.lexsort((h3, h2, g))
    g, h2, h3 = g[order], h2[order], h3[order]
    edge = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h2[1:] != h2[:-1]) | (h3[1:] != h3[:-1])]))
    return Paths(g[edge], h2[edge], h3[edge], np.add.reduceat(n[order], edge))


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of consecutive runs, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _sum(owner: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, values.dtype)
    np.add.at(out, owner, values)
    return out


def _share(owner: np.ndarray, sign: np.ndarray, size: int):
    """Registers states: those with equal sums of arc signs are one. First holder, state of each, sum of each."""
    with np.errstate(over="ignore"):
        total = _sum(owner, sign, size)
    _, first, state = np.unique(total, return_index=True, return_inverse=True)
    return first, state, total


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def pack(arrays: list[np.ndarray]) -> bytes:
    head = struct.pack("<i", len(arrays)) + b"".join(a.dtype.str.encode().ljust(4) + struct.pack("<q", len(a)) for a in arrays)
    return head + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    (count,), out, at = struct.unpack_from("<i", blob), [], 0
    at = 4 + 12 * count
    for k in range(count):
        kind, length = np.dtype(blob[4 + 12 * k : 8 + 12 * k].decode().strip()), struct.unpack_from("<q", blob, 8 + 12 * k)[0]
        out.append(np.frombuffer(blob, kind, length, at))
        at += kind.itemsize * length
    return out


def _text(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = words.to_pylist()
    return np.array([len(p) for p in parts], np.int64), np.frombuffer(b"".join(parts), np.uint8)


def encode(paths: Paths, names: Names) -> bytes:
    """The minimal transducer of sorted distinct paths; ``names`` covers their first labels."""
    g, h2, h3, n = paths.g, paths.h2, paths.h3, paths.n
    new1 = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
    new2 = new1.copy()
    new2[1:] |= h2[1:] != h2[:-1]
    one, two = np.flatnonzero(new1), np.flatnonzero(new2)
    w1 = np.add.reduceat(n, one) if len(one) else n
    w2 = np.add.reduceat(n, two) if len(two) else n
    real = h2[two] > 0
    two, w2 = two[real], w2[real]
    three = np.flatnonzero(h3 > 0)
    owner2, owner3 = np.cumsum(new1)[two] - 1, np.searchsorted(two, three, "right") - 1
    with np.errstate(over="ignore"):
        sign3 = mix(mix(h3[three]) + n[three].astype(np.uint64) * _STEP)
        first3, state3, total3 = _share(owner3, sign3, len(two))
        sign2 = mix(mix(h2[two]) + w2.astype(np.uint64) * _STEP) * _STEP
        first2, state2, _ = _share(owner2, mix(sign2 ^ mix(total3)), len(one))
    begin3, length3 = np.searchsorted(owner3, first3), np.bincount(owner3, minlength=len(two))[first3]
    begin2, length2 = np.searchsorted(owner2, first2), np.bincount(owner2, minlength=len(one))[first2]
    arcs3, arcs2 = three[_runs(begin3, length3)], _runs(begin2, length2)
    symbols, spots = np.unique(np.concatenate([h2[two[arcs2]], h3[arcs3]]), return_inverse=True)
    mine = names.take(np.searchsorted(names.g, g[one]))
    langs = mine.lang.dictionary_encode()
    arrays = [mine.g, mine.h, _small(w1), _small(state2), _small(length2), _small(spots[: len(arcs2)]), _small(w2[arcs2]), _small(state3[arcs2])]
    arrays += [_small(length3), _small(spots[len(arcs2) :]), _small(n[arcs3]), symbols, _small(np.asarray(langs.indices))]
    for words in (mine.word, langs.dictionary.cast(pa.large_binary())):
        lengths, data = _text(words)
        arrays += [_small(lengths), data]
    return pack(arrays)


def _words(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


class Transducer:
    def __init__(self, blob: bytes):
        g, h, w1, t1, length2, l2, w2, t2, length3, l3, w3, symbols, lang, sizes, data, lang_sizes, lang_data = unpack(blob)
        self.names = Names(g, h, _words(sizes, data), _words(lang_sizes, lang_data).cast(pa.large_string()).take(pa.array(lang.astype(np.int64))))
        self.symbols, self.l2, self.l3 = symbols, l2.astype(np.int64), l3.astype(np.int64)
        self.w1, self.w2, self.w3 = (w.astype(np.int64) for w in (w1, w2, w3))
        self.t1, self.t2, self.length2, self.length3 = (t.astype(np.int64) for t in (t1, t2, length2, length3))
        self.begin2, self.begin3 = np.cumsum(self.length2) - self.length2, np.cumsum(self.length3) - self.length3

    def arcs(self):
        """All paths of two words (owner in the root, label, weight) and of three (owner among those of two, label, weight)."""
        long2 = self.length2[self.t1]
        of1, arc2 = np.repeat(np.arange(len(self.t1)), long2), _runs(self.begin2[self.t1], long2)
        state = self.t2[arc2]
        long3 = self.length3[state]
        of2, arc3 = np.repeat(np.arange(len(arc2)), long3), _runs(self.begin3[state], long3)
        return (of1, self.symbols[self.l2[arc2]], self.w2[arc2]), (of2, self.symbols[self.l3[arc3]], self.w3[arc3])

    def paths(self) -> Paths:
        """The table that was encoded: what of a weight is not in longer paths belongs to a path that ends there."""
        (of1, second, w2), (of2, third, w3) = self.arcs()
        g, none = self.names.g, np.uint64(0)
        end1, end2 = self.w1 - _sum(of1, w2, len(g)), w2 - _sum(of2, w3, len(w2))
        a, b = np.flatnonzero(end1), np.flatnonzero(end2)
        return Paths(
            np.concatenate([g[a], g[of1[b]], g[of1[of2]]]), np.concatenate([np.full(len(a), none), second[b], second[of2]]),
            np.concatenate([np.full(len(a) + len(b), none), third]), np.concatenate([end1[a], end2[b], w3]),
        )

    def weigh(self, g: np.ndarray, h2: np.ndarray):
        """Weights of paths of one word (``h2`` 0) or two, and the place of the first word among the root's arcs (-1: none)."""
        if not len(self.w1):
            return np.zeros(len(g), np.int64), np.full(len(g), -1)
        root = np.minimum(np.searchsorted(self.names.g, g), len(self.w1) - 1)
        found = self.names.g[root] == g
        weight = np.where(found, self.w1[root], 0)
        deep = np.flatnonzero(found & (h2 > 0))
        weight[h2 > 0] = 0
        if len(deep) and len(self.l2):
            label = np.minimum(np.searchsorted(self.symbols, h2[deep]), len(self.symbols) - 1)
            known = self.symbols[label] == h2[deep]
            arcs = np.repeat(np.arange(len(self.length2)), self.length2) << 32 | self.l2
            want = self.t1[root[deep]] << 32 | label
            arc = np.minimum(np.searchsorted(arcs, want), len(arcs) - 1)
            weight[deep] = np.where(known & (arcs[arc] == want), self.w2[arc], 0)
        return weight, np.where(found, root, -1)
