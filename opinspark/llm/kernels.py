"""Vectorised byte and word kernels over Arrow string batches (numpy only).

Texts are handled as UTF-8. Both word classes in use break at ASCII bytes alone,
and every byte of a non-ASCII character is 0x80 or more, so byte-wise tokenizing
is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64

ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing A-Z
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
SOLID = np.ones(256, bool)  # [^\x20\x09-\x0D]
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * U(2) + U(1)
BASE = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


KEPT = 1 << 18  # powers that a worker keeps; longer runs (a very long text) make theirs anew


def _powers_to(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_kept = lru_cache(8)(lambda base: _powers_to(base, KEPT))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    up, down = _kept(base) if n <= KEPT else _powers_to(base, n)
    return up[:n], down[:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which ``spans`` reads the hash of any run of values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(base, len(sums))[1][start])


def rolling(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each k consecutive values; positions are those of the first value."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix(values, base)
    return mix((sums[k:] - sums[:-k]) * powers(base, len(sums))[1][:n])


class Texts:
    """UTF-8 bytes of a run of texts: ``data`` with ``bounds`` (text i is data[bounds[i]:bounds[i+1]])."""

    def __init__(self, column: pa.Array, first: int = 0):
        column = column.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        self.data, self.bounds, self.first = data[bounds[0] : bounds[-1]], bounds - bounds[0], first

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(texts: pa.Array, most: int = KEPT - 1) -> Iterator[tuple[int, int]]:
    """Bounds of slices with about ``most`` bytes of text each (a longer text comes alone), whole texts only."""
    sizes = np.asarray(pc.binary_length(texts.cast(pa.large_binary()).fill_null(b"")))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at = to


def parts(batch: pa.RecordBatch, column: str, most: int = KEPT - 1) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch, and their texts."""
    texts = batch.column(column)
    for at, to in slices(texts, most):
        yield batch.slice(at, to - at), Texts(texts.slice(at, to - at), at)


class Words:
    """Words of ``texts``: byte ``start`` and ``end``, the ``doc`` (text number) of each, and ``of``: bounds by text."""

    def __init__(self, texts: Texts, kind: np.ndarray, lower: bool):
        data = LOWER[texts.data] if lower else texts.data
        inside = kind[data]
        edge = np.empty(len(data) + 1, bool)
        edge[1:-1] = inside[1:] & ~inside[:-1]
        if len(data):
            edge[0], edge[-1] = inside[0], False
        bounds = texts.bounds[:-1][np.diff(texts.bounds) > 0]
        starts_here = bounds[inside[bounds]] if len(data) else bounds
        edge[starts_here] = True
        self.start = np.flatnonzero(edge[:-1])
        edge[1:-1] = inside[:-1] & ~inside[1:]
        if len(data):
            edge[0], edge[-1] = False, inside[-1]
        ends_here = texts.bounds[1:][np.diff(texts.bounds) > 0]
        edge[ends_here[inside[ends_here - 1]] if len(data) else ends_here] = True
        self.end = np.flatnonzero(edge) if len(data) else self.start
        self.data = data
        self.of = np.searchsorted(self.start, texts.bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.of))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        base = BASE[which]
        return spans(prefix(BYTE[which][self.data], base), self.start, self.end, base)

    def windows(self, k: int) -> np.ndarray:
        """First words of each k consecutive words of one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(n: int, start: np.ndarray, length: int) -> np.ndarray:
    """Mask of n places with [s, s+length) set for every s of start."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
