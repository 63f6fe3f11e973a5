"""Substring dedup with fixed-block anchors.

Each document is cut into blocks of 25 words that do not overlap; the blocks are the index. Any window of 50 words
holds a whole block of whatever document it repeats, so it is enough to probe the index with
every rolling 25-word window: what hits is an anchor. Only 50-word windows that hold one are looked at any further: they are compared
by two independent 64-bit hashes of all their words (anchors may collide, which is harmless), which extends anchors to maximal repeats:
a word goes if a window over it also starts in a document of a smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import exchange as X
from .common import materialize

BLOCK_FLAG, MANY_FLAG = 1, 2


class _Chunk:
    """Words of a chunk's documents, hashed a few megabytes at a time."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.ids = X.ids_of(table)
        self.parts = []
        hashes, doc, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in table.select(["text"]).to_batches():
            for _, texts in K.parts(batch, "text"):
                words = K.Words(texts, K.SOLID, False)
                hashes.append(words.hashes())
                doc.append(words.doc + base)
                self.parts.append((texts, words))
                base += len(texts)
        self.hashes, self.doc = np.concatenate(hashes), np.concatenate(doc)
        self.of = np.searchsorted(self.doc, np.arange(base + 1))

    def second(self) -> np.ndarray:
        """Hashes of the words that are independent of ``hashes``."""
        return np.concatenate([np.zeros(0, np.uint64), *[words.hashes(1) for _, words in self.parts]])

    def windows(self, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of k words, and their hashes."""
        n = len(self.doc) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, K.rolling(self.hashes, k, base)[at]


def _distinct(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.ones(len(keys), bool)
    edge[1:] = keys[1:] != keys[:-1]
    return keys[edge], np.flatnonzero(edge), *[c[order] for c in columns]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns begin to differ from the row before."""
    edge = np.zeros(len(columns[0]), bool)
    edge[:1] = True
    for c in columns:
        edge[1:] |= c[1:] != c[:-1]
    return edge


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, spans``: one row per row of ``docs``.

    ``spans`` are the maximal runs of removed words (first, end exclusive), ``kept_text`` the other words joined by one
    space. Null, empty and short texts lose nothing; rows of the same id don't make each other lose words; a null id
    counts as larger than all others. Other columns are not looked at.
    """
    block = window // 2
    pages = X.Pages(docs, doc_id, text)
    words = pages.bytes / 5
    bits, bits50 = pages.ranges(words), pages.ranges(words / 4)

    def probe(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table)
        at, keys = chunk.windows(block, K.BASE[2])
        keys = X.truncated(keys, bits, 4)
        indexed = (at - chunk.of[chunk.doc[at]]) % block == 0
        distinct, begin, indexed, owner = _distinct(keys, indexed, chunk.ids[chunk.doc[at]])
        if not len(distinct):
            return X.pack(0, bits, distinct, 4, np.zeros(0, np.uint8))
        flags = np.bitwise_or.reduceat(indexed.astype(np.uint8) * BLOCK_FLAG, begin)
        many = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)
        return X.pack(table.column("chunk")[0].as_py(), bits, distinct, 4, flags | many.astype(np.uint8) * MANY_FLAG)

    def match(table: pa.Table) -> pa.Table:
        keys, flags, _, row = X.unpack(table, 4)
        order = np.argsort(keys, kind="stable")
        _, begin, sorted_flags = _distinct(keys, flags)
        both = np.bitwise_or.reduceat(sorted_flags, begin)
        size = np.diff(np.append(begin, len(keys)))
        hit = (both & BLOCK_FLAG > 0) & ((size > 1) | (both & MANY_FLAG > 0))
        keep = np.zeros(len(keys), bool)
        keep[order] = np.repeat(hit, size)
        return X.answer(table, keys, row, keep)

    def near_anchors(chunk: _Chunk, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold an anchor: first words and two independent hashes of all their words."""
        at, keys = chunk.windows(block, K.BASE[2])
        anchor = np.zeros(len(chunk.doc) + 1, np.int64)
        anchor[at[X.among(anchors, X.truncated(keys, bits, 4))]] = 1
        before = np.concatenate(([0], np.cumsum(anchor)))
        at, keys = chunk.windows(window, K.BASE[3])
        near = before[at + window - block + 1] > before[at]
        at, keys = at[near], keys[near]
        return at, keys, K.rolling(chunk.second(), window, K.BASE[0])[at] if len(at) else keys

    def extend(table: pa.Table, anchors: pa.Table) -> pa.Table:
        chunk = _Chunk(table)
        at, keys, checks = near_anchors(chunk, X.answered(anchors, bits, 4))
        owner = chunk.ids[chunk.doc[at]]
        order = np.lexsort((checks, keys))
        keys, checks, owner = keys[order], checks[order], owner[order]
        begin = np.flatnonzero(_starts(keys, checks))
        least = np.minimum.reduceat(owner, begin) if len(begin) else owner
        many = (np.maximum.reduceat(owner, begin) if len(begin) else owner) != least
        name = table.column("chunk")[0].as_py() if len(table) else 0
        return X.pack(name, bits50, keys[begin], 8, many.astype(np.uint8), least, checks[begin])

    def earliest(table: pa.Table) -> pa.Table:
        """To each chunk its windows that start in an earlier document too, with the smallest id that any has."""
        keys, checks, ids, row = X.checked(table)
        many = np.frombuffer(b"".join(x or b"" for x in table.column("flags").to_pylist()), np.uint8) > 0
        order = np.lexsort((checks, keys))
        begin = np.flatnonzero(_starts(keys[order], checks[order]))
        least = np.empty(len(keys), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], begin), np.diff(np.append(begin, len(keys)))) if len(begin) else ids
        keep = (ids > least) | many
        edges = np.searchsorted(row, np.arange(len(table) + 1))
        chunk = table.column("chunk").to_pylist()
        parts = [(chunk[i], np.flatnonzero(keep[edges[i] : edges[i + 1]]) + edges[i]) for i in range(len(chunk))]
        parts = [(c, at) for c, at in parts if len(at)]
        blob = lambda x: pa.array([x[at].tobytes() for _, at in parts], pa.binary())
        return pa.table({"chunk": pa.array([c for c, _ in parts], pa.int32()), "keys": blob(keys), "checks": blob(checks), "ids": blob(least)})

    result = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<first:long,end:long>>"

    def remove(table: pa.Table, late: pa.Table) -> pa.Table:
        chunk = _Chunk(table)
        known, check, least, _ = X.checked(late)
        order = np.lexsort((check, known))
        known, check, least = known[order], check[order], least[order]
        at, keys = chunk.windows(window, K.BASE[3])
        hit = X.among(known, keys)
        at, keys = at[hit], keys[hit]
        gone = np.zeros(len(chunk.doc), bool)
        if len(at):
            checks = K.rolling(chunk.second(), window, K.BASE[0])[at]
            pair = np.rec.fromarrays([known, check], names="a,b")
            place = np.minimum(np.searchsorted(pair, np.rec.fromarrays([keys, checks], names="a,b")), len(pair) - 1)
            same = (known[place] == keys) & (check[place] == checks)
            drop = same & (chunk.ids[chunk.doc[at]] > least[place])
            gone = K.cover(len(chunk.doc), at[drop], window)
        return _kept(chunk, gone)

    by = lambda df, key: df.groupBy(key)
    probes = by(pages.table, "chunk").applyInArrow(probe, X.PACKED)
    anchors = materialize(by(probes, "range").applyInArrow(match, X.ANSWER))
    windows = by(pages.table, "chunk").cogroup(by(anchors, "chunk")).applyInArrow(extend, X.PACKED)
    late = materialize(by(windows, "range").applyInArrow(earliest, X.CHECKED))
    return by(pages.table, "chunk").cogroup(by(late, "chunk")).applyInArrow(remove, result)


def _kept(chunk: _Chunk, gone: np.ndarray) -> pa.Table:
    removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[chunk.of])
    texts, done = [], 0
    for part, words in chunk.parts:
        stay = ~gone[done : done + len(words)]
        done += len(words)
        start, end, doc = words.start[stay], words.end[stay], words.doc[stay]
        last = np.ones(len(doc), bool)  # of its document: no space follows
        last[:-1] = doc[1:] != doc[:-1]
        edge = np.zeros(len(part.data) + 2, np.int8)
        edge[start] += 1
        edge[end + ~last] -= 1
        inside = np.cumsum(edge[:-2], dtype=np.int8).view(bool) if len(part.data) else np.zeros(0, bool)
        data = part.data.copy()
        data[end[~last]] = 0x20
        at = np.concatenate(([0], np.cumsum(inside)))[part.bounds]
        texts.append(pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[inside])))
    first, end = K.runs(gone)
    # a run may cross from a document to the next
    cuts = chunk.of[1:-1]
    edges = np.unique(np.concatenate((first, end, cuts[(cuts > 0) & (cuts < len(gone))]))) if len(gone) else first
    pieces = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if gone[a]]
    spans: list[list] = [[] for _ in range(len(chunk.ids))]
    for a, b in pieces:
        d = int(chunk.doc[a])
        spans[d].append({"first": a - int(chunk.of[d]), "end": b - int(chunk.of[d])})
    return pa.table(
        {
            "doc_id": chunk.table.column("doc_id"),
            "n_words": pa.array(np.diff(chunk.of), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.chunked_array(texts, pa.large_string()).cast(pa.string()),
            "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
        }
    )
