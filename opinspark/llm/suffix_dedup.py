"""Exact repeated-substring removal with suffix arrays built by difference covers, distributed by fingerprint.

A 200-byte string is named by its fingerprint, the smallest of its 101 hashed 100-grams (the last of equals): equal
strings have equal fingerprints at equal offsets. So the suffixes to sort can be dealt out to tasks by
fingerprint, and no pair of equal strings is ever parted. A fingerprint that stands at one place only can't be part of a repeat, and
its suffixes are left out. What is left are *pieces*: the strings around one fingerprint's place, about 250
bytes. Equal pieces are merged and counted first; pieces that differ, but share a fingerprint, go to the fingerprint's task.

The task concatenates its pieces and sorts their suffixes: triples at places 1 and 2 modulo 3 are sorted and
named, the string of names is sorted by recursion (until names tell all suffixes apart, or span more than 200 bytes), the
remaining suffixes are sorted by first symbol and rank of the next, and merged in. Then adjacent suffixes are compared over 200 bytes.

A fingerprint inside a passage that very many texts share has a different piece in each of them, wherever the passage ends. From
``hot_pieces`` on, such pieces aren't brought together: each chunk sends two hashes of their strings, dealt out by the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .common import materialize

PART = 1 << 20


def _named(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of tuples of small whole numbers, in order, from 1; and how many there are."""
    bits = [max(1, int(c.max()).bit_length()) for c in columns]
    if sum(bits) <= 63:
        key = columns[0].astype(np.int64)
        for c, b in zip(columns[1:], bits[1:], strict=True):
            key = (key << b) | c
        names, rank = np.unique(key, return_inverse=True)
        return rank + 1, len(names)
    first, _ = _named(*columns[:2])
    return _named(first, *columns[2:])


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix of ``s`` (whole numbers above 0) by its first 3**depth symbols at least, by difference cover modulo 3.

    Suffixes that agree further may get equal ranks; otherwise ranks are in lexicographic order (an end comes first).
    """
    n = len(s)
    if n < 3 or depth == 0:
        padded = np.concatenate((s, np.zeros(3, s.dtype)))
        return _named(*[padded[k : k + n] for k in range(3)])[0] if n else s
    s = s.astype(np.int64)
    t = np.concatenate((s, np.zeros(4, np.int64)))
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    names, many = _named(t[sample], t[sample + 1], t[sample + 2])
    if many < len(sample) and depth > 1:
        # a zero between the halves keeps suffixes of the first from running into the second
        inner = suffix_ranks(np.concatenate((names[: len(one)], [0], names[len(one) :])) + 1, depth - 1)
        names, _ = _named(np.concatenate((inner[: len(one)], inner[len(one) + 1 :])))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    zero = np.arange(0, n, 3)
    top = int(names.max()) + 1
    wide = int(t.max()) + 1
    # suffixes 0 and 1 modulo 3 compare by (symbol, rank of the next); 0 and 2 by (two symbols, rank of the one after)
    if wide * wide * top < 2**63:
        a = lambda i: t[i] * top + rank[i + 1]
        b = lambda i: (t[i] * wide + t[i + 1]) * top + rank[i + 2]
        a0, a1, b0, b2 = a(zero), a(one), b(zero), b(two)
    else:
        both, _ = _named(t[np.concatenate((zero, one))], rank[np.concatenate((zero, one)) + 1])
        a0, a1 = both[: len(zero)], both[len(zero) :]
        i = np.concatenate((zero, two))
        both, _ = _named(t[i], t[i + 1], rank[i + 2])
        b0, b2 = both[: len(zero)], both[len(zero) :]
    order = np.argsort(a0, kind="stable")
    a0, b0 = a0[order], b0[order]
    # merge: a remaining suffix comes after all sampled ones that are less, of either kind
    s1, s2 = np.sort(a1), np.sort(b2)
    before = np.searchsorted(s1, a0) + np.searchsorted(s2, b0)
    # sampled suffixes, in order; equal ranks stay equal
    by_name = np.argsort(names, kind="stable")
    key = np.empty(n, np.int64)
    level = names[by_name]
    starts = np.searchsorted(level, level)  # sampled suffixes that are less
    key[sample[by_name]] = 2 * starts
    equal = (np.searchsorted(s1, a0, "right") > np.searchsorted(s1, a0)) | (np.searchsorted(s2, b0, "right") > np.searchsorted(s2, b0))
    key[zero[order]] = 2 * before - np.where(equal, 0, 1)
    # remaining suffixes between the same sampled ones keep their own order
    tie = np.zeros(n, np.int64)
    tie[zero[order]] = np.where(equal, 0, np.searchsorted(a0, a0) + 1)
    return _named(key + 1, tie)[0]


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece a mask of its places where a string of ``length`` starts that also starts in another piece."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes)))
    depth, span = 1, 3
    while span < length + 3:
        depth, span = depth + 1, span * 3
    rank = suffix_ranks(text.astype(np.int64) + 1, depth)
    counts = np.maximum(sizes - length + 1, 0)
    starts = np.repeat(first[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    ordered = starts[np.argsort(rank[starts], kind="stable")]
    hit = np.zeros(len(text) + 1, bool)
    view = np.lib.stride_tricks.sliding_window_view(text, length) if len(text) >= length else None
    for at in range(0, len(ordered) - 1, 16_384):
        a, b = ordered[at : at + 16_384], ordered[at + 1 : at + 16_385]
        a = a[: len(b)]
        same = (view[a] == view[b]).all(1)
        hit[a[same]] = hit[b[same]] = True
    return [hit[f : f + c] for f, c in zip(first[:-1].tolist(), counts.tolist(), strict=True)]


def fingerprints(texts: K.Texts, length: int) -> tuple[np.ndarray, ...]:
    """Fingerprint places of all strings of ``length`` bytes: text, place, first and last start it is for, and hash.

    Places and starts are relative to the text.
    """
    gram = length // 2
    width = length - gram + 1
    n = len(texts.data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    hashes = K.rolling(K.BYTE[0][texts.data], gram, K.BASE[0])
    places = np.arange(len(hashes), dtype=np.uint64)
    low = (hashes >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - places)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    ends = np.repeat(texts.bounds[1:], np.diff(texts.bounds))[:n]
    whole = np.arange(n) + length <= ends
    place = np.where(whole, (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64), -1)
    edge = np.flatnonzero(np.diff(place, prepend=-2))
    last = np.append(edge[1:], n) - 1
    keep = place[edge] >= 0
    edge, last = edge[keep], last[keep]
    place = place[edge]
    doc = np.searchsorted(texts.bounds, edge, "right") - 1
    origin = texts.bounds[doc]
    # least hashes are small: mixed once more, they fill all ranges alike
    return doc, place - origin, edge - origin, last - origin, K.mix(hashes[place])


def _describe(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in K.parts(batch, "text"):
                doc, _, first, last, hashes = fingerprints(texts, length)
                of = np.searchsorted(doc, np.arange(len(texts) + 1))
                cut = lambda x, t: pa.array([x[a:b].astype(t).tobytes() for a, b in zip(of[:-1], of[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), part.column("chunk"), cut(hashes, np.uint64), cut(first, np.uint32), cut(last, np.uint32)],
                    names=["doc_id", "text", "chunk", "prints", "first", "last"],
                )

    return run


REPEATED, SEND, HOT = 1, 2, 4


class _Pieces:
    """A chunk's pieces whose fingerprints are shared."""

    def __init__(self, table: pa.Table, shared: np.ndarray, length: int):
        self.length = length
        join = lambda c, t: np.frombuffer(b"".join(x or b"" for x in table.column(c).to_pylist()), t)
        self.prints, self.first, self.last = join("prints", np.uint64), join("first", np.uint32).astype(np.int64), join("last", np.uint32).astype(np.int64)
        sizes = np.array([len(x or b"") // 8 for x in table.column("prints").to_pylist()], np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        keep = X.among(shared, self.prints)
        self.prints, self.first, self.last, self.doc = (x[keep] for x in (self.prints, self.first, self.last, self.doc))
        self.texts = table.column("text").combine_chunks().cast(pa.large_binary()).fill_null(b"")

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces in the chunk's bytes."""
        offsets = np.frombuffer(self.texts.buffers()[1], np.int64, len(self.texts) + 1, self.texts.offset * 8)
        at = offsets[self.doc]
        return at + self.first, at + self.last + self.length

    def data(self) -> np.ndarray:
        buffer = self.texts.buffers()[2]
        return np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)

    def contents(self) -> np.ndarray:
        """64-bit hashes of the pieces, with their fingerprints in them."""
        out = np.zeros(len(self.doc), np.uint64)
        start, end = self.bounds()
        data = self.data()
        at = 0
        while at < len(start):  # a few megabytes of text at a time
            to = max(at + 1, int(np.searchsorted(start, start[at] + PART)))
            base, stop = start[at], end[at:to].max()
            sums = K.prefix(K.BYTE[1][data[base:stop]], K.BASE[1])
            out[at:to] = K.spans(sums, start[at:to] - base, end[at:to] - base, K.BASE[1])
            at = to
        return K.mix(out ^ self.prints)

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Starts, in the chunk's bytes, of all strings of the pieces ``at`` (ascending), and two hashes of each."""
        start, end = (x[at] for x in self.bounds())
        counts = end - start - self.length + 1
        begin = np.repeat(start - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        data, hashes = self.data(), [np.zeros(len(begin), np.uint64) for _ in range(2)]
        k = 0
        while k < len(begin):  # pieces have their strings apart, so starts ascend
            to = max(k + 1, int(np.searchsorted(begin, begin[k] + PART)))
            first = begin[k:to] - begin[k]
            for which, out in enumerate(hashes):
                sums = K.prefix(K.BYTE[which][data[begin[k] : begin[to - 1] + self.length]], K.BASE[which])
                out[k:to] = K.spans(sums, first, first + self.length, K.BASE[which])
            k = to
        return begin, hashes


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, hot_pieces: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept``: one row per row of ``docs``.

    ``spans`` are the maximal runs (first byte, end exclusive) of bytes covered by a string of ``length`` bytes that also
    starts elsewhere, in the same or any other text; ``kept`` is the rest of the UTF-8 text. Strings don't cross texts. Null texts are
    empty; repeated rows repeat each other, so that long ones vanish altogether. Other columns are not looked at.

    Pieces are told apart by 64-bit hashes, strings inside tasks byte by byte, those of fingerprints with more than ``hot_pieces``
    different pieces by two 64-bit hashes.
    """
    if length < 16:
        raise ValueError("length must be 16 bytes at least")
    pages = X.Pages(docs, doc_id, text, describe=(_describe(length), "doc_id long, text string, chunk int, prints binary, first binary, last binary"))
    bits = pages.ranges(pages.bytes / (length // 4))
    # a piece takes about five times the bytes it stands for: tasks sort 2 MB at most, if all is shared
    sort_bits = pages.ranges(5 * pages.bytes, 2 << 20)
    string_bits = pages.ranges(pages.bytes / 8)
    by = lambda df, key: df.groupBy(key)
    chunk_of = lambda t: t.column("chunk")[0].as_py() if len(t) else 0

    def send_prints(table: pa.Table) -> pa.Table:
        prints = np.sort(np.frombuffer(b"".join(x or b"" for x in table.column("prints").to_pylist()), np.uint64))
        edge = np.ones(len(prints), bool)
        edge[1:] = prints[1:] != prints[:-1]
        at = np.flatnonzero(edge)
        many = (np.diff(np.append(at, len(prints))) > 1).astype(np.uint8)
        return X.pack(chunk_of(table), bits, prints[at], 8, many)

    def shared_prints(table: pa.Table) -> pa.Table:
        keys, flags, _, row = X.unpack(table, 8)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        edge = np.ones(len(keys), bool)
        edge[1:] = ordered[1:] != ordered[:-1]
        begin = np.flatnonzero(edge)
        size = np.diff(np.append(begin, len(keys)))
        hit = (size > 1) | (np.maximum.reduceat(flags[order], begin) > 0)
        keep = np.zeros(len(keys), bool)
        keep[order] = np.repeat(hit, size)
        return X.answer(table, keys, row, keep)

    def send_contents(table: pa.Table, shared: pa.Table) -> pa.Table:
        own = _Pieces(table, X.answered(shared, bits, 8), length)
        contents = own.contents()
        pairs, counts = np.unique(np.rec.fromarrays([own.prints, contents], names="p,c"), return_counts=True)
        return X.pack(chunk_of(table), bits, np.asarray(pairs.p), 8, (counts > 1).astype(np.uint8), np.asarray(pairs.c).view(np.int64))

    states = "chunk int, contents binary, states binary"
    sent_columns = ["range", "chunk", "contents", "sizes", "texts", "keys", "flags", "checks"]

    def judge(table: pa.Table) -> pa.Table:
        keys, flags, ids, row = X.unpack(table, 8)
        order = np.lexsort((row, ids, keys))
        k, c = keys[order], ids[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(k)))
        twice = (size > 1) | (np.maximum.reduceat(flags[order], begin) > 0)
        kb = k[begin]
        alone = np.ones(len(kb), bool)  # the fingerprint's only content
        alone[1:] &= kb[1:] != kb[:-1]
        alone[:-1] &= kb[:-1] != kb[1:]
        # a sole content can't differ from another; else its first holder sends it
        state = np.zeros(len(k), np.uint8)
        state[np.repeat(twice, size)] |= REPEATED
        edge = np.flatnonzero(np.diff(kb, prepend=~kb[:1]) != 0)
        many = np.diff(np.append(edge, len(kb)))
        hot = np.repeat(many > hot_pieces, many) & ~alone
        state[begin[~alone & ~hot]] |= SEND
        state[begin[hot]] |= HOT
        back = np.empty(len(k), np.uint8)
        back[order] = state
        chunk = np.array(table.column("chunk").to_pylist())
        edges = np.searchsorted(row, np.arange(len(chunk) + 1))
        out = []
        for i in range(len(chunk)):
            mine = slice(edges[i], edges[i + 1])
            some = back[mine] > 0
            if some.any():
                out.append((int(chunk[i]), ids[mine][some].tobytes(), back[mine][some].tobytes()))
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "contents", "states"])

    def of(table: pa.Table, values: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted content hashes of the answers to a chunk, and their values."""
        c = np.frombuffer(b"".join(table.column("contents").to_pylist()), np.uint64)
        v = np.frombuffer(b"".join(table.column(values).to_pylist()), np.uint8)
        order = np.argsort(c)
        return c[order], v[order]

    def send_pieces(table: pa.Table, judged: pa.Table) -> pa.Table:
        contents, state = of(judged, "states")
        sent = contents[state & SEND > 0]
        own = _Pieces(table, _prints_of(table), length)
        hashes = own.contents()
        at = np.flatnonzero(X.among(sent, hashes))
        _, one = np.unique(hashes[at], return_index=True)
        at = at[one]
        start, end = own.bounds()
        at = at[np.argsort(own.prints[at], kind="stable")]
        key_range = (own.prints[at] >> np.uint64(64 - sort_bits)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(key_range, prepend=-1)), len(at))
        data, rows = own.data(), []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            texts = b"".join(data[start[i] : end[i]].tobytes() for i in at[a:b].tolist())
            rows.append((int(key_range[a]), chunk_of(table), hashes[at[a:b]].tobytes(), (end - start)[at[a:b]].astype(np.uint16 if length < 10_000 else np.uint32).tobytes(), texts))
        columns = zip(*rows, strict=True) if rows else ([], [], [], [], [])
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        pieces = pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["range", "chunk", "contents", "sizes", "texts"])
        return pa.concat_tables([pieces, send_strings(chunk_of(table), own, hashes, contents[state & HOT > 0])], promote_options="default").select(sent_columns)

    def send_strings(chunk: int, own: _Pieces, hashes: np.ndarray, hot: np.ndarray) -> pa.Table:
        at = np.flatnonzero(X.among(hot, hashes))
        _, one = np.unique(hashes[at], return_index=True)
        _, (key, check) = own.strings(np.sort(at[one]))
        pairs, counts = np.unique(np.rec.fromarrays([key, check], names="k,c"), return_counts=True)
        out = X.pack(chunk, string_bits, np.asarray(pairs.k), 8, (counts > 1).astype(np.uint8), None, np.asarray(pairs.c))
        # ranges of strings come behind those of pieces
        return out.set_column(0, "range", pc.add(out.column("range"), pa.scalar(1 << sort_bits, pa.int32())))

    def judge_strings(table: pa.Table) -> pa.Table:
        key, check, _, row = X.checked(table.append_column("ids", pa.nulls(len(table), pa.binary())))
        flags = np.frombuffer(b"".join(table.column("flags").to_pylist()), np.uint8)
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(k)))
        keep = np.zeros(len(k), bool)
        keep[order] = np.repeat((size > 1) | (np.maximum.reduceat(flags[order], begin) > 0), size)
        found = X.answer(table, np.stack([key, check], axis=1), row, keep)  # both hashes come back
        none = pa.nulls(len(found), pa.binary())
        return pa.table({"chunk": found.column("chunk"), "contents": none, "masks": none, "strings": found.column("keys")})

    def sort_suffixes(table: pa.Table) -> pa.Table:
        if table.column("keys")[0].is_valid:
            return judge_strings(table)
        pieces, counts = [], []
        for texts, sizes in zip(table.column("texts").to_pylist(), table.column("sizes").to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(sizes, np.uint16 if length < 10_000 else np.uint32).astype(np.int64))
            pieces += [texts[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
            counts.append(len(ends))
        masks = [np.packbits(m).tobytes() for m in repeated(pieces, length)]
        wide = -(-(length - length // 2 + 1) // 8)
        bits_of = [m.ljust(wide, b"\0") for m in masks]
        joined, at = [], 0
        for n in counts:
            joined.append(b"".join(bits_of[at : at + n]))
            at += n
        return pa.table({"chunk": table.column("chunk"), "contents": table.column("contents"), "masks": pa.array(joined, pa.binary()), "strings": pa.nulls(len(table), pa.binary())})

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<first:long,end:long>>, kept binary"

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        by_state = found.filter(pc.is_valid(found.column("states")))
        by_mask = found.filter(pc.is_valid(found.column("masks")))
        contents, state = of(by_state, "states")
        whole = contents[state & REPEATED > 0]
        own = _Pieces(table, _prints_of(table), length)
        hashes = own.contents()
        start, end = own.bounds()
        data = own.data()
        edge = np.zeros(len(data) + 1, np.int64)
        full = X.among(whole, hashes)
        np.add.at(edge, start[full], 1)
        np.add.at(edge, end[full], -1)
        wide = -(-(length - length // 2 + 1) // 8)
        c = np.frombuffer(b"".join(by_mask.column("contents").to_pylist()), np.uint64)
        bits_of = np.frombuffer(b"".join(by_mask.column("masks").to_pylist()), np.uint8).reshape(-1, wide)
        order = np.argsort(c)
        c, bits_of = c[order], bits_of[order]
        part = np.flatnonzero(X.among(c, hashes) & ~full)
        if len(part):
            places = np.unpackbits(bits_of[np.searchsorted(c, hashes[part])], axis=1)
            piece, offset = np.nonzero(places)
            at = start[part][piece] + offset
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        repeats = np.frombuffer(b"".join(x or b"" for x in found.column("strings").to_pylist()), np.uint64).reshape(-1, 2)
        begin, (key, check) = own.strings(np.flatnonzero(X.among(contents[state & HOT > 0], hashes) & ~full))
        at = begin[X.among_pairs(repeats, key, check)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        return _cut(table, own, np.cumsum(edge[:-1]) > 0, data)

    prints = by(pages.table.select("chunk", "prints"), "chunk").applyInArrow(send_prints, X.PACKED)
    shared = materialize(by(prints, "range").applyInArrow(shared_prints, X.ANSWER))
    contents = by(pages.table.drop("doc_id"), "chunk").cogroup(by(shared, "chunk")).applyInArrow(send_contents, X.PACKED)
    judged = materialize(by(contents, "range").applyInArrow(judge, states))
    pieces = by(pages.table.drop("doc_id"), "chunk").cogroup(by(judged, "chunk")).applyInArrow(send_pieces, ", ".join(f"{c} {'int' if c in ('range', 'chunk') else 'binary'}" for c in sent_columns))
    masks = materialize(by(pieces, "range").applyInArrow(sort_suffixes, "chunk int, contents binary, masks binary, strings binary"))
    none = F.lit(None).cast("binary")
    found = judged.withColumns({"masks": none, "strings": none}).unionByName(masks.withColumn("states", none))
    found = found.select("chunk", "contents", "states", "masks", "strings")
    return by(pages.table, "chunk").cogroup(by(found, "chunk")).applyInArrow(remove, result)


def _prints_of(table: pa.Table) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(x or b"" for x in table.column("prints").to_pylist()), np.uint64))


def _cut(table: pa.Table, own: _Pieces, gone: np.ndarray, data: np.ndarray) -> pa.Table:
    n = len(own.texts)
    offsets = np.frombuffer(own.texts.buffers()[1], np.int64, n + 1, own.texts.offset * 8)
    sums = np.concatenate(([0], np.cumsum(gone)))
    removed = sums[offsets[1:]] - sums[offsets[:-1]]
    kept, spans = [], []
    for d in range(n):
        a, b = int(offsets[d]), int(offsets[d + 1])
        mask = gone[a:b]
        kept.append(data[a:b][~mask].tobytes() if removed[d] else data[a:b].tobytes())
        spans.append([{"first": x, "end": y} for x, y in zip(*(v.tolist() for v in K.runs(mask)), strict=True)] if removed[d] else [])
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array([len(s) for s in spans], pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()),
        }
    )
