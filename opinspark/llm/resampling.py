"""Resampling a corpus towards a target distribution of hashed n-grams.

Documents and target texts become postings (bucket, document, count), packed by range of buckets. The ranges are
dealt out, and each cell (a range, and a share of the documents, so that no bucket's postings meet whole in one task)
gets its buckets' totals in both corpora, works out the gains on the spot and emits what each document gets from it; these
contributions are added up by document. A document's weight is the sum of the gains of its features, and the
sample without replacement takes the highest weights plus Gumbel noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import global_order, materialize

STEPS = 64  # word lengths, in bytes, that one table look-up advances a checksum by
MOST_DOCS = 1 << 16  # of a block: places are 16-bit


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32's byte table, and for each length to STEPS what that many zero bytes make of each byte of a register."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    state = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    rows = [state]
    for _ in range(STEPS):
        state = one[state & 255] ^ (state >> 8)
        rows.append(state)
    return one, np.stack(rows).reshape(-1)


def _advance(state: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Registers after ``length`` zero bytes each: by linearity, after a word it is that and the word's own register."""
    zeros = _tables()[1]
    at = np.minimum(length, STEPS).astype(np.int64) << 10
    out = zeros[at + (state & 255)]
    for byte in (1, 2, 3):
        out ^= zeros[at + 256 * byte + ((state >> np.uint32(8 * byte)) & 255)]
    rest = np.flatnonzero(length > STEPS)
    if len(rest):
        out[rest] = _advance(out[rest], length[rest] - STEPS)
    return out


def _registers(words: K.Words) -> np.ndarray:
    """Each word's register, begun at zero."""
    one, length = _tables()[0], words.end - words.start
    out = np.zeros(len(words), np.uint32)
    live = np.flatnonzero(length <= STEPS)
    for k in range(int(length[live].max(initial=0))):
        live = live[length[live] > k]
        state = out[live]
        out[live] = one[(state ^ words.data[words.start[live] + k]) & 255] ^ (state >> 8)
    for i in np.flatnonzero(length > STEPS):
        start = np.uint32(0xFFFFFFFF)
        whole = np.uint32(zlib.crc32(words.data[words.start[i] : words.end[i]].tobytes())) ^ start
        out[i] = whole ^ _advance(np.array([start]), length[i : i + 1])[0]
    return out


def feature_buckets(words: K.Words, sizes: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``sizes`` words of one text, joined by a space, and the text each comes from."""
    length, own = words.end - words.start, _registers(words)
    spaced = _advance(np.full(len(words), _tables()[0][32], np.uint32), length) ^ own
    state = _advance(np.full(len(words), 0xFFFFFFFF, np.uint32), length) ^ own
    found, docs = [], []
    for k in range(1, sizes + 1):
        at = words.windows(k)
        if k > 1:
            state = _advance(state[at if k == 2 else np.searchsorted(before, at)], length[at + k - 1] + 1) ^ spaced[at + k - 1]
        before = at
        found.append((~state if k > 1 else ~state[at]) % np.uint32(buckets))
        docs.append(words.doc[at])
    return np.concatenate(found), np.concatenate(docs)


POSTED = "block long, part int, place int, doc_id long, n_words long, n_features long, packed binary, totals array<long>"


def _packed(bucket: np.ndarray, place: np.ndarray, count: np.ndarray, low: int, width: int) -> bytes:
    """Postings sorted by bucket and place: sizes by bucket, steps between places and counts, each by bytes, compressed."""
    sizes = np.bincount(bucket - low, minlength=width).astype(np.uint32)
    first = np.append(True, bucket[1:] != bucket[:-1])
    step = np.where(first, place, np.diff(place, prepend=0)).astype(np.uint16)
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (sizes, step, count.astype(np.uint16))]
    return len(bucket).to_bytes(8, "little") + pa.Codec("zstd").compress(b"".join(planes), asbytes=True)


def _unpacked(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    data = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], 4 * width + 4 * n, asbytes=True), np.uint8)
    plane = lambda at, rows, kind: np.ascontiguousarray(data[at : at + rows * kind.itemsize].reshape(kind.itemsize, rows).T).view(kind).reshape(rows)
    sizes = plane(0, width, np.dtype(np.uint32)).astype(np.int64)
    step, count = plane(4 * width, n, np.dtype(np.uint16)), plane(4 * width + 2 * n, n, np.dtype(np.uint16))
    bucket = np.repeat(np.arange(width), sizes)
    run = np.cumsum(step.astype(np.int64))
    start = np.cumsum(sizes) - sizes  # steps begin anew with each bucket
    before = np.where(start > 0, run[np.maximum(start, 1) - 1], 0) if n else start
    return bucket, run - before[bucket], count


def postings(docs: DataFrame, sizes: int, buckets: int, parts: int, each: int = 1_500_000) -> DataFrame:
    """Rows of two kinds: one a document (``place`` in its ``block``), and one a block and range of buckets, with packed postings.

    ``docs`` has ``doc_id`` and ``text``; a block is closed at ``each`` features or MOST_DOCS documents.
    """
    width = -(-buckets // parts)
    kind = pa.schema(
        [("block", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64())]
        + [("packed", pa.binary()), ("totals", pa.list_(pa.int64()))]
    )

    def closed(block: int, keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        more = np.maximum(-(-count // 65535), 1)  # a count past 16 bits stands in several postings
        key, count = np.repeat(key, more), np.repeat(count, more)
        last = np.cumsum(more) - 1
        over = np.ones(len(key), bool)
        over[last] = False
        count[last] -= 65535 * (more - 1)
        count[over] = 65535
        bucket, place = (key >> 16).astype(np.int64), (key & 65535).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(parts + 1) * width)
        rows = []
        for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                sums = np.bincount(bucket[a:b] - part * width, weights=count[a:b], minlength=width).astype(np.int64)
                rows.append({"block": block, "part": part, "packed": _packed(bucket[a:b], place[a:b], count[a:b], part * width, width), "totals": sums.tolist()})
        yield from pa.Table.from_pylist(rows, schema=kind).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n, keys = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            for rows, texts in K.parts(batch, "text"):
                for at in range(0, len(texts), MOST_DOCS):  # texts without words may be many
                    rest = min(MOST_DOCS, len(texts) - at)
                    if held + rest > MOST_DOCS or n >= each:
                        if n:
                            yield from closed(block, keys)
                        block, held, n, keys = block + 1, 0, 0, []
                    some = texts if rest == len(texts) else K.Texts(rows.column("text").slice(at, rest))
                    words = K.Words(some, K.ALNUM, True)
                    bucket, doc = feature_buckets(words, sizes, buckets)
                    keys.append(bucket.astype(np.uint64) << np.uint64(16) | (doc + held).astype(np.uint64))
                    columns = {
                        "block": np.full(rest, block),
                        "part": np.full(rest, -1, np.int32),
                        "place": np.arange(held, held + rest, dtype=np.int32),
                        "doc_id": rows.column("doc_id").slice(at, rest),
                        "n_words": np.diff(words.of),
                        "n_features": np.bincount(doc, minlength=rest),
                        "packed": pa.nulls(rest, pa.binary()),
                        "totals": pa.nulls(rest, pa.list_(pa.int64())),
                    }
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind.field(c).type) if isinstance(x, np.ndarray) else x for c, x in columns.items()], schema=kind)
                    held, n = held + rest, n + len(bucket)
        if n:
            yield from closed(block, keys)

    return docs.mapInArrow(run, POSTED)


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    """A bucket's smoothed log ratio of target to corpus, in thousandths, rounded down."""
    return floor(1000 * log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets))))


def weights(
    docs: DataFrame, target: DataFrame, sizes: int = 3, buckets: int = 10_000, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", parts: int = 16, blocks: int = 64
) -> DataFrame:
    """``block, place, doc_id, n_words, n_features, weight``: one row per row of ``docs``; block and place tell rows apart.

    Words are lower-cased in A-Z alone. Null and wordless texts have no features and weight 0; repeated rows, and rows without an
    id, are rows of their own, all of them counted; an empty target counts 0 everywhere. Other columns are not looked at. A
    cell is a range of ``buckets / parts`` buckets and about ``blocks`` blocks of documents, whatever the sizes of the tables.
    """
    width = -(-buckets // parts)
    rows = materialize(postings(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), sizes, buckets, parts))
    aims = postings(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), sizes, buckets, parts)
    aims = materialize(aims.filter("part >= 0").select("part", "totals"))
    posted = rows.filter("part >= 0")
    summed = lambda x, name: x.select("part", F.posexplode("totals").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias(name))
    both = summed(posted, "s").join(summed(aims, "t"), ["part", "at"], "full").fillna(0, ["s", "t"])
    totals = materialize(both)  # at most one row a bucket
    everything = totals.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    all_s, all_t = everything["s"], everything["t"]
    salts = max(1, -(-posted.filter("part = 0").count() // blocks))
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt")
    known = totals.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "s", "t"))).alias("known"))  # width rows at most
    known = known.select("part", "known", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def cell(here: pa.Table, counts: pa.Table) -> pa.Table:
        gains = np.zeros(width)
        for row in counts.column("known").to_pylist():
            for x in row:
                gains[x["at"]] = gain(x["s"], x["t"], all_s, all_t, buckets)
        out = []
        for block, blob in zip(here.column("block").to_pylist(), here.column("packed").to_pylist(), strict=True):
            bucket, place, count = _unpacked(blob, width)
            # whole numbers far below 2**53: doubles hold them exactly
            part = np.bincount(place, weights=gains[bucket] * count)
            some = np.flatnonzero(np.bincount(place))
            out.append((np.full(len(some), block), some.astype(np.int32), part[some].astype(np.int64)))
        join = lambda i, kind: np.concatenate([x[i] for x in out]) if out else np.zeros(0, kind)
        return pa.table({"block": pa.array(join(0, np.int64), pa.int64()), "place": pa.array(join(1, np.int32), pa.int32()), "gained": pa.array(join(2, np.int64), pa.int64())})

    got = (
        posted.select("block", "part", salt, "packed")
        .groupBy("part", "salt")
        .cogroup(known.groupBy("part", "salt"))
        .applyInArrow(cell, "block long, place int, gained long")
    )
    none = F.lit(None).cast("long")
    own = rows.filter("part = -1").select("block", "place", "doc_id", "n_words", "n_features", F.lit(0).cast("long").alias("gained"))
    got = got.select("block", "place", none.alias("doc_id"), none.alias("n_words"), none.alias("n_features"), "gained")
    return own.unionByName(got).groupBy("block", "place").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("gained").alias("weight")
    )


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, **options) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs``; ``rank`` counts the drawn from 1, else null.

    The score is the weight and Gumbel noise from a hash of ``seed`` and the id, so that drawing the highest
    ``percent`` of the documents of at least ``least_words`` words samples without replacement, and reruns agree. Ties go to the smaller id,
    a null id last (its noise is that of an empty id), then by place. ``options`` are those of ``weights``.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weights(docs, target, **options).withColumn("score", (F.col("weight") + noise).cast("long")))
    able = scored.filter(F.col("n_words") >= least_words)
    draw = able.count() * percent // 100
    order = able.select("*", (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("nameless"))
    ranked = global_order(order, ["down", "nameless", "doc_id", "block", "place"], [])
    rank = F.when(F.col("row_index") < draw, F.col("row_index") + 1)
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.filter(~(F.col("n_words") >= least_words)).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, rank.cast("long").alias("rank")).unionByName(rest)
