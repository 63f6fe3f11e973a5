"""Finding keys that documents share, without a row per key.

Documents are written once as chunks (a table bucketed by a hash of id and text, in the shared
folder; rows without an id, or of one id, part by their texts), so later passes read a chunk's documents without shuffling texts again. For a pass, a chunk sends
its distinct keys, sorted and packed, to the key range's task; a common key costs one entry a chunk,
however many documents hold it. The task answers each chunk with the keys that matter to it.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _remove, shared_dir

NONE = np.iinfo(np.int64).max  # stands for a null id: larger than all others


class Pages:
    """Documents (doc_id, text) by chunk, and how many key ranges suit them."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, small: int = 2 << 20, large: int = 32 << 20, most_small: int = 512, describe: tuple | None = None):
        spark = docs.sparkSession
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.chunks = max(1, min(-(-self.bytes // small), most_small), -(-self.bytes // large))
        name, path = f"opinspark_{uuid.uuid4().hex}", f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
        files = min(self.chunks, 10_000)
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.chunks)).cast("int"))
        if describe:  # columns worth computing once, before the documents are dealt out
            rows = rows.mapInArrow(*describe)
        (
            rows.repartition(files, "chunk")
            .write.option("path", path)
            .option("compression", "zstd")
            .bucketBy(files, "chunk")
            .saveAsTable(name, format="parquet")
        )
        atexit.register(_drop, spark, name, path)
        self.table = spark.table(name)

    def ranges(self, keys: float, each: int = 400_000) -> int:
        """Bits of a key that name its range, for about ``keys`` keys in all."""
        return max(5, int(np.ceil(np.log2(max(keys / each, 1)))))


def _drop(spark: SparkSession, name: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session may be gone
        pass
    _remove(spark, path)


PACKED = "range int, chunk int, keys binary, flags binary, ids binary, checks binary"


def pack(
    chunk: int, bits: int, keys: np.ndarray, width: int, flags: np.ndarray | None = None, ids: np.ndarray | None = None, checks: np.ndarray | None = None
) -> pa.Table:
    """Rows of a chunk's sorted distinct keys by range. ``width`` is the bytes kept of a key, after its range bits.

    ``checks`` are second, independent hashes: with them keys may repeat and are sent whole, so that 128 bits tell them apart.
    """
    key_range = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(key_range, prepend=-1)), len(keys))
    rest = keys if checks is not None else (keys << np.uint64(bits)) >> np.uint64(64 - 8 * width)
    rest = rest.astype(np.uint32 if width == 4 else np.uint64)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    blob = lambda x: pa.array([None] * len(spans) if x is None else [x[a:b].tobytes() for a, b in spans], pa.binary())
    return pa.table(
        {
            "range": pa.array(key_range[edges[:-1]], pa.int32()),
            "chunk": pa.array([chunk] * len(spans), pa.int32()),
            "keys": blob(rest),
            "flags": blob(flags),
            "ids": blob(ids),
            "checks": blob(checks),
        }
    )


def unpack(table: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """Keys, flags, ids (the last two empty where none were packed) and the row of each key."""
    kind = np.uint32 if width == 4 else np.uint64
    join = lambda c, t: np.frombuffer(b"".join(x or b"" for x in table.column(c).to_pylist()), t)
    sizes = [len(x) // width for x in table.column("keys").to_pylist()]
    return join("keys", kind), join("flags", np.uint8), join("ids", np.int64), np.repeat(np.arange(len(sizes)), sizes)


ANSWER = "chunk int, range int, keys binary"


def answer(table: pa.Table, keys: np.ndarray, row: np.ndarray, keep: np.ndarray) -> pa.Table:
    """The kept keys of each row, for its chunk."""
    keys, row = keys[keep], row[keep]
    chunk = table.column("chunk").to_pylist()
    key_range = table.column("range").to_pylist()
    edges = np.searchsorted(row, np.arange(len(chunk) + 1))
    some = [i for i in range(len(chunk)) if edges[i + 1] > edges[i]]
    return pa.table(
        {
            "chunk": pa.array([chunk[i] for i in some], pa.int32()),
            "range": pa.array([key_range[i] for i in some], pa.int32()),
            "keys": pa.array([keys[edges[i] : edges[i + 1]].tobytes() for i in some], pa.binary()),
        }
    )


def truncated(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """A key as far as it is sent: its range and ``width`` bytes."""
    drop = np.uint64(max(0, 64 - bits - 8 * width))
    return keys >> drop << drop


def answered(table: pa.Table, bits: int, width: int) -> np.ndarray:
    """Sorted truncated keys of all answers to a chunk."""
    kind = np.uint32 if width == 4 else np.uint64
    parts = [
        (np.frombuffer(k, kind).astype(np.uint64) << np.uint64(64 - 8 * width) >> np.uint64(bits)) | (np.uint64(r) << np.uint64(64 - bits))
        for r, k in zip(table.column("range").to_pylist(), table.column("keys").to_pylist(), strict=True)
    ]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


CHECKED = "chunk int, keys binary, checks binary, ids binary"


def checked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole 64-bit keys, checks, ids and the row of each, of rows that were packed with checks."""
    join = lambda c, t: np.frombuffer(b"".join(x or b"" for x in table.column(c).to_pylist()), t)
    sizes = [len(x) // 8 for x in table.column("keys").to_pylist()]
    return join("keys", np.uint64), join("checks", np.uint64), join("ids", np.int64), np.repeat(np.arange(len(sizes)), sizes)


def among(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


def among_pairs(table: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which (key, check) pairs are rows of ``table``: 128 bits are compared, whatever rows share a key."""
    out = np.zeros(len(keys), bool)
    if not len(table):
        return out
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    at, end = np.searchsorted(table[:, 0], keys, "left"), np.searchsorted(table[:, 0], keys, "right")
    for k in range(int((end - at).max(initial=0))):  # one, but for keys that several checks share
        some = at + k < end
        out[some] |= table[at[some] + k, 1] == checks[some]
    return out


def ids_of(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("doc_id").combine_chunks().fill_null(NONE)).astype(np.int64)
