"""Contiguous shards of near-equal bytes, by global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_order, materialize


def shard_by_bytes(
    docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = 8, more: list[Column] | None = None
) -> DataFrame:
    """``doc_id, size, text_crc32, text_hash, shard, slot``: one row per row of ``docs``.

    Rows are laid end to end in the order of (60 bits of the text's MD5, doc_id), so equal
    texts lie side by side and the order is as good as shuffled. A row belongs to the shard
    in whose n-th of all bytes its middle lies: shards are contiguous and differ from the
    mean by less than the rows at their two cuts. ``slot`` counts a shard's rows from 0.

    Sizes are summed up per range partition first, and only those totals meet in one
    place. A null text counts as empty (checksum 0); equal rows are told apart by
    place alone; without rows the result is empty. Other columns are not looked at, but for ``more``, which are added.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sized = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.md5(body.cast("binary")), 1, 15), 16, 10).cast("long").alias("text_hash"),
            F.monotonically_increasing_id().alias("_tie"),  # equal rows too can be told apart, so that a cut may fall between them
            *(more or []),
        )
    )
    extra = sized.columns[5:]
    laid = global_order(sized, ["text_hash", "doc_id", "_tie"], ["size"])
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # the row's middle in n-ths of the total, doubled: whole numbers all the way
    shard = F.least(F.expr(f"(2 * size_before + size) * {int(shards)}L div {max(2 * total, 1)}L"), F.lit(shards - 1))
    placed = materialize(laid.withColumn("shard", shard.cast("int")))
    starts = placed.groupBy("shard").agg(F.min("row_index").alias("_start"))  # one row a shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "text_hash", "shard", (F.col("row_index") - F.col("_start")).alias("slot"), *extra
    )


def sharded(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``doc`` (a struct of all columns of a row), ``size``, ``shard`` and ``slot`` as in ``shard_by_bytes``, for every row of ``docs``.

    Rows are told apart by file and place there, so that equal rows get a slot each and texts needn't be sorted; what isn't read from
    files is written first. The placement (40 bytes a row) is broadcast up to ``broadcast_rows``, else joined by a shuffle.
    """
    where = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = docs.select(F.struct("*").alias("doc"))
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("a column of that name hides the files' own")
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *where)
        rows.schema  # noqa: B018  fails here if the rows aren't a file's
    except AnalysisException:
        rows = materialize(rows).select("doc", *where)
    keys = rows.select(F.col(f"doc.{doc_id}").alias(doc_id), F.col(f"doc.{text}").alias(text), "_file", "_row")
    placed = shard_by_bytes(keys, shards, doc_id, text, more=[F.col("_file"), F.col("_row")])
    placed = materialize(placed.select("size", "shard", "slot", "_file", "_row"))
    placed = F.broadcast(placed) if placed.count() <= broadcast_rows else placed
    return rows.join(placed, ["_file", "_row"]).select("doc", "size", "shard", "slot")
