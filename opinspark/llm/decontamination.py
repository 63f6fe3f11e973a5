"""Benchmark decontamination by winnowing.

Every word 5-gram of a text is hashed; of each 6 consecutive hashes the smallest
(the last of equals) is kept as a fingerprint. Two texts that share 10 words in a
row share all six hashes in between, so they share a fingerprint: no shared span
of ``window`` words is missed. Both sides' fingerprints become rows, with the windows that they stand for; the rows are joined
on the fingerprint, and a hit is extended by comparing the window around it by two more independent 64-bit hashes.

Of the documents' rows only those leave a task whose fingerprint a filter of bounded size lets pass, so that
texts never move and hardly any rows do. Items with fewer words than a window are windows as they are, looked up by rolling windows of
exactly their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

GRAM = 5
PRINTS = "key string, start long, length int, print long, a long, b long"


def winnow(grams: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each place of ``first`` that of the smallest of ``width`` hashes from there on."""
    best, place = grams[first], first.copy()
    for j in range(1, width):
        here = grams[first + j]
        less = here <= best
        best, place = np.where(less, here, best), np.where(less, first + j, place)
    return place


class Filter:
    """A set of bits by hash: what was put in is found, few others are."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # 64 in a word
        self.words = np.uint64(len(bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        word = self.bits[((hashes >> np.uint64(6)) & self.words).astype(np.int64)]
        return (word >> (hashes & np.uint64(63))) & np.uint64(1) > 0


def _prints(window: int, lengths: list[int], passing, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``PRINTS`` of (key, text): windows with their fingerprints.

    Of an item (``whole``) of fewer words than a window its only one; of a document those of ``lengths`` and ``window`` that pass the filter.
    """

    def rows(words: K.Words, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = words.windows(length)
        if whole and length < window:
            at = at[np.diff(words.of)[words.doc[at]] == length]
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if length == window:
            grams = K.rolling(first, GRAM, K.BASE[2])
            found = grams[winnow(grams, at, window - GRAM + 1)]
        else:
            found = K.rolling(first, length, K.BASE[2])[at]
        if passing is not None:
            pass_ = passing.value.has(found)
            at, found = at[pass_], found[pass_]
        return at, found, K.rolling(first, length, K.BASE[2])[at] if len(at) else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in K.parts(batch, "text"):
                words = K.Words(texts, K.ALNUM, True)
                if not len(words):
                    continue
                first, second, key = words.hashes(0), None, part.column("key")
                counts = np.diff(words.of)
                for length in [*(np.unique(counts[(counts > 0) & (counts < window)]).tolist() if whole else lengths), window]:
                    at, found, a = rows(words, first, length)
                    if not len(at):
                        continue
                    second = words.hashes(1) if second is None else second
                    b = K.rolling(second, length, K.BASE[3])[at]
                    doc = words.doc[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            key.take(pa.array(doc)),
                            pa.array(at - words.of[doc], pa.int64()),
                            pa.array(np.full(len(at), length), pa.int32()),
                            *[pa.array(x.view(np.int64)) for x in (found, a, b)],
                        ],
                        names=["key", "start", "length", "print", "a", "b"],
                    )

    return run


def _filter(prints: DataFrame, most_words: int) -> Filter:
    """The filter of the distinct ``print`` values: 16 bits a value, ``most_words`` words of 64 bits at most."""
    count = prints.agg(F.approx_count_distinct("print")).first()[0]
    words = min(most_words, 1 << max(6, (count // 4).bit_length()))
    word = F.shiftrightunsigned("print", 6).bitwiseAND(F.lit(words - 1))
    bit = F.expr("shiftleft(1L, int(print & 63))")
    found = prints.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # ``words`` rows at most
    bits = np.zeros(words, np.uint64)
    bits[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).view(np.uint64)
    return Filter(bits)


def text_key(text: Column) -> Column:
    """Texts are told apart by 128 bits."""
    return F.md5(text.cast("binary"))


def hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, filter_words: int = 1 << 20
) -> DataFrame:
    """``key`` (see ``text_key``), ``n_hit``, ``items`` and ``spans`` of each distinct text with a window of the benchmark."""
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} words at least")
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("key"), F.col(item_text).alias("text"))
    known = materialize(items.mapInArrow(_prints(window, [], None, True), PRINTS).drop("start").withColumnRenamed("key", "item").distinct())
    lengths = sorted(r.length for r in known.select("length").distinct().filter(F.col("length") < window).collect())  # fewer than ``window``
    passing = spark.sparkContext.broadcast(_filter(known, filter_words))
    texts = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text")).filter("key is not null")
    rows = texts.mapInArrow(_prints(window, lengths, passing, False), PRINTS)
    on = ["length", "print", "a", "b"]
    # equal texts have equal rows: one of each stays
    rows = materialize(rows.join(known.select(*on).distinct(), on, "left_semi").dropDuplicates(["key", "start", "length"]))
    passing.unpersist()
    # windows to maximal runs; a partition is the windows of one text
    in_order = Window.partitionBy("key").orderBy("start", "length")
    runs = rows.select("key", "start", "length", (F.col("start") + F.col("length")).alias("end"))
    runs = runs.withColumn("_reach", F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("_run", F.sum(F.when(F.col("start") <= F.col("_reach"), 0).otherwise(1)).over(in_order))
    runs = runs.groupBy("key", "_run").agg(F.min("start").alias("first"), F.max("end").alias("end"))
    runs = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"), F.sum(F.col("end") - F.col("first")).alias("n_hit"))
    named = rows.select("key", *on).distinct().join(known, on).select("key", "item").distinct()
    named = named.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return materialize(runs.join(named, "key").select("key", "n_hit", "items", "spans"))


def words_in(text: Column) -> Column:
    """Number of words of a text, 0 for null. Only the texts go to Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts = [np.diff(K.Words(K.Texts(batch.slice(at, to - at)), K.ALNUM, True).of) for at, to in K.slices(batch)]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())

    return F.arrow_udf(run, "long")(text)


def _small(found: DataFrame, most_bytes: int) -> DataFrame:
    """``found``, to be broadcast where it's ``most_bytes`` or less."""
    listed = F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8) if "items" in found.columns else F.lit(0)
    spans = 16 * F.size("spans") if "spans" in found.columns else F.lit(0)
    size = found.agg(F.sum(80 + listed + spans)).first()[0] or 0
    return F.broadcast(found) if size <= most_bytes else found


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    broadcast_bytes: int = 64 << 20,
    filter_words: int = 1 << 20,
) -> DataFrame:
    """One row per document row: ``doc`` (a struct of all its columns), ``n_words``, ``n_hit``,
    ``items`` (sorted ids, as strings, of the items with a window in the text) and
    ``spans`` (maximal runs of hit words: first word, end exclusive).

    Fingerprints are joined as rows; of the benchmark the driver and the tasks see a filter of ``filter_words`` 64-bit words at most
    and nothing else. What hit texts have goes back to the documents by a key of the text: broadcast if it's ``broadcast_bytes`` or less,
    else by a shuffle of the documents. Null texts have no words; null item texts have no windows; a null item id
    is named by the empty string, and items of one id are one. Repeated rows are judged one by one, an empty
    benchmark hits nothing. The documents' other columns are carried, whatever their names.
    """
    found = _small(hits(docs, benchmark, text, item_id, item_text, window, filter_words), broadcast_bytes).withColumnRenamed("key", "_hit")
    rows = docs.select(F.struct("*").alias("doc"), text_key(F.col(text)).alias("_key"), words_in(F.col(text)).alias("n_words"))
    return rows.join(found, F.col("_key") == F.col("_hit"), "left").select(
        "doc",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:long,end:long>>")).alias("spans"),
    )


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """The rows of ``docs``, in all their columns, without a window of the benchmark. Nulls and repeats as in ``decontaminate``."""
    found = _small(hits(docs, benchmark, text, item_id, item_text, window).select(F.col("key").alias("_hit")), broadcast_bytes)
    rows = docs.select(F.struct("*").alias("doc"), text_key(F.col(text)).alias("_key"))
    return rows.join(found, F.col("_key") == F.col("_hit"), "left_anti").select("doc.*")
