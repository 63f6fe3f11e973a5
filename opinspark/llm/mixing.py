"""Mixing sources to target weights by entropy balancing.

A document of x words in source s is taken at the rate min(limit, exp(l_s * x / m_s)), m_s
being the mean size in the source. These are the rates closest to 1 in relative entropy,
among all under the limit, that bring the source's words to its target; l_s solves the convex
dual. Constraints touch one source each, so the dual falls apart by source: each source's
Newton iterations run on the executors, over a histogram of sizes rather than the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import global_order, materialize


def with_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the number of words `[^\\x20\\x09-\\x0D]+` of a text column and drops that column."""
    kept = df.drop(text)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in K.parts(batch, text):
                counts = pa.array(np.diff(K.Words(texts, K.SOLID, False).of), pa.int64())
                columns = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, counts], names=[*names, name])

    return df.mapInArrow(run, kept.withColumn(name, F.lit(0).cast("long")).schema)


def targets(sources: DataFrame, weights: list[int], limit: float) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources, in code point order with null last, weigh ``weights`` in turn. Shares of all words in
    proportion to the weights stop at ``limit`` times the source's words; what is over goes
    to the others by weight, until none is above. That is the water level L at which sum(min(limit *
    size, L * weight)) is the total, found in one pass by rising limit / weight.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("_place", F.row_number().over(in_order) - 1).withColumn(
        "_weight", F.element_at(table, (F.col("_place") % len(weights) + 1).cast("int"))
    )
    cap = F.lit(float(limit)) * F.col("source_size")
    by_rise = Window.orderBy("_rise", "_place")
    before = by_rise.rowsBetween(Window.unboundedPreceding, -1)
    after = by_rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        weighed.withColumn("_cap", cap)
        .withColumn("_rise", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn(
            "_level",
            (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after),
        )
    )
    fits = F.when(F.col("_level") <= F.col("_rise"), F.col("_level"))
    level = F.max(fits).over(Window.partitionBy())
    return levels.withColumn("_water", level).select(
        *sources.columns, F.least("_cap", F.coalesce(F.col("_water") * F.col("_weight"), F.col("_cap"))).alias("target")
    )


def solve(size: np.ndarray, count: np.ndarray, target: float, limit: float, rounds: int = 200) -> np.ndarray:
    """Rates by size whose words add up to ``target``: Newton's method on the dual, kept in a bracket."""
    size = size.astype(float)
    mass = size * count
    total = mass.sum()
    if target <= 0 or total <= 0:
        return np.zeros(len(size))
    if target >= limit * total:
        return np.full(len(size), float(limit))
    x = size / (total / count.sum())
    low, high = -1.0, 1.0
    rate = lambda l: np.minimum(limit, np.exp(np.minimum(l * x, 50.0)))  # noqa: E731,E741
    least = x[x > 0].min()
    while (mass * rate(low)).sum() > target and low * least > -800:
        low *= 2
    while (mass * rate(high)).sum() < target and high * least < 50:
        high *= 2
    at = 0.0
    for _ in range(rounds):
        w = rate(at)
        gap = (mass * w).sum() - target
        if abs(gap) <= 1e-9 * target:
            break
        low, high = (low, at) if gap > 0 else (at, high)
        slope = (mass * w * x * (w < limit)).sum()
        at = at - gap / slope if slope > 0 else low - 1
        if not low < at < high:
            at = (low + high) / 2
    return rate(at)


def copies(size: np.ndarray, count: np.ndarray, rates: np.ndarray, target: float, limit: int) -> tuple[np.ndarray, ...]:
    """Whole copies: each size's documents get ``base`` copies, and ``extra`` of them one more.

    From the largest size down, what rounding leaves over is carried to the next, so that the
    source ends within half of its smallest document of the target.
    """
    total = np.zeros(len(size), np.int64)
    owed = target - float((rates * count * size).sum())  # what the limit or the solver left
    for i in np.argsort(-size, kind="stable"):
        if size[i] <= 0:
            continue
        owed += float(rates[i]) * float(count[i]) * float(size[i])
        total[i] = min(max(round(owed / float(size[i])), 0), limit * int(count[i]))
        owed -= float(total[i]) * float(size[i])
    base = total // np.maximum(count, 1)
    return base, total - base * count


def _key(seed: int, doc_id: str, text: str, source: str) -> Column:
    given = [F.col(c) for c in (doc_id, text, source)]
    return F.xxhash64(F.lit(seed), *given, *[c.isNull() for c in given])  # nulls leave no trace of their place in a hash


def mix(
    docs: DataFrame,
    weights: list[int],
    limit: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 0,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, key, size`` (words), ``source, source_size, target, rate, copies``.

    Which of equally long documents of a source get one copy more is decided by a seeded hash of
    id, text and source, so reruns agree. Null texts have no words and documents without words no copies that
    count; the null source is a source like any other, put last. Repeated rows are separate rows.
    A source with nothing to give has target 0. Other columns are not looked at.
    """
    sized = materialize(
        with_words(
            docs.select(
                F.col(doc_id).alias("doc_id"),
                F.col(source).alias("source"),
                _key(seed, doc_id, text, source).alias("key"),
                F.col(text).alias("_text"),
            ),
            "_text",
            "size",
        )
    )
    histogram = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("count")))
    aims = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")), weights, limit)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size").reset_index(drop=True)
        size, count = group["size"].to_numpy(), group["count"].to_numpy()
        target = float(group["target"].iloc[0])
        rates = solve(size, count, target, limit)
        base, extra = copies(size, count, rates, target, limit)
        first = np.cumsum(count) - count
        return group.assign(rate=rates, _base=base, _extra=extra, _first=first)

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    joined = histogram.join(F.broadcast(aims.withColumnRenamed("source", "_s")), same("source", "_s")).drop("_s")
    strata = materialize(
        joined.groupBy("source").applyInPandas(
            plan,
            "source string, size long, count long, source_size long, target double, rate double, _base long, _extra long, _first long",
        )
    )
    ordered = global_order(sized, ["source", "size", "key", "doc_id"], [])
    starts = ordered.groupBy("source", "size").agg(F.min("row_index").alias("_start"))
    strata = strata.join(
        starts.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "_start"),
        same("source", "_s") & (F.col("size") == F.col("_z")),
    ).select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "rate", "_base", "_extra", "_start")
    strata = materialize(strata)
    small = strata.count() <= 200_000  # about 100 bytes a row
    on = same("source", "_s") & (F.col("size") == F.col("_z"))
    return ordered.join(F.broadcast(strata) if small else strata, on).select(
        "doc_id",
        "key",
        "size",
        "source",
        "source_size",
        "target",
        "rate",
        (F.col("_base") + (F.col("row_index") - F.col("_start") < F.col("_extra")).cast("long")).alias("copies"),
    )


def take(
    docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mixed`` (made with the same ids, texts, sources and seed) says.

    Rows of equal id, text and source count as one document with all their copies: the one whose columns hash lowest, so that reruns agree.
    Rows that differ in source alone are documents of their own, and each source gets what was planned for it.
    """
    plan = materialize(mixed.groupBy("key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n")))
    size = plan.agg(F.count("*").alias("rows"), F.max("_n").alias("most")).first()
    wanted = plan.filter("_copies > 0").select(F.col("key").alias("_key"), "_copies", "_n")
    wanted = F.broadcast(wanted) if size["rows"] <= broadcast_rows else wanted  # 24 bytes a row
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("doc"), _key(seed, doc_id, text, source).alias("row_key"))
    taken = rows.join(wanted, F.col("row_key") == F.col("_key"))
    if (size["most"] or 0) > 1:
        some = taken.filter("_n > 1").withColumn("_h", F.xxhash64(F.to_json("doc")))
        least = some.groupBy("row_key").agg(F.min("_h").alias("_least")).withColumnRenamed("row_key", "_same")
        some = some.join(least, (F.col("row_key") == F.col("_same")) & (F.col("_h") == F.col("_least"))).dropDuplicates(["row_key"])
        taken = taken.filter("_n = 1").select("doc", "_copies").unionByName(some.select("doc", "_copies"))
    return taken.select("doc", F.explode(F.expr("sequence(1L, _copies)"))).select("doc.*")
