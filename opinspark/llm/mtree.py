"""Exact top-k inner-product search with a forest of M-trees.

Inner products become distances by one more coordinate: with M the largest norm, x -> (x, sqrt(M^2 - |x|^2))
and q -> (q, 0) give |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest are the best scored. Points are dealt to the
nearest of a number of pivots that grows with the table; what is still too large for a tree is cut into rings by the distance to
the pivot, so that parts of a cell are nested shells and not random halves. A tree is a set of paged nodes: routing entries
with a centre, a covering radius and the distance to their parent, and leaves with vectors and their distances to the parent.
Trees are written once, a row each.

Queries come in blocks of a stated size, which all trees get. Inside a tree a block goes best first: the node with the least lower bound of
any query in the block is next. Stored distances come first: |d(q, parent) - d(entry, parent)| - radius is a lower bound
that needs no computation; queries and entries that it rules out drop out, and what is left of the block is computed as one matrix product.
A first pass searches each query's own tree alone; the k-th score found there bounds the search in all others.

Scores are integers and compared as such; distances only steer the search, with a margin for rounding.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SLACK = 1e-6
LOW = np.iinfo(np.int64).min


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, shorter ones padded with zeros."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    out = np.zeros((len(column), dims), np.int64)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), place] = np.asarray(column.flatten())
    return out


def lift(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(float)
    return np.column_stack((x, np.sqrt(np.maximum(top - (x * x).sum(1), 0.0))))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all of b."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


class Tree:
    """An M-tree over vectors of integers, bulk loaded: nodes hold at most ``page`` entries.

    ``rank`` orders points of equal score: smaller comes first; each is below the number of points.
    """

    def __init__(self, x: np.ndarray, top: float, rank: np.ndarray, page: int = 128, seed: int = 0):
        self.x, self.top, self.page = x, top, page
        self.bits = max(1, int(len(x) - 1).bit_length())
        self.tie = (len(x) - 1 - rank).astype(np.int64)
        #: whole numbers up to here are exact as doubles, and leave room for ``tie`` below them
        self.exact = top * 4 < 2.0**53 and top * 4 < 2.0 ** (62 - self.bits)
        #: a node: (leaf?, entry rows or child nodes, centres, radii, distances to the node's own centre)
        self.nodes: list[tuple] = []
        points = lift(x, top)
        self.centre = points.mean(0)
        rng = np.random.default_rng(seed)
        self.radius, self.root = self._load(points, np.arange(len(points)), self.centre, rng)

    def _load(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray, rng) -> tuple[float, int]:
        away = np.sqrt(((points[rows] - centre) ** 2).sum(1))
        radius = float(away.max())
        if len(rows) <= self.page:
            self.nodes.append((True, rows, None, None, away))
            return radius, len(self.nodes) - 1
        ways = min(self.page, max(2, -(-len(rows) // self.page) * 2))
        near = apart(points[rows], points[rows[rng.choice(len(rows), ways, replace=False)]]).argmin(1)
        if np.bincount(near, minlength=ways).max() == len(rows):  # all alike: any even split will do
            near = np.arange(len(rows)) * ways // len(rows)
        kids, centres, radii = [], [], []
        for g in np.unique(near):
            own = rows[near == g]
            middle = points[own].mean(0)
            r, kid = self._load(points, own, middle, rng)
            kids.append(kid)
            centres.append(middle)
            radii.append(r)
        centres = np.array(centres)
        aways = np.sqrt(((centres - centre) ** 2).sum(1))
        self.nodes.append((False, kids, centres, np.array(radii), aways))
        return radius, len(self.nodes) - 1

    def search(self, asks: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of ``asks`` its k best points of a score of ``known`` or more.

        Returns (place in asks, row of the point, score), and the number of distances that bounds didn't rule out, by query.
        """
        asks = asks.astype(np.int64)
        floor = np.full(len(asks), LOW) if known is None else known
        if not self.exact:
            return self._wrapping(asks, k, floor)
        n, q = len(asks), asks.astype(float)
        q = np.column_stack((q, np.zeros(n)))
        square = (q * q).sum(1)
        slack = SLACK * (1 + np.sqrt(square + self.top))
        best = np.full((n, k), LOW)
        least_key = np.where(floor == LOW, LOW, np.maximum(floor, -(2 ** (62 - self.bits))) << self.bits)
        limit = self._reach(square, floor, slack)
        start = apart(q, self.centre[None])[:, 0]
        computed = np.ones(n, np.int64)
        bound = np.maximum(start - self.radius, 0.0)
        queue, turn = [(float(bound.min()), 0, self.root, np.arange(n), bound, start)], 1
        x = self.x.astype(float)
        while queue:
            lowest, _, node, who, bound, to_parent = heapq.heappop(queue)
            if lowest > limit.max():
                break
            stay = bound <= limit[who]
            if not stay.any():
                continue
            who, to_parent = who[stay], to_parent[stay]
            leaf, entries, centres, radii, aways = self.nodes[node]
            lower = np.abs(to_parent[:, None] - aways[None, :])
            if leaf:
                need = lower <= limit[who][:, None]
                computed[who] += need.sum(1)
                keys = ((q[who, :-1] @ x[entries].T).astype(np.int64) << self.bits) | self.tie[entries][None, :]
                keys[~need | (keys < least_key[who][:, None])] = LOW
                better = keys.max(1) > best[who].min(1)
                if better.any():
                    who = who[better]
                    merged = np.concatenate((best[who], keys[better]), 1)
                    best[who] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
                    kth = best[who].min(1)
                    limit[who] = self._reach(square[who], np.maximum(np.where(kth == LOW, LOW, kth >> self.bits), floor[who]), slack[who])
                continue
            passing = lower - radii[None, :] <= limit[who][:, None]
            computed[who] += passing.sum(1)
            away = apart(q[who], centres)
            bounds = np.maximum(away - radii[None, :], 0.0)
            passing &= bounds <= limit[who][:, None]
            for kid in np.flatnonzero(passing.any(0)).tolist():
                own = passing[:, kid]
                heapq.heappush(queue, (float(bounds[own, kid].min()), turn, entries[kid], who[own], bounds[own, kid], away[own, kid]))
                turn += 1
        ask, at = np.nonzero(best != LOW)
        keys = best[ask, at]
        row_of_tie = np.empty(len(self.x), np.int64)
        row_of_tie[self.tie] = np.arange(len(self.x))
        return np.stack([ask, row_of_tie[keys & ((1 << self.bits) - 1)]]), keys >> self.bits, computed

    def _reach(self, square: np.ndarray, least: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Points farther than this can't have a score of ``least``."""
        far = np.sqrt(np.maximum(square + self.top - 2.0 * np.where(least == LOW, 0, least), 0.0)) + slack
        return np.where(least == LOW, np.inf, far)

    def _wrapping(self, asks: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Components so large that doubles can't bound the scores: all of them, in 64-bit whole numbers that wrap around."""
        places, scores = [], []
        for i, ask in enumerate(asks):
            with np.errstate(over="ignore"):
                score = self.x.astype(np.int64) @ ask
            order = np.lexsort((-self.tie, ~score))[:k]
            order = order[score[order] >= floor[i]]
            places.append(np.stack([np.full(len(order), i), order]))
            scores.append(score[order])
        return np.concatenate(places, 1), np.concatenate(scores), np.full(len(asks), len(self.x))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int8 if 0 <= most < 2**7 else np.int16 if 0 <= most < 2**15 else np.int32 if 0 <= most < 2**31 else np.int64)


BUILT = "tree int, points long, index binary"


def _build(top: float, dims: int, page: int) -> Callable[[pa.Table], pa.Table]:
    """A group of points becomes one row: its tree, with the ids of each point."""

    def run(points: pa.Table) -> pa.Table:
        ids = points.column("ids").combine_chunks()
        first = [x[0] for x in ids.to_pylist()]
        order = sorted(range(len(first)), key=lambda i: (first[i] is None, first[i] or 0))
        rank = np.empty(len(first), np.int64)
        rank[order] = np.arange(len(first))
        x = _narrow(matrix(points.column("v").combine_chunks(), dims))
        index = pickle.dumps((Tree(x, top, rank, page), ids.to_pylist()), protocol=5)
        return pa.table(
            {"tree": pa.array([points.column("tree")[0].as_py()], pa.int32()), "points": pa.array([len(x)], pa.int64()), "index": pa.array([index], pa.binary())}
        )

    return run


FOUND = "ask int, score long, ids array<long>, own boolean, computed long"


def _search(shared, k: int, own: bool, step: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each tree's best for a block of queries; with ``own`` only for those whose own tree it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, home, known = shared.value
        for batch in batches:
            for number, blob in zip(batch.column("tree").to_pylist(), batch.column("index"), strict=True):
                rows = np.flatnonzero(home == number) if own else np.arange(len(asks))
                if not len(rows):
                    continue
                tree, ids = pickle.loads(blob.as_buffer())  # noqa: S301  written by _build
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    (ask, row), score, computed = tree.search(asks[part], k, None if own else known[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part[ask], pa.int32()),
                            pa.array(score, pa.int64()),
                            pa.array([None] * len(row) if own else [ids[r] for r in row.tolist()], pa.list_(pa.int64())),
                            pa.array((tree.x[row] == asks[part[ask]]).all(1)),
                            pa.array(computed[ask], pa.int64()),
                        ],
                        names=["ask", "score", "ids", "own", "computed"],
                    )

    return run


def _plant(distinct: DataFrame, dims: int, top: float, pivots: int, sample: int, tree_rows: int) -> DataFrame:
    """Adds ``tree``: the nearest pivot's, and there the ring of the distance to it."""
    spark = distinct.sparkSession
    count = distinct.count()
    wanted = max(1, min(pivots, -(-2 * count // tree_rows)))
    # a bounded sample: hashes below a threshold, then the first of them
    most = min(2**63 - 1, int(min(1.0, 4 * sample / max(count, 1)) * 2**64) - 2**63)
    near = F.xxhash64("point") <= F.lit(most).cast("long")
    drawn = distinct.filter(near).orderBy(F.xxhash64("point"), "point").limit(sample).select("v").toArrow()
    drawn = drawn if len(drawn) else distinct.select("v").limit(1).toArrow()
    points = np.unique(lift(matrix(drawn.column("v").combine_chunks(), dims), top), axis=0)
    rng = np.random.default_rng(0)
    shared = spark.sparkContext.broadcast(points[rng.choice(len(points), min(wanted, len(points)), replace=False)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                away = apart(lift(matrix(part.column("v"), dims), top), shared.value)
                near = away.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(near, pa.int32()), pa.array(away[np.arange(len(near)), near])],
                    names=[*part.schema.names, "pivot", "away"],
                )

    placed = materialize(distinct.mapInArrow(assign, "point string, v array<long>, ids array<long>, pivot int, away double"))
    shared.unpersist()
    cells = placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()  # one row a pivot
    rings = {r.pivot: -(-r.n // tree_rows) for r in cells}
    cut = [p for p, n in rings.items() if n > 1]
    ring = F.lit(0)
    if cut:
        steps = [i / 256 for i in range(1, 256)]
        marks = placed.filter(F.col("pivot").isin(cut)).groupBy("pivot").agg(F.percentile_approx("away", steps, 10_000).alias("marks"))
        chosen = [(r.pivot, [r.marks[round(i * 256 / n) - 1] for i in range(1, n)]) for r in marks.collect() if (n := min(rings[r.pivot], 256))]
        edges = F.broadcast(spark.createDataFrame(chosen, "_q int, marks array<double>"))  # 255 numbers a pivot at most
        placed = placed.join(edges, F.col("pivot") == F.col("_q"), "left")
        ring = F.coalesce(F.size(F.filter("marks", lambda m: m < F.col("away"))), F.lit(0))
    # rings that are still too large (equal distances, or more than 256 rings' worth) are cut by hash, with the same bounds
    placed = placed.withColumn("ring", ring)
    sizes = {(r.pivot, r.ring): -(-r.n // (2 * tree_rows)) for r in placed.groupBy("pivot", "ring").agg(F.count("*").alias("n")).collect()}
    first, at = {}, 0
    for cell in sorted(sizes):
        first[cell], at = at, at + sizes[cell]
    numbers = spark.createDataFrame([(p, r, first[p, r], n) for (p, r), n in sizes.items()], "_p int, _r int, _first int, _n int")
    on = (F.col("pivot") == F.col("_p")) & (F.col("ring") == F.col("_r"))
    # a row of 16 bytes for some thousand points: the size is known from ``sizes``
    numbers = F.broadcast(numbers) if len(sizes) <= 1_000_000 else numbers
    tree = (F.col("_first") + F.pmod(F.xxhash64("point"), F.col("_n"))).cast("int")
    return placed.join(numbers, on).select("point", "v", "ids", tree.alias("tree"))


def top_k(
    rows: DataFrame,
    queries: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 64,
    pivots: int = 1_024,
    sample: int = 4_096,
    tree_rows: int = 8_192,
    page: int = 128,
    block: int = 65_536,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``queries`` holds, the k best others by integer inner product.

    Every row but the query's own is a candidate: rows that repeat an id or a vector count each, and so do rows without
    an id. Ties go to smaller ids, null ids last. Equal vectors are one point carrying its k + 1 smallest ids (no query needs more), and
    equal queries are searched once. Vectors that are null or hold a null or non-finite component take no part; shorter vectors count as
    padded with zeros. Without enough others a query gets all there are. Where products don't fit 53 bits (components of many
    millions) nothing is pruned, and past 64 bits they wrap around.

    The pivots (at most ``pivots``, one for about half of ``tree_rows`` points) are fit on at most ``sample`` points; every point is
    indexed, and the result is exact. The driver sees ``block`` queries at a time, the pivots and one row a tree or ring.
    """
    spark = rows.sparkSession
    points = rows.filter(finite(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("id"), quantized(F.col(vector), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    text = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    points = materialize(points.withColumn("point", F.sha2(text.cast("binary"), 256)))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    described = points.agg(F.max(F.size("v")), F.max(squares), F.count_if("asks")).first()
    if not described[2]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, top = described[0], float(described[1]) * (1 + 1e-12)
    by_id = Window.partitionBy("point").orderBy(F.col("id").asc_nulls_last())
    least = points.select("point", "id", "v").withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= k + 1)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"])
    distinct = materialize(least.groupBy("point").agg(F.first("v").alias("v"), listed.alias("ids")))
    forest = materialize(_plant(distinct, dims, top, pivots, sample, tree_rows))
    files = min(2 * (forest.agg(F.max("tree")).first()[0] + 1), 20_000)  # a tree is little to read and much to search
    trees = materialize(forest.repartition(files, "tree").groupBy("tree").applyInArrow(_build(top, dims, page), BUILT))

    wanted = points.filter("asks").select("point").distinct()
    asked = materialize(forest.join(wanted, "point").select("point", "v", "tree"))
    blocks = max(1, -(-asked.count() // block))
    found = None
    for number in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("point"), F.lit(blocks)) == number).orderBy("tree", "point").toArrow()
        best = materialize(_block(spark, trees, some, dims, k))
        found = best if found is None else found.unionByName(best)

    # of each searched point the k + 1 best rows; a query then leaves out its own
    of_point = Window.partitionBy("asked").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.select(F.col("point").alias("asked"), "score", "own", F.explode("ids").alias("vec_id"))
    ranked = ranked.withColumn("_n", F.row_number().over(of_point)).filter(F.col("_n") <= k + 1)
    item = F.struct("_n", "score", "vec_id", "own")
    lists = ranked.groupBy("asked").agg(F.array_sort(F.collect_list(item)).alias("best"))
    asking = points.filter("asks").select(F.col("point").alias("asked"), F.col("id").alias("query_id"))
    answers = asking.join(lists, "asked")
    self_at = F.array_position(F.transform("best", lambda x: x["own"] & x["vec_id"].eqNullSafe(F.col("query_id"))), True)
    others = F.filter("best", lambda x, i: i + 1 != F.col("_self"))
    answers = answers.withColumn("_self", self_at).withColumn("best", F.slice(others, 1, k))
    return answers.select("query_id", F.posexplode("best").alias("_at", "x")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def _block(spark: SparkSession, trees: DataFrame, some: pa.Table, dims: int, k: int) -> DataFrame:
    """``point, score, ids, own`` for one block of queries: candidates among which are the k + 1 best rows."""
    asks = _narrow(matrix(some.column("v").combine_chunks(), dims)) if len(some) else np.zeros((0, dims), np.int8)
    home = np.asarray(some.column("tree")).astype(np.int64)
    first = spark.sparkContext.broadcast((asks, home, None))
    own = trees.mapInArrow(_search(first, k + 1, True), FOUND)
    # the least of k + 1 scores; a tree of fewer points bounds nothing
    scores = own.groupBy("ask").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k + 1).toArrow()
    known = np.full(len(asks), LOW)
    known[np.asarray(scores.column("ask")).astype(np.int64)] = np.asarray(scores.column("least"))
    block = spark.sparkContext.broadcast((asks, home, known))
    found = trees.mapInArrow(_search(block, k + 1, False), FOUND)
    names = pa.table({"ask": pa.array(np.arange(len(asks)), pa.int32()), "point": some.column("point")})
    # at most ``block`` rows
    return found.join(F.broadcast(spark.createDataFrame(names)), "ask").select("point", "score", "ids", "own")
