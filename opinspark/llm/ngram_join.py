"""Set similarity self-join of word n-gram sets: rare-first prefix filtering, then components.

Each text becomes the set of its 64-bit hashed word n-grams. Sets are ordered by a global order,
rare n-grams first; two sets of Jaccard similarity t share an n-gram among the first
n - ceil(t * n) + 1 of each. Rows of these prefixes are shuffled by n-gram once; a pair must
then pass the length filter, the positional filter (what can still be common before and after the
shared n-gram) and the suffix filter (parities and counts by hash range bound the overlap), and is
verified once, on whole sets.

Equal sets are one class from the start. A group of rows that share an n-gram isn't
expanded into all pairs: in a few rounds, each row meets the first row that isn't yet in its
component; all pairs are then formed only between rows that are still unconnected.
No link leaves its component. So all links are counted last, inside the components that have others than those found so
far: their classes are dealt out to blocks, and two blocks meet as one product of matrices.

No task gets all rows of a frequent n-gram: a task that has met one ``HOT_ROWS`` times deals out further rows of it by
``SALTS`` salts. The first rows of such n-grams come from aggregates that start before the shuffle, and their pairs are
formed block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

SKETCH_BITS = 20
CHUNKS = 64
PARTS = 64
HOT_ROWS = 64  # rows of an n-gram that a task sends to the n-gram's one place
SALTS = 256
BLOCK_ROWS = 4096  # rows of an n-gram that meet as one block
BLOCK_CLASSES = 256  # classes of a component that meet as one block
BLOCK_GRAMS = 1 << 20  # their n-grams, where these are more
WIDTH = 4096  # columns of a matrix of classes and n-grams
PARITY = ["parity_0", "parity_1", "parity_2", "parity_3"]  # 64 bits each


def gram_sets(texts: K.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes text by text (sorted inside), and bounds by text.

    A text of fewer words, but not none, has one: of its whole word sequence.
    """
    words = K.Words(texts, K.SOLID, True)
    hashes = words.hashes()
    at = words.windows(n)
    grams, doc = K.rolling(hashes, n, K.BASE[2])[at], words.doc[at]
    counts = np.diff(words.of)
    for length in range(1, n):
        at = words.of[:-1][counts == length]
        if len(at):
            short = K.rolling(hashes, length, K.BASE[3])[at] ^ np.uint64(length)
            grams, doc = np.concatenate((grams, short)), np.concatenate((doc, words.doc[at]))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(texts) + 1))


def class_keys(grams: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, from sums of two mixes of its members and its size."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(grams ^ np.uint64(c)), dtype=np.uint64))) for c in K.BASE[:2]]
    a, b = (s[of[1:]] - s[of[:-1]] for s in sums)
    return K.mix(K.mix(a) ^ (b + np.diff(of).astype(np.uint64) * np.uint64(K.BASE[3])))


def _place(grams: np.ndarray) -> np.ndarray:
    return (K.mix(grams) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _describe(n: int) -> Callable:
    """Rows of (id, class, size) for texts, and at the end of a partition its counts by n-gram bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "text_hash", "class", "n", "chunk", "counts"]
        for batch in batches:
            for part, texts in K.parts(batch, "text"):
                grams, of = gram_sets(texts, n)
                np.add.at(counts, _place(grams), 1)
                rows = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array(class_keys(grams, of).view(np.int64)),
                        pa.array(np.diff(of)),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.binary()),
                    ],
                    names=names,
                )
        for chunk, part in enumerate(np.minimum(counts, 65_535).astype(np.uint16).reshape(CHUNKS, -1)):
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(1, pa.int64())] * 4, pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                names=names,
            )

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sums.setdefault(chunk, np.zeros((1 << SKETCH_BITS) // CHUNKS, np.int64))
            own += np.frombuffer(counts, np.uint16)
    for chunk, own in sums.items():
        bits = np.ceil(np.log2(own + 1)).astype(np.uint8)  # the order needs no more than the magnitude
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["chunk", "bits"]
        )


class _Salts:
    """Salts for the n-grams of one task: 0 for the first ``most`` rows of each, then 1 to ``SALTS``.

    A task's rows of an n-gram are of different classes, so one with other salts has at least two classes at salt 0
    (``most`` below 2 counts as 2), and what else has salt 0 isn't alone there.
    """

    def __init__(self, most: int) -> None:
        self.most, self.counts, self.met = max(most, 2), np.zeros(1 << SKETCH_BITS, np.int32), {}

    def __call__(self, grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
        place, salts = _place(grams), np.zeros(len(grams), np.int32)
        np.add.at(self.counts, place, 1)
        # a bucket of few rows has no frequent n-gram; in the others each is counted by itself
        rows = np.flatnonzero(self.counts[place] > self.most)
        dealt = (K.mix(grams[rows] ^ classes[rows].view(np.uint64)) % np.uint64(SALTS)).astype(np.int32) + 1
        for row, gram, salt in zip(rows.tolist(), grams[rows].tolist(), dealt.tolist(), strict=True):
            met = self.met[gram] = self.met.get(gram, 0) + 1
            if met > self.most:
                salts[row] = salt
        return salts


def _prefixes(n: int, percent: int, sketch, hot_rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, seen, salts = sketch.value, set(), _Salts(hot_rows)
        for batch in batches:
            for _, texts in K.parts(batch, "text"):
                grams, of = gram_sets(texts, n)
                keys, size = class_keys(grams, of).view(np.int64), np.diff(of)
                fresh = np.zeros(len(size), bool)
                for i, key in enumerate(keys.tolist()):
                    if size[i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                doc = np.repeat(np.arange(len(size)), size)
                grams, doc = grams[fresh[doc]], doc[fresh[doc]]
                order = np.lexsort((grams, rarity[_place(grams)], doc))
                grams = grams[order]
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                keep = place < (size - (percent * size + 99) // 100 + 1)[doc]
                grams, doc, place = grams[keep], doc[keep], place[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams.view(np.int64)),
                        pa.array(keys[doc]),
                        pa.array(size[doc].astype(np.int32)),
                        pa.array(place.astype(np.int32)),
                        pa.array(salts(grams, keys[doc])),
                    ],
                    names=["gram", "class", "n", "place", "salt"],
                )

    return run


def _part_counts(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = [c not in seen and not seen.add(c) for c in batch.column("class").to_pylist()]
            for part, texts in K.parts(batch.filter(pa.array(fresh, pa.bool_())), "text"):
                grams, of = gram_sets(texts, n)
                doc = np.repeat(np.arange(len(texts)), np.diff(of))
                counts = np.zeros((len(texts), PARTS), np.int32)
                np.add.at(counts, (doc, (grams >> np.uint64(58)).astype(np.int64)), 1)
                bounds = pa.array(np.arange(0, counts.size + 1, PARTS, dtype=np.int32))
                odd = np.zeros((len(texts), 64 * len(PARITY)), np.uint8)
                np.add.at(odd, (doc, (grams >> np.uint64(48)).astype(np.int64) % odd.shape[1]), 1)
                parity = np.packbits(odd & 1, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("class"),
                        part.column("text"),
                        pa.array(np.diff(of).astype(np.int32)),
                        pa.ListArray.from_arrays(bounds, pa.array(counts.ravel())),
                        *[pa.array(np.ascontiguousarray(parity[:, i])) for i in range(len(PARITY))],
                    ],
                    names=["class", "text", "n", "parts", *PARITY],
                )

    return run


def _similar(n: int, percent: int) -> Callable:
    """Of pairs with both texts, those whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch.column("text_a")), pc.binary_length(batch.column("text_b")))
            ends, at = np.cumsum(np.asarray(sizes)), 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 19), "right")))
                part = batch.slice(at, to - at)
                at = to
                # each text once, however many pairs of the slice it's in
                texts = pa.concat_arrays([part.column("text_a"), part.column("text_b")])
                classes = np.concatenate([np.asarray(part.column(c)) for c in "ab"])
                _, one, which = np.unique(classes, return_index=True, return_inverse=True)
                grams, of = gram_sets(K.Texts(texts.take(pa.array(one))), n)
                left, right = which[: len(part)], which[len(part) :]
                keep = np.zeros(len(part), bool)
                for i, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
                    a, b = grams[of[x] : of[x + 1]], grams[of[y] : of[y + 1]]
                    common = int(_among(a, b).sum())
                    keep[i] = (100 + percent) * common >= percent * (len(a) + len(b))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams each of the sets ``left`` has in common with each of ``right``."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = met > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2**24 are exact
    for start in range(0, int(shared.sum()), WIDTH):
        a, b = np.searchsorted(column, (start, start + WIDTH))
        has = np.zeros((len(sets), WIDTH), np.float32)
        has[row[a:b], column[a:b] - start] = 1
        common += has[left] @ has[right].T
    return common.astype(np.int64)


def _linked(n: int, percent: int) -> Callable:
    """Of rows sorted by blocks that meet (root, lo, hi): each class with the number of those of the other block it links to."""

    def counts(pair: tuple, rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        _, lo, hi = pair
        classes, own, sets = (list(c) for c in zip(*rows, strict=True))
        own, size = np.array(own), np.array([len(s) for s in sets])
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        common = _common(sets, left, right)
        links = (100 + percent) * common >= percent * (size[left][:, None] + size[right][None])
        if lo == hi:
            np.fill_diagonal(links, False)
        total = np.zeros(len(sets), np.int64)
        total[left] = links.sum(1)
        if lo != hi:
            total[right] = links.sum(0)
        return pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(total)], names=["class", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, rows = None, []
        for batch in batches:
            for part, texts in K.parts(batch, "text"):
                grams, of = gram_sets(texts, n)
                named = [part.column(c).to_pylist() for c in ("root", "lo", "hi", "class", "own")]
                for i, (root, lo, hi, key, own) in enumerate(zip(*named, strict=True)):
                    if (root, lo, hi) != pair:
                        if len(rows) > 1:
                            yield counts(pair, rows)
                        pair, rows = (root, lo, hi), []
                    rows.append((key, own, grams[of[i] : of[i + 1]]))
        if len(rows) > 1:
            yield counts(pair, rows)

    return run


def _all_links(classes: DataFrame, known: DataFrame, n: int, percent: int, broadcast_rows: int, block_classes: int) -> DataFrame:
    """(class, links) for ``classes`` (class, root) of whole components: to how many of the others each one links.

    A component of b blocks has b * (b + 1) / 2 pairs of blocks, and each text travels b times. A class that no n-gram of a
    prefix leads to isn't ``known``, and has no link.
    """
    rows = known.select("class", "text", "n").join(_few(classes, broadcast_rows), "class")
    blocks = F.ceil(F.greatest(F.count("*") / block_classes, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")
    rows = rows.join(_few(rows.groupBy("root").agg(blocks), broadcast_rows), "root")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "class", "text")
    rows = rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    found = rows.mapInArrow(_linked(n, percent), "class long, links long")
    return found.groupBy("class").agg(F.sum("links").alias("links"))


def _among(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


def enough(percent: int, common: Column, a: Column, b: Column) -> Column:
    """common / (a + b - common) >= percent / 100, in whole numbers."""
    return (100 + percent) * common >= percent * (a + b)


def _may_link(percent: int, x: Callable, y: Callable) -> Column:
    """Length and positional filters of a pair that shares an n-gram; x and y name the columns of its two rows.

    What both have before the shared n-gram lies in both prefixes, so only n-grams that more than one prefix holds
    (``before`` counts them) can be common there.
    """
    n1, n2 = x("n"), y("n")
    most = F.least(x("before"), y("before")) + 1 + F.least(n1 - x("place") - 1, n2 - y("place") - 1)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & enough(percent, most, n1, n2)


def _few(keys: DataFrame, most: int) -> DataFrame:
    """``keys``, to be broadcast where it has ``most`` rows or fewer; it should be cheap to count."""
    return F.broadcast(keys) if keys.count() <= most else keys


def _apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of n-grams that fit a window, and of those that don't."""
    return rows.filter("not hot"), rows.filter("hot")


def _open_rows(grouped: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of n-grams that more than one component holds, with their ``root``: one exchange, by n-gram."""
    group = Window.partitionBy("gram")
    rows = grouped.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    cold, hot = _apart(rows)
    cold = cold.withColumn("_lo", F.min("root").over(group)).withColumn("_hi", F.max("root").over(group))
    ends = hot.groupBy("gram").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"))
    return cold.unionByName(hot.join(ends, "gram")).filter("_lo != _hi").drop("_lo", "_hi")


def _pivot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each row with the first row of its n-gram that belongs to another component: one pair a row, whatever the group.

    First come rows with the fewest n-grams of their own: the text that near copies were made from links to all of
    them, where two copies need not link to each other.
    """
    group = Window.partitionBy("gram")
    item = F.struct("odd", "n", "class", "place", "before", "root")
    other = F.when(F.col("root") != F.col("f1.root"), item)
    cold, hot = _apart(rows)
    cold = cold.withColumn("f1", F.min(item).over(group))
    cold = cold.withColumn("f2", F.min(other).over(group))
    hot = hot.join(hot.groupBy("gram").agg(F.min(item).alias("f1")), "gram")
    hot = hot.join(hot.groupBy("gram").agg(F.min(other).alias("f2")), "gram")
    rows = cold.unionByName(hot)
    rows = rows.withColumn("o", F.when(F.col("root") != F.col("f1.root"), F.col("f1")).otherwise(F.col("f2")))
    ok = _may_link(percent, F.col, lambda c: F.col(f"o.{c}"))
    return rows.filter(ok).select(F.least("class", "o.class").alias("a"), F.greatest("class", "o.class").alias("b")).distinct()


def _alike(percent: int, x: Callable, y: Callable) -> Column:
    """Suffix filter by parities: ranges of hashes with an odd number of n-grams in just one of two sets.

    Each such range holds an n-gram that only one of them has, and these are n1 + n2 - 2 * common.
    """
    n = x("n") + y("n")
    apart = reduce(add, [F.bit_count(x(p).bitwiseXOR(y(p))) for p in PARITY])
    return (100 + percent) * (n - apart) >= 2 * percent * n


def _blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of ``rows`` with themselves on ``gram``, ``lo`` and ``hi``: blocks of an n-gram.

    ``own`` is a row's block. On the left a row stands for its block as ``lo``, once for each ``hi`` from there on; on the
    right for its block as ``hi``. So two rows of one block meet there, both ways round, and two of different ones once.
    """
    many = rows.groupBy("gram").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = rows.join(many, "gram").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    left = dealt.withColumn("lo", F.col("own")).withColumn("hi", F.explode(F.sequence("own", F.col("blocks") - 1)))
    right = dealt.withColumn("hi", F.col("own")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("own"))))
    return left, right


def _open_pairs(rows: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """All pairs of rows of one n-gram and different components that pass the filters.

    Besides length, place and parities, the n-grams that two prefixes share bound the overlap: what isn't among them
    lies behind the prefix of at least one of the two.
    """
    x_, y_, c = "x", "y", F.col
    one, other = lambda k: c(f"x.{k}"), lambda k: c(f"y.{k}")
    may = (one("root") != other("root")) & _may_link(percent, one, other) & _alike(percent, one, other)
    cold, hot = _apart(rows)
    left, right = _blocks(hot, block_rows)
    met = [
        cold.alias(x_).join(cold.alias(y_), (one("gram") == other("gram")) & (one("class") < other("class")) & may),
        left.alias(x_).join(
            right.alias(y_),
            reduce(and_, [one(k) == other(k) for k in ("gram", "lo", "hi")])
            & ((one("lo") < one("hi")) | (one("class") < other("class")))
            & may,
        ),
    ]
    ordered = one("class") < other("class")
    pairs = reduce(
        DataFrame.unionByName,
        [
            m.select(
                F.least(one("class"), other("class")).alias("a"),
                F.greatest(one("class"), other("class")).alias("b"),
                F.when(ordered, one("n")).otherwise(other("n")).alias("na"),
                F.when(ordered, other("n")).otherwise(one("n")).alias("nb"),
            )
            for m in met
        ],
    ).groupBy("a", "b", "na", "nb")
    behind = F.ceil(F.greatest("na", "nb") * percent / 100) - 1
    return pairs.agg(F.count("*").alias("both")).filter(enough(percent, c("both") + behind, c("na"), c("nb"))).select("a", "b")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps; each is two keyed aggregations and ends when
    nothing changes, in a number of rounds logarithmic in the nodes. Raises if that takes more than ``rounds``.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u != v").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _verified(pairs: DataFrame, known: DataFrame, n: int, percent: int, broadcast_rows: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose whole sets are similar enough; suffix filter first.

    Only what the pairs name is shuffled: counts of their classes, then texts of those that are left. Texts travel,
    not sets: they are a third of the size.
    """
    def named(pairs: DataFrame, *columns: str) -> DataFrame:
        classes = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        return known.select("class", *columns).join(_few(classes, broadcast_rows), "class", "left_semi")

    def of(table: DataFrame, x: str) -> DataFrame:
        return table.select([F.col(c).alias(x if c == "class" else f"{c}_{x}") for c in table.columns])

    pairs = materialize(pairs)
    counts = named(pairs, "parts", "n")
    most = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    pairs = pairs.join(of(counts, "a"), "a").join(of(counts, "b"), "b")
    pairs = materialize(pairs.filter(enough(percent, most, F.col("n_a"), F.col("n_b"))).select("a", "b"))
    texts = named(pairs, "text")
    joined = pairs.join(of(texts, "b"), "b").join(of(texts, "a"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_similar(n, percent), "a long, b long").distinct()


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that stand for their component in ``found``: the one of the smallest id.

    Rows of equal id and text are one document. Without an id in its component a row stays; documents without n-grams all stay.
    """
    keys = found.select("doc_id", "text_hash", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    keys = materialize(keys.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    size = keys.agg(F.count_if("stays").alias("rows"), F.max("n").alias("most")).first()
    kept = keys.filter("stays").select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"))
    kept = F.broadcast(kept) if size["rows"] <= broadcast_rows else kept  # 16 bytes a row
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("hash"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("_kept_id")) & (F.col("hash") == F.col("_kept_hash")), "left_semi")
    if (size["most"] or 0) > 1:
        rows = rows.dropDuplicates(["id", "hash"])
    return rows.select("doc.*")


def ngram_jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, broadcast_rows: int = 2_000_000, pivot_rounds: int = 4, pivot_gain: int = 20, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS, block_classes: int = BLOCK_CLASSES
) -> DataFrame:
    """``doc_id, text_hash, n_shingles, class, component_id, n_links``: one row per row of ``docs``.

    Texts link when the Jaccard similarity of their n-gram sets is ``percent`` / 100 or more.
    ``class`` is a key of the n-gram set (null if it's empty), ``component_id`` the smallest id reachable
    by links, ``n_links`` to how many other classes its class links (all of them; copies share a class
    and aren't counted). Null, empty and wordless texts have no n-grams, link
    with nothing and are components by themselves. Repeated rows are equal texts, and so linked. A null id is
    never smallest. n-grams and classes are told apart by 64-bit hashes.

    Pivot rounds end after ``pivot_rounds``, or when one adds less than 1 in ``pivot_gain`` links; what they leave is
    compared in full. ``hot_rows`` and ``block_rows`` say when an n-gram's rows are dealt out, ``block_classes`` how a component's
    classes are, and change no result.
    Words are lower-cased in A-Z. Other columns are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = materialize(
        texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_describe(n), "doc_id long, text_hash long, class long, n long, chunk int, counts binary")
    )
    chunks = first.filter("chunk is not null").select("chunk", "counts")
    bits = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.uint8)
    summed = chunks.repartition(CHUNKS, "chunk").mapInArrow(_add_up, "chunk int, bits binary")
    for row in summed.collect():  # one byte a bucket: a fixed 1 MB in all
        bits[row.chunk] |= np.frombuffer(row.bits, np.uint8)
    sketch = spark.sparkContext.broadcast(bits.ravel())

    described = first.filter("chunk is null").select("doc_id", "text_hash", F.when(F.col("n") > 0, F.col("class")).alias("class"), "n")
    prefixes = texts.select("text").mapInArrow(_prefixes(n, percent, sketch, hot_rows), "gram long, class long, n int, place int, salt int")
    in_group = Window.partitionBy("gram", "salt").orderBy("class")
    grouped = materialize(
        prefixes.repartition("gram", "salt")
        .dropDuplicates(["gram", "salt", "class"])
        .withColumn("_before", F.lag("class").over(in_group))
        .withColumn("_after", F.lead("class").over(in_group))
        # other classes of a salted n-gram have its salt 0
        .filter("_before is not null or _after is not null or salt > 0")
        .drop("_before", "_after")
    )
    # n-grams in any task's surplus: at most a row of ``grouped`` in ``hot_rows``
    salted = materialize(grouped.filter("salt > 0").select("gram").distinct()).withColumn("_hot", F.lit(True))
    grouped = grouped.join(_few(salted, broadcast_rows), "gram", "left").withColumn("hot", F.coalesce("_hot", F.lit(False)))
    # copies of a class in several tasks may have both a salt and none
    of_class = Window.partitionBy("class")
    grouped = grouped.drop("salt", "_hot").withColumn("_same", F.lag("place").over(of_class.orderBy("place")))
    grouped = grouped.filter("_same is null or _same != place").drop("_same")
    # the share of a class's prefix that others have too: high for what a group of near copies was made from
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    grouped = grouped.withColumn("before", F.row_number().over(of_class.orderBy("place")) - 1)
    grouped = materialize(grouped.withColumn("odd", F.floor(1000 - 1000 * F.count("*").over(of_class) / prefix).cast("int")))

    shared = grouped.select("class").distinct()
    # one text of each class that shares an n-gram
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("at")
    members = described.groupBy("class").agg(holder).join(shared, "class")
    wanted = materialize(members.select("class", F.col("at.doc_id").alias("_id"), F.col("at.text_hash").alias("_hash")))
    same = texts["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(texts["text"]) == F.col("_hash"))
    chosen = texts.join(_few(wanted, broadcast_rows), same).select("class", "text")  # 24 bytes a row
    parity = "".join(f", {p} long" for p in PARITY)
    known = materialize(chosen.mapInArrow(_part_counts(n), f"class long, text string, n int, parts array<int>{parity}"))

    open_rows, n_links = grouped.withColumn("root", F.col("class")), 0
    roots = links = tried = None
    for _ in range(pivot_rounds):
        pairs = _pivot_pairs(open_rows, percent)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs)
        tried = tried.unionByName(pairs) if tried is not None else pairs
        more = materialize(_verified(pairs, known, n, percent, broadcast_rows))
        links = links.unionByName(more) if links is not None else more
        found = more.count()
        n_links += found
        if not found:
            break
        roots = materialize(components(links))
        open_rows = _open_rows(grouped, _few(roots, broadcast_rows))  # 16 bytes a row
        if found * pivot_gain < n_links:
            break
    sketches = _few(known.select("class", *PARITY), broadcast_rows)  # 40 bytes a row
    rest = materialize(open_rows.drop("odd")).join(sketches, "class")
    rest = _open_pairs(rest, percent, block_rows).join(tried, ["a", "b"], "left_anti")
    more = materialize(_verified(rest, known, n, percent, broadcast_rows))
    links = links.unionByName(more)
    if roots is None or more.limit(1).count():
        roots = materialize(components(links))

    degree = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class")))
    degree = degree.groupBy("class").agg(F.count("*").alias("n_links"))
    classes = described.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").join(degree, "class", "left")
    classes = materialize(classes.select("class", "least", F.coalesce("root", "class").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    # a component is whole where each two of its classes have been found to link
    of_root = [F.min("least").alias("component_id"), (F.sum("n_links") < F.count("*") * (F.count("*") - 1)).alias("open")]
    classes = materialize(classes.join(classes.groupBy("root").agg(*of_root), "root"))
    all_links = _all_links(classes.filter("open").select("class", "root"), known, n, percent, broadcast_rows, block_classes)
    classes = classes.join(all_links, "class", "left").select("class", "component_id", F.coalesce("links", "n_links").alias("n_links"))
    classes = materialize(classes)
    return described.join(classes, "class", "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        "class",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
