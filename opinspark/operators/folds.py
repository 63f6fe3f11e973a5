"""Order-dependent folds within a product: these run as grouped pandas functions over bounded groups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BETWEEN = "\x1f"  # stands in no word


def lcs(a, b) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a: str, b: str) -> float:
    """Similarity from 0 to 100 by insertions and deletions."""
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best ``ratio`` of the shorter text with a piece of the longer one of its length; 0 where none reaches ``least``.

    Pieces with too few characters in common, wherever they stand, aren't compared.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    if short in long:
        return 100.0
    n, best = len(short), max(0, -int(-least * len(short) // 100) - 1)
    free, shared = Counter(short), 0  # characters of the short text that the piece doesn't use; those it does
    for end, x in enumerate(long):
        shared += free[x] > 0
        free[x] -= 1
        if end >= n:
            gone = long[end - n]
            free[gone] += 1
            shared -= free[gone] > 0
        if end >= n - 1 and shared > best:
            best = max(best, common(short, long[end - n + 1 : end + 1]))
    out = 100.0 * best / n
    return out if out >= least else 0.0


def label_clusters(labels: DataFrame, least: float = 0.74) -> DataFrame:
    """product_id, label -> product_id, label, name: single link, first fit, in the order of the labels.

    A product has at most as many labels as candidates, so a group is small.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list[str]] = []
        for label in sorted(set(group["label"])):
            home = next((c for c in clusters if any(SequenceMatcher(None, label, x).ratio() >= least for x in c)), None)
            if home is None:
                clusters.append([label])
            else:
                home.append(label)
        rows = [(group["product_id"].iloc[0], x, min(c, key=lambda y: (len(y), y))) for c in clusters for x in c]
        return pd.DataFrame(rows, columns=["product_id", "label", "name"])

    return labels.groupBy("product_id").applyInPandas(fold, "product_id long, label string, name string")


def _apart(a: np.ndarray, b: np.ndarray, cosine: bool) -> np.ndarray:
    """Distances of the points of two arrays of one length, row by row."""
    return 1 - (a * b).sum(-1) if cosine else np.sqrt(((a - b) ** 2).sum(-1))


def _close(points: np.ndarray, threshold: float, cosine: bool, block: int) -> Iterator[tuple[int, int, float]]:
    """All pairs of points no farther apart than the threshold: products of two blocks sift them, what is left is measured."""
    square = (points**2).sum(1)
    most = 1 - threshold if cosine else threshold**2
    for at in range(0, len(points), block):
        part = points[at : at + block]
        for to in range(0, at + 1, block):
            inner = part @ points[to : to + block].T
            if cosine:
                near = inner >= most - 1e-6
            else:
                near = square[at : at + block, None] + square[to : to + block] - 2 * inner <= most + 1e-6 * (1 + most + square.max())
            j, i = np.nonzero(near)
            i, j = i + to, j + at
            i, j = i[i < j], j[i < j]
            far = _apart(points[i], points[j], cosine)
            some = far <= threshold
            yield from zip(i[some].tolist(), j[some].tolist(), far[some].tolist(), strict=True)


def average_link(points: np.ndarray, threshold: float, cosine: bool = False, block: int = 1024) -> np.ndarray:
    """Agglomerative clusters by average link, until the closest two are farther apart than the threshold.

    Clusters that are farther apart stay so until one of them grows by a part that is nearer, so only pairs within the threshold are kept,
    and a distance that was let go is measured again when it is asked for: no matrix of all pairs. Copies are one point with their number.
    """
    if threshold < 0:
        return np.arange(len(points))
    home = np.arange(len(points))
    if cosine:  # copies aren't quite at distance 0 there, and blank vectors are far apart
        points = points / (np.linalg.norm(points, axis=1, keepdims=True) + 1e-9)
    else:
        # unlike points by their first places: what is compared, and what ties are broken by, is as if copies stood apart
        _, first, copy = np.unique(points, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)
        home, points = np.argsort(order)[copy.reshape(-1)], points[first[order]]
    weight = np.bincount(home).astype(float)
    members = [[i] for i in range(len(points))]
    size, group = weight.tolist(), np.arange(len(points))
    near: list[dict[int, float]] = [{} for _ in members]
    heap = []
    for i, j, far in _close(points, threshold, cosine, block):
        near[i][j] = near[j][i] = far
        heap.append((far, i, j))
    heapify(heap)

    def mean(i: int, j: int) -> float:
        one, two = members[i], members[j]
        rows = max(1, (block * block) // (64 * len(two)))
        total = 0.0
        for at in range(0, len(one), rows):
            part = one[at : at + rows]
            total += float(weight[part] @ _apart(points[part, None], points[two][None], cosine) @ weight[two])
        return total / (size[i] * size[j])

    while heap:
        far, i, j = heappop(heap)
        if near[i].get(j) != far:
            continue
        grown = {}
        for c in near[i].keys() | near[j].keys():
            if c not in (i, j):
                one, two = near[i].get(c), near[j].get(c)
                one, two = mean(i, c) if one is None else one, mean(j, c) if two is None else two
                grown[c] = (size[i] * one + size[j] * two) / (size[i] + size[j])
                near[c].pop(i, None)
                near[c].pop(j, None)
        near[j] = {}
        near[i] = {c: d for c, d in grown.items() if d <= threshold}
        for c, d in near[i].items():
            near[c][i] = d
            heappush(heap, (d, min(i, c), max(i, c)))
        group[members[j]] = i
        members[i], members[j] = members[i] + members[j], []
        size[i] += size[j]
    return np.unique(group[home], return_inverse=True)[1]


def semantic_clusters(rows: DataFrame, key: str, item: str, vector: str, threshold: float = 1.1, cosine: bool = False) -> DataFrame:
    """Clusters of vectors per key. A key's vectors are one group: memory is by them and their pairs within the threshold, not by all pairs."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(item)
        found = average_link(np.stack(group[vector].to_list()).astype(float), threshold, cosine)
        return pd.DataFrame({key: group[key], item: group[item], "cluster": found.astype("int64")})

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {item} {kinds[item]}, cluster long")


def furthest(a: int, b: int, least: float) -> int:
    """Most insertions and deletions between texts of these lengths that still reach the ratio; -1 where none do."""
    most = int((a + b) * (100 - least) / 100 + 1e-9)
    most -= (most - a - b) % 2
    return most if most >= abs(a - b) else -1


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    return [(k * length // parts, (k + 1) * length // parts) for k in range(parts)]


def _codes(texts: list[str]) -> np.ndarray:
    """A row a text, all of one length."""
    n = len(texts[0])
    return np.array(texts, dtype=f"<U{n}").view(np.uint32).reshape(-1, n)


def _parities(codes: np.ndarray) -> np.ndarray:
    """Which characters (by their last six bits) stand in a text an odd number of times."""
    return np.bitwise_xor.reduce(np.uint64(1) << (codes & 63).astype(np.uint64), axis=1)


def _run_keys(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` characters; equal runs have equal ones."""
    keys = np.zeros((len(codes), codes.shape[1] - size + 1), np.uint64)
    for k in range(size):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[:, k : k + keys.shape[1]]
    return keys


def _alike(a: np.ndarray, b: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Of pairs of texts, which can be had from one another by ``back`` deletions and ``ahead`` insertions or fewer: only that band is filled in."""
    n, m = a.shape[1], b.shape[1]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    row = [np.zeros(a.shape[1], np.int16) for _ in range(back + ahead + 1)]  # by place in b, less that in a, plus back
    for i in range(n):
        for d in range(back + ahead + 1):
            j = i + d - back
            if 0 <= j < m:
                best = row[d] + (a[i] == b[j])
                if d < back + ahead:
                    np.maximum(best, row[d + 1], out=best)
                if d:
                    np.maximum(best, row[d - 1], out=best)
                row[d] = best
            elif j >= m and d:  # b is at its end
                row[d] = row[d - 1]
    return row[m - n + back] >= n - back


def near_pairs(short: list[str], long: list[str], least: float, pairs: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of texts of one length each whose ratio is ``least`` or more, as places.

    Texts that are d steps apart share one of d + 1 pieces of the shorter, moved by no more than the insertions or deletions; a step
    changes one parity. Candidates come and go ``pairs`` at a time.
    """
    a, b = len(short[0]), len(long[0])
    far = furthest(a, b, least)
    none = np.zeros(0, np.int64)
    if far < 0:
        return none, none
    back, ahead = (far - (b - a)) // 2, (far + (b - a)) // 2
    if far >= a:
        both = [(i, j) for j, y in enumerate(long) for i, x in enumerate(short) if a + b - 2 * common(x, y) <= far]
        return tuple(np.array(both, np.int64).reshape(-1, 2).T)
    one, two = _codes(short), _codes(long)
    odd_one, odd_two = _parities(one), _parities(two)
    found, runs = [none], {}
    for start, stop in cuts(a, far + 1):
        size = stop - start
        if size not in runs:
            runs[size] = _run_keys(two, size)
        mine = _run_keys(one[:, start:stop], size)[:, 0]
        order = np.argsort(mine, kind="stable")
        mine = mine[order]
        for at in range(max(0, start - back), min(b - size, start + ahead) + 1):
            theirs = runs[size][:, at]
            first = np.searchsorted(mine, theirs)
            count = np.searchsorted(mine, theirs, "right") - first
            some = np.flatnonzero(count)
            ends = np.cumsum(count[some])
            done = 0
            while done < len(some):
                before = ends[done - 1] if done else 0
                to = max(done + 1, int(np.searchsorted(ends, before + pairs, "right")))
                part = some[done:to]
                j = np.repeat(part, count[part])
                i = order[np.arange(len(j)) + np.repeat(first[part] - (ends[done:to] - count[part] - before), count[part])]
                near = np.bitwise_count(odd_one[i] ^ odd_two[j]) <= far
                i, j = i[near], j[near]
                near = _alike(one[i], two[j], back, ahead)
                found.append(i[near] * len(long) + j[near])
                done = to
    places = np.unique(np.concatenate(found))
    return places // len(long), places % len(long)


def marks(a: Sequence[str]) -> dict[str, int]:
    """Where each element stands, as the bits of a number."""
    out: dict[str, int] = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def longest(size: int, at: dict[str, int], b: Sequence[str]) -> int:
    """``lcs`` of a sequence of that size, given by its ``marks``, with another: a row in the bits of one number."""
    full = (1 << size) - 1
    row = full
    for y in b:
        if hit := row & at.get(y, 0):
            row = (row + hit | row - hit) & full
    return size - row.bit_count()


def common(a: str, b: str) -> int:
    """``lcs`` of texts."""
    return longest(len(a), marks(a), b)


def of_like_length(text: str, known: dict[int, list[str]], least: float) -> Iterator[str]:
    """Of texts by length those whose length alone doesn't keep them from the ratio."""
    for size, texts in known.items():
        if furthest(*sorted((size, len(text))), least) >= 0:
            yield from texts


def near(a: str, b: str, least: float) -> bool:
    """Whether the ratio of two texts is ``least`` or more, as ``near_pairs`` has it."""
    return len(a) + len(b) - 2 * common(a, b) <= furthest(*sorted((len(a), len(b))), least)


def distinct_phrases(phrases: DataFrame, least: float = 92.0) -> DataFrame:
    """Phrases of a product by falling quality, without those nearly equal to a kept one.

    Near pairs are sought within a product and length: a group holds the texts of one length and the shorter ones
    that can still reach ``least``. The fold then sees only phrases that have a near one.
    """
    text = F.array_join(F.filter(F.split(F.lower("phrase"), r"\s+"), lambda w: w != ""), " ")
    # a phrase travels once a block, its text beside it only where that is another
    rows = phrases.select("product_id", "phrase", "quality", text.alias("low")).withColumn("size", F.length("low"))
    reach = (F.floor(F.col("size") * (100 + (100 - least)) / least) + 1).cast("int")
    rows = rows.withColumn("low", F.nullif("low", "phrase"))
    rows = rows.select("*", F.explode(F.sequence("size", reach)).alias("block"))

    def pairs(key, group: pd.DataFrame) -> pd.DataFrame:
        group["low"] = group["low"].fillna(group["phrase"])
        by_size = {n: g for n, g in group.groupby("size")}
        columns: dict[str, list] = {"a": [], "qa": [], "b": [], "qb": []}
        if (long := by_size.get(key[1])) is not None:
            for n, short in by_size.items():
                i, j = near_pairs(short["low"].to_list(), long["low"].to_list(), least)
                once = (i < j) | (n < key[1])
                for side, rows, at in (("a", short, i[once]), ("b", long, j[once])):
                    columns[side].extend(rows["phrase"].to_numpy(object)[at])
                    columns[f"q{side}"].extend(rows["quality"].to_numpy()[at])
        # as objects: strings of pandas' own come as chunks, which a result can't hold
        typed = {c: pd.Series(v, dtype="float64" if c[0] == "q" else object) for c, v in columns.items()}
        return pd.DataFrame({"product_id": [key[0]] * len(typed["a"]), **typed})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        near: dict[tuple[float, str], list[tuple[float, str]]] = {}
        for a, qa, b, qb in zip(group["a"], group["qa"], group["b"], group["qb"], strict=True):
            first, second = sorted([(-qa, a), (-qb, b)])
            near.setdefault(first, [])
            near.setdefault(second, []).append(first)
        kept: set[tuple[float, str]] = set()
        for one in sorted(near):
            if kept.isdisjoint(near[one]):
                kept.add(one)
        lost = [x for _, x in sorted(set(near) - kept)]
        return pd.DataFrame({"product_id": [group["product_id"].iat[0]] * len(lost), "phrase": pd.Series(lost, dtype=object)})

    product = dict(phrases.dtypes)["product_id"]
    found = rows.groupBy("product_id", "block").applyInPandas(pairs, f"product_id {product}, a string, qa double, b string, qb double")
    lost = found.groupBy("product_id").applyInPandas(fold, f"product_id {product}, phrase string")
    return phrases.join(lost, ["product_id", "phrase"], "left_anti")


def rouge_l(pairs: DataFrame, words_a: str, words_b: str) -> DataFrame:
    """Adds rouge_p, rouge_r, rouge_f of two arrays of words. Arrays travel as one text each; a text b that comes again is read once."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        split = lambda text: text.split(BETWEEN) if text else []
        known: dict[str, tuple[int, dict[str, int]]] = {}
        for ones, others in batches:
            out = []
            for one, other in zip(ones, others, strict=True):
                if other not in known:
                    if len(known) >= 1000:
                        known.clear()
                    words = split(other)
                    known[other] = len(words), marks(words)
                a, (size, at) = split(one), known[other]
                shared = longest(size, at, a)
                p, r = shared / max(len(a), 1), shared / max(size, 1)
                out.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
            yield pd.DataFrame(out, columns=["rouge_p", "rouge_r", "rouge_f"], dtype=float)

    scores = F.pandas_udf(run, "rouge_p double, rouge_r double, rouge_f double")
    found = scores(F.array_join(words_a, BETWEEN), F.array_join(words_b, BETWEEN))
    return pairs.withColumn("_rouge", found).select(*pairs.columns, "_rouge.*")


def _dice(seed: int):
    """A seeded order of reviews."""
    return F.md5(F.concat_ws(":", F.col("review_id").cast("string"), F.lit(str(seed))))


def stratified(reviews: DataFrame, size: int = 50, seed: int = 0) -> DataFrame:
    """A product's sample over rating bands: in proportion, one at least of a band that has any, topped up from the rest."""
    r = F.col("rating")
    band = F.when(r.isNull(), "none").when(r <= 2, "low").when(r < 4, "middle").otherwise("high")
    own, whole = Window.partitionBy("product_id", "band"), Window.partitionBy("product_id")
    dice = _dice(seed)
    rows = reviews.withColumn("band", band).withColumn("_in_band", F.row_number().over(own.orderBy(dice, "review_id")))
    share = F.count("*").over(own) / F.count("*").over(whole)
    rows = rows.withColumn("quota", F.greatest(F.lit(1), F.round(share * size)).cast("long"))
    first = (F.col("_in_band") > F.col("quota")).cast("int")
    rows = rows.withColumn("_n", F.row_number().over(whole.orderBy(first, "_in_band", dice, "review_id")))
    return rows.filter(F.col("_n") <= size).drop("_n", "_in_band")


def representative(reviews: DataFrame, count: int = 10, pool: int = 20, seed: int = 0) -> DataFrame:
    """``count`` of a product's ``pool`` longest reviews, by a seeded hash."""
    own = Window.partitionBy("product_id")
    rows = reviews.withColumn("_n", F.row_number().over(own.orderBy(F.desc(F.length("comment")), "review_id"))).filter(F.col("_n") <= pool)
    rows = rows.withColumn("_m", F.row_number().over(own.orderBy(_dice(seed), "review_id")))
    return rows.filter(F.col("_m") <= count).drop("_n", "_m")
