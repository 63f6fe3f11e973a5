"""Topics: density clusters of vectors by key, with labels by class-based TF-IDF.

Clusters come from the tree of mutual reachability: of two points the largest of their distance and both core distances. Its
minimum spanning tree is grown by Boruvka rounds (each component's nearest foreign point, a block of points at a time, so that no
matrix of all distances stands in memory), cut from the longest edge down into a tree of clusters that keep ``least`` points or
more, and of that tree the clusters with the most excess of mass are taken; what is in none is noise, -1.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

BLOCK = 512


def _distances(points: np.ndarray, part: slice) -> np.ndarray:
    square = (points**2).sum(1)
    found = np.sqrt(np.maximum(square[part, None] + square[None] - 2 * points[part] @ points.T, 0))
    found[np.arange(found.shape[0]), np.arange(part.start, part.start + found.shape[0])] = 0
    return found


def _parts(n: int) -> list[slice]:
    return [slice(i, min(i + BLOCK, n)) for i in range(0, n, BLOCK)]


def spanning_tree(points: np.ndarray, least: int) -> list[tuple[float, int, int]]:
    """Edges (length, a, b) of the minimum spanning tree of mutual reachability, ties by numbers. Core: the ``least``-th neighbour."""
    n = len(points)
    near = min(n - 1, least)
    core = np.concatenate([np.partition(_distances(points, p), near, axis=1)[:, near] for p in _parts(n)])
    group, edges = np.arange(n), []
    while len(np.unique(group)) > 1:
        best: dict[int, tuple[float, int, int]] = {}
        for p in _parts(n):
            reach = np.maximum(np.maximum(_distances(points, p), core[p, None]), core[None])
            reach[group[p, None] == group[None]] = np.inf
            to = reach.argmin(1)
            for row, j in enumerate(to.tolist()):
                i = p.start + row
                edge = (float(reach[row, j]), min(i, j), max(i, j))
                home = int(group[i])
                best[home] = min(best.get(home, edge), edge)
        for edge in sorted(set(best.values())):
            a, b = group[edge[1]], group[edge[2]]
            if a != b:
                edges.append(edge)
                group[group == b] = a
    return sorted(edges)


def density(points: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of each point (-1: noise; else by first point) and how firmly it belongs there, from 0 to 1. No cluster holds all points."""
    n = len(points)
    if n < 2:
        return np.full(n, -1), np.zeros(n)
    # merges from the shortest edges up, those of one length at once; node numbers from n on are merges
    home, members, tree = list(range(n)), {i: [i] for i in range(n)}, {}
    for length, edges in groupby(spanning_tree(points, least), key=lambda e: e[0]):
        joined: dict[int, set[int]] = {}
        for _, a, b in edges:
            together = joined.pop(home[a], {home[a]}) | joined.pop(home[b], {home[b]})
            joined |= dict.fromkeys(together, together)
        for children in {id(c): c for c in joined.values()}.values():
            node = n + len(tree)
            tree[node] = (length, sorted(children))
            members[node] = [i for c in sorted(children) for i in members[c]]
            for i in members[node]:
                home[i] = node
    # clusters from the root down: (birth, parent); a point leaves its cluster at a density (one over the length of the cut)
    dense = lambda length: 1 / length if length > 0 else np.inf
    births, parents, left_at = [0.0], [-1], [{}]
    walk = [(n + len(tree) - 1, 0)]
    while walk:
        node, cluster = walk.pop()
        if node < n:
            left_at[cluster][node] = left_at[cluster].get(node, np.inf)
            continue
        length, children = tree[node]
        large = [c for c in children if len(members[c]) >= least]
        for c in children:
            if c in large and len(large) > 1:
                births.append(dense(length))
                parents.append(cluster)
                left_at.append({})
                left_at[cluster].update(dict.fromkeys(members[c], dense(length)))
                walk.append((c, len(births) - 1))
            elif c in large:
                walk.append((c, cluster))
            else:
                left_at[cluster].update(dict.fromkeys(members[c], dense(length)))
    finite = lambda x: min(x, 1e300)
    mass = [sum(finite(at) - finite(born) for at in gone.values()) for gone, born in zip(left_at, births, strict=True)]
    taken = [False] * len(births)
    for c in range(len(births) - 1, 0, -1):  # children come after their parents
        below = [k for k in range(c + 1, len(births)) if parents[k] == c]
        inner = sum(mass[k] for k in below)
        if below and inner > mass[c]:
            mass[c] = inner
        else:
            taken[c] = True
            fall = list(below)
            while fall:
                k = fall.pop()
                taken[k] = False
                fall += [x for x in range(k + 1, len(births)) if parents[x] == k]
    label, firm = np.full(n, -1), np.zeros(n)
    for c in range(1, len(births)):
        if taken[c]:
            top = max(finite(at) for at in left_at[c].values())
            # points that went on into a cluster inside this one stay until that one loses them
            last = dict(left_at[c])
            fall = [k for k in range(c + 1, len(births)) if parents[k] == c]
            while fall:
                k = fall.pop()
                last.update(left_at[k])
                fall += [x for x in range(k + 1, len(births)) if parents[x] == k]
            for i, at in last.items():
                label[i], firm[i] = c, min(finite(at), top) / top if top > 0 else 1.0
    order = {c: k for k, c in enumerate(dict.fromkeys(label[label >= 0].tolist()))}
    return np.array([order.get(c, -1) for c in label.tolist()]), firm


def density_clusters(rows: DataFrame, key: str, item: str, vector: str, least: int = 3) -> DataFrame:
    """``key, item, topic, confidence``. A key's items are a profile's best phrases, some hundreds: work is by their square, memory isn't.

    Equal vectors are equally dense; a null vector is noise; fewer than two items have no cluster.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(item, kind="stable").reset_index(drop=True)
        some = group[vector].notna().to_numpy()
        topic, firm = np.full(len(group), -1), np.zeros(len(group))
        if some.any():
            topic[some], firm[some] = density(np.stack(group.loc[some, vector].to_list()).astype(float), least)
        return pd.DataFrame({key: group[key], item: group[item], "topic": topic.astype("int64"), "confidence": firm})

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {item} {kinds[item]}, topic long, confidence double")


def class_words(topics: DataFrame, key: str, item: str, most: int = 10) -> DataFrame:
    """``key, topic, rank, word, weight``: a topic's words by class-based TF-IDF, ties by word; noise has none.

    A word weighs its count in the topic, over all words there, times log(1 + mean words a topic / its count in all topics of the key).
    """
    words = topics.filter("topic >= 0").select(key, "topic", F.explode(X.tokens(F.col(item))).alias("word"))
    counted = words.groupBy(key, "topic", "word").agg(F.count("*").alias("n"))
    topic, everywhere, own = Window.partitionBy(key, "topic"), Window.partitionBy(key, "word"), Window.partitionBy(key)
    sizes = counted.groupBy(key, "topic").agg(F.sum("n").alias("size")).withColumn("mean", F.avg("size").over(own))
    weight = F.col("n") / F.col("size") * F.log1p(F.col("mean") / F.sum("n").over(everywhere))
    weighed = counted.join(sizes, [key, "topic"]).withColumn("weight", weight)
    rank = F.row_number().over(topic.orderBy(F.desc(F.round("weight", 9)), "word"))
    return weighed.withColumn("rank", rank).filter(F.col("rank") <= most).select(key, "topic", "rank", "word", "weight")


def topics(phrases: DataFrame, key: str = "product_id", most: int = 300, shown: int = 12, small: int = 20) -> DataFrame:
    """A row a topic: ``label`` (its best phrase), ``keywords``, phrases by sentiment, how many, how firm.

    ``phrases`` (key, phrase, rank, weak, vector): the first ``most`` of a key count. A key of fewer than ``small`` phrases has too little for
    density: there average link at cosine distance 1 groups them (its topics: confidence one half).
    """
    from . import folds

    rows = phrases.filter(F.col("rank") <= most)
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    dense = density_clusters(rows.filter(F.col("_n") >= small), key, "phrase", "vector")
    linked = folds.semantic_clusters(rows.filter((F.col("_n") < small) & F.col("vector").isNotNull()), key, "phrase", "vector", 1.0, cosine=True)
    found = dense.unionByName(linked.select(key, "phrase", F.col("cluster").alias("topic"), F.lit(0.5).alias("confidence")))
    by_rank = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("rank", "phrase")))), lambda x: x["phrase"])
    of = lambda *weak: F.slice(by_rank(F.col("weak").isin(*weak)), 1, 8)
    listed = by_rank(F.lit(True))
    neutral = F.slice(by_rank(~F.coalesce(F.col("weak").isin("positive", "negative"), F.lit(False))), 1, 8)
    return (
        found.filter("topic >= 0")
        .join(rows.select(key, "phrase", "rank", "weak"), [key, "phrase"])
        .groupBy(key, "topic")
        .agg(
            F.left(F.min_by("phrase", "rank"), F.lit(80)).alias("label"), F.slice(listed, 1, shown).alias("keywords"), F.slice(listed, 1, 8).alias("representative"),
            of("positive").alias("positive"), of("negative").alias("negative"), neutral.alias("neutral"), F.count("*").alias("phrases"), F.avg("confidence").alias("confidence"),
        )
    )
