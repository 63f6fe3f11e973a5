from collections import defaultdict

import numpy as np
from helpers import documents, rows, solid

from opinspark.llm.mixing import mix, solve, take


def water(sizes, weights, limit):
    total, left, out = sum(sizes.values()), dict(sizes), {}
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest = total
    while left:
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > limit * left[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = limit * left.pop(s)
            rest -= out[s]
    return out


def test_targets_and_copies(spark):
    docs = rows(2, 400)
    got = mix(documents(spark, docs), [1, 2, 3]).collect()
    again = mix(documents(spark, docs[::-1]), [1, 2, 3]).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    source = {r[0]: r[3] for r in docs}
    words = {r[0]: len(solid(r[1])) for r in docs}
    sizes, taken, aims = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.size == words[r.doc_id] and 0 <= r.copies <= 3
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.copies * r.size
        aims[source[r.doc_id]] = r.target
    expected = water(sizes, [1, 2, 3], 3)
    for s in sizes:
        assert abs(aims[s] - expected[s]) < 1e-6 * expected[s]
        assert abs(taken[s] - aims[s]) <= 3


def test_small_source_stops_at_its_limit(spark):
    docs = [(1, "a b", "", "x", 0, 0, "", 0), (2, "c " * 300, "", "y", 0, 0, "", 0), (3, None, "", "z", 0, 0, "", 0)]
    got = {r.doc_id: r for r in mix(documents(spark, docs), [3, 1]).collect()}
    assert got[1].target == 6.0 and got[1].copies == 3 and got[3].target == 0.0
    assert mix(documents(spark, []), [1]).count() == 0


def test_rates_solve_the_dual():
    rng = np.random.default_rng(0)
    for target in (0.05, 0.5, 1.0, 1.7, 2.9):
        size, count = np.unique(rng.integers(0, 3000, 500), return_counts=True)
        rates = solve(size, count, target * float((size * count).sum()), 3.0)
        assert abs((rates * size * count).sum() / (size * count).sum() - target) < 1e-6
        free = (rates < 3) & (size > 0)
        tilt = np.log(rates[free]) / size[free]  # one tilt for the whole source
        assert np.ptp(tilt) < 1e-9


def test_words_stay_with_their_source(spark):
    kinds = "doc_id long, text string, source string, extra string, `a.b` int"
    docs = spark.createDataFrame([(1, "a b", "x", "p", 1), (1, "a b", "y", "q", 2), (1, "a b", "y", "r", 3), (1, None, "a", "s", 4), (1, "a", None, "t", 5), (None, "a", None, "u", 6)], kinds)
    mixed = mix(docs, [1])
    got = take(docs, mixed).collect()
    assert take(docs, mixed).columns == docs.columns
    planned = defaultdict(int)
    for r in mixed.collect():
        planned[r.source] += r.copies * r["size"]
    found = defaultdict(int)
    for r in got:
        found[r.source] += len(solid(r.text))
    assert {s: n for s, n in planned.items() if n} == dict(found)
    again = take(docs.repartition(3, "extra"), mixed).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert len({r.extra for r in got if r.source == "y"}) == 1
