import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from opinspark.llm.mtree import LOW, Tree, matrix, top_k


def brute(rows, k):
    """Every row but the query's own is a candidate."""
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, d - len(v)))) for i, v in good]
    out = []
    for own, (q, w) in enumerate(good):
        if q is not None and q % 20 == 0:
            best = sorted((-int(v @ w), i is None, i or 0) for at, (i, v) in enumerate(good) if at != own)[:k]
            out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(best)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("point", "score", "ids", "tree", "pivot", "asked")})


def run(spark, rows, **how):
    got = top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, **how)
    return sorted(map(tuple, got.collect()), key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.4, (6, 8))
    rows = [(i, (centres[rng.integers(6)] + rng.normal(0, 0.1, 8)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # a hot vector, some of them queries
    rows += [(2000, [0.0] * 8), (2020, [float("nan")] * 8), (2040, None), (2060, [None] + [0.1] * 7), (2080, [0.5] * 3), (None, [0.1] * 8)]
    rows += [(2100, [float("inf")] * 8), (2120, [])]
    expected = brute(rows, 20)
    assert run(spark, rows, pivots=5, tree_rows=100, page=16, block=20) == expected
    assert run(spark, rows) == expected
    assert len(expected) > 800


def test_repeated_rows_and_null_ids(spark):
    rows = [(20, [1.0, 0.5]), (1, [1.0, 0.25]), (1, [1.0, 0.25]), (2, [0.5, 0.5]), (None, [2.0, 2.0]), (None, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.0, 0.1])]
    expected = brute(rows, 20)
    assert len(expected) == 21
    assert run(spark, rows) == expected
    hot = [(20, [1.0])] * 30 + [(3, [1.0])] * 30 + [(None, [1.0])] * 5
    assert run(spark, hot, k=7) == brute(hot, 7)


def test_few_rows(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.25])]) == [(0, 1, 1, 64 * 32 + 128 * 16)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == [] and run(spark, [(0, None)]) == []
    assert run(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]


def test_large_components(spark):
    rows = [(i, [float(2**30 + i), float(i)]) for i in range(40)]
    assert run(spark, rows) == brute(rows, 20)


def best_of(scores, k):
    return sorted(((-int(s), i) for i, s in enumerate(scores)))[:k]


def test_tree_prunes():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 1, (4000, 3)) * 40).astype(np.int64)
    tree = Tree(x, float((x * x).sum(1).max()), np.arange(4000), page=32)
    asks = x[:50]
    (ask, row), score, computed = tree.search(asks, 10)
    for i, q in enumerate(asks):
        assert sorted(zip((-score[ask == i]).tolist(), row[ask == i].tolist(), strict=True)) == best_of(x @ q, 10)
    assert computed.mean() < len(x) / 3  # in three dimensions; in 64 random ones nothing can be pruned


def test_known_scores_bound_the_search():
    rng = np.random.default_rng(2)
    x = rng.integers(-20, 20, (1000, 4))
    tree = Tree(x, float((x * x).sum(1).max()), np.arange(1000))
    known = np.array([best_of(x @ q, 5)[-1][0] * -1 for q in x[:20]])
    (ask, row), score, computed = tree.search(x[:20], 10, known)
    assert (score >= known[ask]).all() and all((ask == i).sum() >= 5 for i in range(20))
    assert (tree.search(x[:20], 10, np.full(20, LOW))[2] >= computed).all()


def test_matrix_pads():
    assert matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), 2).tolist() == [[1, 2], [0, 0], [3, 0]]
