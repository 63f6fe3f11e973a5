"""Topics, keyphrase sources, embedding metrics and evaluation runs: brute force, awkward rows, and runs that break off."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinspark.functions.vectors import embedded, hashed_trigrams
from opinspark.operators import evaluation as E
from opinspark.operators import keywords as K
from opinspark.operators import runs as R
from opinspark.operators import topics as T
from opinspark.operators.ngrams import segments

MODEL = hashed_trigrams()


def reach_of(points, least):
    n = len(points)
    far = [[float(np.sqrt(((a - b) ** 2).sum())) for b in points] for a in points]
    core = [sorted(row)[min(n - 1, least)] for row in far]
    return [[max(far[i][j], core[i], core[j]) if i != j else 0.0 for j in range(n)] for i in range(n)]


def brute(points, least):
    """Clusters by definition: components of ever sparser graphs, from all points down."""
    reach = reach_of(points, least)
    n = len(points)

    def components(some, below):
        left, out = set(some), []
        while left:
            group, fresh = set(), {min(left)}
            while fresh:
                group |= fresh
                fresh = {j for i in fresh for j in left - group if reach[i][j] < below}
            left -= group
            out.append(frozenset(group))
        return out

    def solve(some, birth, root=False):
        """Mass of the best choice of clusters in ``some``, born at a density, and that choice."""
        gone, own, chosen, mass = set(), 0.0, [], 0.0
        live = frozenset(some)
        for cut in sorted({reach[i][j] for i in some for j in some if i != j}, reverse=True):
            parts = [c for c in components(live, cut)]
            large = [c for c in parts if len(c) >= least]
            dropped = [i for c in parts if len(c) < least for i in c]
            own += sum(1 / cut - birth for _ in dropped)
            gone |= set(dropped)
            if len(large) > 1:
                own += sum((1 / cut - birth) * len(c) for c in large)
                for c in large:
                    m, picks = solve(c, 1 / cut)
                    mass, chosen = mass + m, chosen + picks
                break
            if not large:
                break
            live = large[0]
        if root or (chosen and mass > own):
            return mass, chosen
        return own, [frozenset(some)]

    label = np.full(n, -1)
    for k, c in enumerate(sorted(solve(range(n), 0.0, True)[1], key=min)):
        label[list(c)] = k
    return label.tolist()


def test_density_is_that_of_the_definition():
    rng = np.random.default_rng(8)
    sizes = set()
    for turn in range(25):
        centers = rng.normal(0, 5, (int(rng.integers(1, 5)), 2))
        points = np.concatenate([c + rng.normal(0, rng.uniform(0.1, 1.5), (int(rng.integers(2, 12)), 2)) for c in centers] + [rng.normal(0, 8, (3, 2))])
        label, firm = T.density(points, 3)
        assert label.tolist() == brute(points, 3), turn
        assert ((firm >= 0) & (firm <= 1)).all() and (firm[label < 0] == 0).all()
        sizes.add(label.max())
    assert len(sizes) > 2


def test_blocks_give_the_same_tree(monkeypatch):
    points = np.random.default_rng(2).normal(0, 1, (70, 4))
    whole = T.spanning_tree(points, 3)
    monkeypatch.setattr(T, "BLOCK", 9)
    assert np.allclose([e[0] for e in T.spanning_tree(points, 3)], [e[0] for e in whole]) and len(whole) == 69


def test_topics_of_odd_rows(spark):
    rows = [(1, f"{w} {i}", i, "positive" if i % 2 else None, [float(x) + (i % 7) / 100, 0.0]) for i, (w, x) in enumerate([("good", 1), ("bad", 9)] * 15)]
    rows += [(1, "void", 99, "mixed", None), (2, "solo", 1, "negative", [1.0, 2.0]), (3, "same", 1, "x", [1.0, 1.0]), (3, "same two", 2, "x", [1.0, 1.0])]
    phrases = spark.createDataFrame(rows, "product_id long, phrase string, rank long, weak string, vector array<double>")
    got = {(r.product_id, r.topic): r for r in T.topics(phrases).collect()}
    assert {k: r.phrases for k, r in got.items()} == {(1, 0): 15, (1, 1): 15, (2, 0): 1, (3, 0): 2}
    assert got[1, 1].label == "good 0" and got[1, 0].keywords[0] == "bad 1" and len(got[1, 0].keywords) == 12 and got[3, 0].confidence == 0.5
    words = T.class_words(T.density_clusters(phrases.filter("product_id = 1"), "product_id", "phrase", "vector"), "product_id", "phrase", 1)
    assert {(r.topic, r.word) for r in words.collect()} == {(0, "bad"), (1, "good")}
    assert T.topics(phrases.limit(0)).collect() == []


def test_statistical_keyphrases_of_few_words(spark):
    texts = ["The Battery life of the phone is great", "battery life", "Great screen, GPS and battery 4000", "", "screen of glass"]
    reviews = spark.createDataFrame([(i, None, None) for i in range(len(texts))], "review_id long, user_id long, rating double")
    spans = spark.createDataFrame([(i, 1, 0, "comment", t, t.lower()) for i, t in enumerate(texts)], "review_id long, product_id long, span_index long, section string, span_text string, normalized string")
    segs = segments(spans, reviews)
    found = K.statistical_keyphrases(segs, ("the", "and", "of", "is"))
    got = {r.phrase: r for r in found.collect()}
    assert got["battery life"].n == 2 and "the battery" not in got and "battery 4000" not in got and "screen of glass" in got
    best = [r.phrase for r in K.best_keyphrases(found).orderBy("rank").collect()]
    assert best[0] in got and len(best) <= len(got)
    assert K.statistical_keyphrases(segs.limit(0), ()).collect() == []


def test_embedding_metrics_of_odd_texts(spark):
    rows = [(1, "big red car", "big red car"), (2, "big", "a big red car"), (3, "", "x"), (4, None, "x"), (5, "x", None), (6, "...", "x"), (7, "red big car car", "car red big")]
    pairs = spark.createDataFrame(rows, "id long, flat string, reference string")
    got = {r.id: (r.precision, r.recall, r.f1) for r in E.token_alignment(pairs, MODEL).collect()}
    assert got[1] == pytest.approx((1, 1, 1)) and got[7] == pytest.approx((1, 1, 1)) and got[2][0] == pytest.approx(1) and got[2][1] < 1
    assert all(got[i] == (None, None, None) for i in (3, 4, 5, 6))
    near = {r.id: r.embedding_cosine_reference for r in E.reference_cosine(pairs, MODEL).collect()}
    assert near[1] == pytest.approx(1) and near[3] is None and near[4] is None and near[5] is None and near[6] == 0
    assert E.token_alignment(pairs.limit(0), MODEL).count() == 0 == E.reference_cosine(pairs.limit(0), MODEL).count()


def test_a_task_makes_one_model(spark):
    def factory():
        made = np.random.default_rng().random()
        return lambda texts: np.full((len(texts), 1), made)

    rows = embedded(spark.range(50).coalesce(1).select(F.col("id").cast("string").alias("t")), "t", factory, batch=7).collect()
    assert len({r.vector[0] for r in rows}) == 1 and len(rows) == 50


def test_a_run_goes_on_where_it_broke_off(spark, tmp_path):
    names = "review_id long, product_id long, span_index long, aspect string, sentiment string, span_text string, section string, confidence double"
    mentions = spark.createDataFrame([(i, i % 4, 0, "screen" if i % 2 else "sound", "positive", f"the screen {i}", "comment", 0.7) for i in range(24)], names)
    mentions = mentions.withColumn("name", F.col("aspect"))
    products = mentions.select("product_id").distinct().unionByName(spark.createDataFrame([(9,)], "product_id long"))
    book = E.ledger(mentions).filter("product_id = 0")
    kinds = "product_id long, text_overall string, text_pros string, text_cons string, text_neutral string"
    theirs = spark.createDataFrame([(i, "good screen", None, None, None) for i in range(3)], kinds)
    ours = spark.createDataFrame([(i, f"screen is good {i}", None, None, None, None if i else "broke") for i in range(4)], kinds + ", error string")
    of = lambda ids: mentions.join(ids, "product_id", "left_semi")

    def go(summarize, **how):
        return R.evaluation_run(spark, str(tmp_path / "run"), products, of, summarize, theirs, lambda p: '{"overall_preference": 12, "winner": "A"}', ledgers=book, **how)

    def broken(ids):
        raise OSError("midway")

    with pytest.raises(OSError):
        go(broken)
    assert R.Run(spark, str(tmp_path / "run")).has("ledgers") and not R.Run(spark, str(tmp_path / "run")).has("summaries")
    done = go(lambda ids: ours)
    assert {(r.product_id, r.reused) for r in done["ledgers"].select("product_id", "reused").distinct().collect()} == {(0, True), (1, False), (2, False), (3, False)}
    errors = {r.product_id: r.error for r in done["results"].filter("error is not null").collect()}
    assert errors == {0: "broke", 9: "no summary"}
    assert {r.overall_preference for r in done["rubric"].collect()} == {10.0} and done["rubric"].count() == 6
    assert {(r.product_id, r.winner) for r in done["votes"].collect()} == {(1, "tie"), (2, "tie")}
    tree = {r.product_id: r for r in done["tree"].collect()}
    assert len(tree) == 5 and [s.system for s in tree[1].systems] == ["external", "ours"] and len(tree[1].systems[0].metrics) == 9 and tree[9].systems[0].error == "no summary"
    again = go(broken)  # all stages are there: nothing is made
    assert again["results"].count() == done["results"].count()
