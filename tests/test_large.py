"""Faults that only larger tables show: memory, shuffles and work that grow faster than the input."""

import time
import tracemalloc

import numpy as np

from pyspark.sql import functions as F

from opinspark.functions import text as X
from opinspark.operators import aspects as A
from opinspark.operators import evaluation as E
from opinspark.operators import folds
from opinspark.operators import keywords as K
from opinspark.operators import ngrams as N


def linked(points, threshold):
    """Average link by definition."""
    groups = [[i] for i in range(len(points))]
    apart = lambda a, b: float(np.mean([[np.linalg.norm(points[i] - points[j]) for j in b] for i in a]))
    while len(groups) > 1:
        far, i, j = min((apart(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if far > threshold:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_average_link_needs_no_matrix_of_all_pairs():
    """F9"""
    rng = np.random.default_rng(5)
    for turn in range(12):
        points = rng.normal(0, 1, (25, 2))
        points[20:] = points[:5]  # copies
        found = folds.average_link(points, 0.4 + turn / 8, block=8)
        assert {frozenset(np.flatnonzero(found == c).tolist()) for c in set(found)} == linked(points, 0.4 + turn / 8)
    points = rng.normal(0, 0.125, (2500, 64))
    tracemalloc.start()
    found = folds.average_link(points, 1.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < found.max() < 2499 and peak < 100e6


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_claims_meet_evidence_in_blocks(spark):
    """F32: no row holds all of a product's vectors; what is held is what ``cosine`` says, odd vectors included."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, rng.normal(0, 1, 8).tolist()) for i in range(240)]
    rows += [(240, 0, None), (241, 0, [None, *[1.0] * 7]), (242, 1, [float("nan"), *[1.0] * 7]), (243, 0, [1.0, 2.0]), (244, 2, [0.0] * 8), (245, None, [1.0] * 8), (246, 7, [1.0] * 8), (247, 0, rows[7][2])]
    table = spark.createDataFrame(rows, "id long, product_id long, v array<double>")
    proof = table.filter("id % 7 = 0 and (product_id > 0 or product_id is null) or id = 21")
    got = E.supported_by_vectors(table, proof, ["product_id"], "v", 0.6, parts=4)
    assert "collect_list" not in plan(got)
    pairs = table.alias("a").join(proof.select("product_id", F.col("v").alias("w")), "product_id", "left").withColumn("c", X.cosine(F.col("v"), F.col("w")))
    want = pairs.groupBy("id", "product_id").agg(F.coalesce(F.max("c") >= 0.6, F.lit(False)).alias("ok")).groupBy("product_id").agg(F.avg(F.col("ok").cast("double")).alias("s"))
    assert {(r.product_id, round(r.evidence_support, 12)) for r in got.collect()} == {(r.product_id, round(r.s, 12)) for r in want.collect()}
    assert 0 < min(r.s for r in want.collect() if r.product_id in (1, 2)) < 1


def test_nominal_chunks_of_a_long_text(spark):
    """the work is by the tokens, not by tokens times chunks."""
    kinds = ["NOUN", "VERB", "ADJ", None]
    tagged = [[(f"w{i}", kinds[(i * i + n) % 4]) for i in range(n)] for n in (0, 1, 2, 3, 7, 50)] + [[(None, "NOUN"), ("abc", "NUM"), ("x", "PROPN")], None]
    got = spark.createDataFrame([(x,) for x in tagged], "t array<struct<token:string,pos:string>>").select(X.nominal_chunks(F.col("t"), 3)).collect()
    for row, words in zip(got, tagged, strict=True):
        want, run = [], []
        for token, pos in [*(words or []), ("", "END")]:
            if pos in X.NOMINAL:
                run += [token] if token is not None else []
            else:
                want += [" ".join(run)]
                run = []
        assert row[0] == (None if words is None else [c for c in want if len(c) >= 3])
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.struct(F.lit("some").alias("token"), F.when(i % 2 == 0, "VERB").otherwise("NOUN").alias("pos"))).alias("t"))
    began = time.time()
    assert long.select(F.size(X.nominal_chunks(F.col("t"), 3))).first()[0] == 20_000
    assert time.time() - began < 5


def test_words_meet_once_and_no_product_is_sorted(spark):
    """one exchange of the places of words; segments are numbered by review, with gaps and segments without words."""
    rows = [(r, s, t) for r, s, t in [(9, 1, "Tea and tea"), (9, 4, "..."), (2, 0, "!!"), (2, 7, "Hot TEA or Tea"), (30, 0, "hot tea 2x"), (31, 0, "??"), (30, 5, "and hot Milk tea")]]
    spans = spark.createDataFrame([(r, 1, s, "comment", t, t.lower(), None, None) for r, s, t in rows], "review_id long, product_id long, span_index int, section string, span_text string, normalized string, rating double, user_id long")
    segs = N.segments(spans)
    numbered = {(r.text, r.sentence, r.all_sentences) for r in K._numbered(segs).collect()}
    assert numbered == {(t, i, 6) for i, (_, _, t) in enumerate(sorted(rows))}
    text = plan(K._scores(K._terms(segs, ("and",))))
    assert "Window" not in text  # what is left to do after the words have met is a row a word
    got = {r.word: r for r in K.term_scores(segs, ("and",)).collect()}
    assert {w: r.tf for w, r in got.items()} == {"tea": 6, "and": 2, "hot": 3, "or": 1, "2x": 1, "milk": 1}
    tfs = [r.tf for r in got.values() if not r.stop]
    often = 6 / (np.mean(tfs) + np.std(tfs))
    # tea: sentences 1, 2, 4, 5 of 6; before: and, hot, or, milk; after: and, or, 2x
    varied = (0.5 + 4 / 5) + (0.5 + 3 / 3)
    cased = max(1, 1) / (1 + np.log(6))
    assert round(got["tea"].score, 9) == round(np.log(np.log(3 + 3)) * varied / (cased + often / varied + 4 / 6 / varied), 9)


def test_runs_are_made_where_segments_stand(spark):
    """no product's or sentence's words are brought together to make runs; shorter and longer runs than three agree with them."""
    texts = ["The Battery life of the phone is great", "battery life of the screen", "Great screen, GPS and battery 4000", "of", "life of 2x"]
    spans = spark.createDataFrame([(i, 1, 0, "comment", t, t.lower(), None, None) for i, t in enumerate(texts)], "review_id long, product_id long, span_index int, section string, span_text string, normalized string, rating double, user_id long")
    segs = N.segments(spans)
    found = K.statistical_keyphrases(segs, ("the", "and", "of", "is"))
    assert "Window" not in plan(found)
    by_size = {n: {(r.phrase, r.n, round(r.raw_score, 9)) for r in K.statistical_keyphrases(segs, ("the", "and", "of", "is"), n).collect()} for n in (1, 2, 4)}
    got = {(r.phrase, r.n, round(r.raw_score, 9)) for r in found.collect()}
    for n in (1, 2):
        assert by_size[n] == {x for x in got if x[0].count(" ") < n} and by_size[n]
    assert got == {x for x in by_size[4] if x[0].count(" ") < 3} and {x[0] for x in by_size[4] - got} == {"life of the phone", "life of the screen", "screen gps and battery"}


def test_pieces_are_cut_in_their_review(spark):
    """pieces need no exchange, and a run with a stop-word in it isn't sent anywhere."""
    rows = [(1, 7, "ab", " one. two!x;three ", None, "four\nfive."), (2, 7, "", None, "...", None), (3, 8, "title", "", None, "a. bcd. " * 40)]
    reviews = spark.createDataFrame(rows, "review_id long, product_id long, title string, plus string, minus string, comment string")
    for most in (None, 30):
        got = A.review_pieces(reviews, most=most)
        assert not {"Exchange", "Window"} & set(plan(got).replace("(", " ").split())
        want = A.pieces(A.sections(reviews)) if most is None else A.spans(A.sections(reviews))
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect()) and got.count() > 30
    segs = spark.createDataFrame([(1, ["a", "the", "b", "c", "d"]), (1, ["the"]), (1, [])], "product_id long, tokens array<string>")
    runs = lambda least: sorted(r.phrase for r in N.grams(segs, least, 3, stop=("the",)).collect())
    assert runs(1) == ["a", "b", "b c", "b c d", "c", "c d", "d"] and runs(2) == ["b c", "b c d", "c d"]
