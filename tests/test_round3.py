"""Faults that readers of the third round found."""

import random
import time

from opinspark.operators import aspects as A
from opinspark.operators import folds
from opinspark.operators import ngrams as N
from opinspark.operators import suggest as S
from opinspark.plans.registry import QUERIES

SEGMENTS = "product_id long, user_id long, seq struct<review_id:long,span_index:int>, field string, weak string, rating double, tokens array<string>"
DATA = "/root/testdata/sf0.001"

CANDIDATE = "request_id long, field string, rating double, before string, source string, text string, insert_text string, mode string, weak string, prefix double, ngram double, aspect double, mood double, frequency double, style double, quality double, place int"


def test_scores_that_differ_in_the_last_bits_are_ties(spark):
    rows = [(1, "title", None, "", "prefix", "le la", "le la", "append", "neutral", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.5, 0)]
    rows += [(1, "title", None, "", "ngram", "la", "la", "append", "neutral", 0.0, 1.0, 0.0, 0.5, 0.5 + 2e-15, 0.0, 0.5, 1)]
    got = S.rank(spark.createDataFrame(rows, CANDIDATE)).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.rank)] == ["prefix", "ngram"]


def test_every_fifth_product_fails_to_build(spark):
    found = QUERIES["rebuilt_profiles"](spark, DATA).collect()
    assert {r.product_id for r in found if r.kind != "built"} == set(range(0, 50, 5))
    assert {(r.kind, r.attempt) for r in found if r.product_id % 10 == 5} == {("retry", 1)}


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_phrases_are_counted_in_hash_tables_after_one_exchange(spark):
    segs = spark.createDataFrame([(1, 1, (9 * 10**18, 3), "plus", "positive", 5.0, ["a", "bcd", "a", "bcd"]), (1, 1, (9 * 10**18 + 1, 0), "comment", None, None, ["a", "bcd"])], SEGMENTS)
    bank, keys = N.phrase_bank(segs), N.keyphrases(segs, stop=("a",))
    for rows in (bank, keys):
        assert "SortAggregate" not in plan(rows)
    assert plan(bank).count("Exchange") == 1
    assert [(r.phrase, r.n, r.field, r.weak, r.rating_avg) for r in bank.collect()] == [("a bcd", 3, "comment", None, 5.0)]
    assert [(r.phrase, r.n, r.field, r.weak) for r in keys.collect()] == [("bcd", 3, "plus", "positive")]


def test_continuations_meet_by_one_exchange(spark):
    segs = spark.createDataFrame([(1, 1, (9 * 10**18, 0), "minus", "negative", 1.0, ["a", "b", "c"]), (1, 1, (-5, 2), "comment", None, None, ["b", "d", "b", "c"])], SEGMENTS)
    rows = N.continuations(segs)
    assert "SortAggregate" not in plan(rows) and plan(rows).count("Exchange") == 1
    whole = {(r.context, r.rank, r.next, r.n, r.weak) for r in rows.collect()}
    assert {x for x in whole if x[0] == "b"} == {("b", 1, "d", 1, None), ("b", 2, "c", 2, None)}
    asked = spark.createDataFrame([(1, "b"), (1, "b"), (1, "a b"), (1, "c b"), (2, "b")], "product_id long, context string")
    some = N.continuations(segs, asked=asked).collect()
    assert {(r.context, r.rank, r.next, r.n, r.weak) for r in some} == {x for x in whole if x[0] in ("b", "a b")} and len(some) == 3


def test_only_the_first_candidates_of_a_task_go_to_their_product(spark):
    words = [(1, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(4)] + [(1, "often said often")]
    rows = A.candidates(spark.createDataFrame(words, "product_id long, normalized string"))
    assert plan(rows).count("WindowGroupLimit") == 4  # in the task and after the exchange, of each kind and of all
    got = {r.candidate: r.n for r in rows.collect()}
    assert len(got) == 120 and got["often"] == 3


def test_a_task_keeps_the_first_phrases_of_an_aspect(spark):
    keys = spark.createDataFrame([(1, "tea", 3), (1, "cup", 2)], "product_id long, phrase string, n long")
    clusters = spark.createDataFrame([(1, "tea", "tea"), (1, "cup", "cup")], "product_id long, label string, name string")
    bank = spark.createDataFrame([(1, f"tea {i}", i / 20, ("positive", "mixed", None)[i % 3]) for i in range(20)], "product_id long, phrase string, quality double, weak string")
    rows = N.discover_aspects(keys, clusters, bank, phrases=2)
    assert "kind" in plan(rows).split("WindowGroupLimit [product_id", 1)[1]  # by kind, before the exchange
    got = {r.label: (r.representative, r.positive, r.negative) for r in rows.collect()}
    assert got == {"tea": (["tea 19", "tea 18"], ["tea 18", "tea 15"], []), "cup": ([], [], [])}


def test_near_pairs_equal_brute_force_and_share_a_frequent_piece_quickly():
    """candidates that share a frequent piece are sifted in columns, not one by one."""
    rng = random.Random(3)
    for size, more, least, letters in ((6, 0, 80.0, "abc"), (12, 1, 90.0, "abé日"), (25, 2, 92.0, "ab "), (2, 1, 60.0, "ab"), (70, 0, 97.0, "ab")):
        short = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(12)]
        long = ["".join(rng.choice(letters) for _ in range(size + more)) for _ in range(12)]
        long += ["".join(["ab"[rng.random() < 0.5], *x[1:], *"a" * more]) for x in short]
        i, j = folds.near_pairs(short, long, least, pairs=30)
        near = [(a, b) for a, x in enumerate(short) for b, y in enumerate(long) if folds.ratio(x, y) >= least - 1e-9]
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == near
    texts = sorted({"".join(rng.choice("abcdefgh") for _ in range(10)) + " frequent" for _ in range(3000)})
    began = time.process_time()
    i, j = folds.near_pairs(texts, texts, 92.0)
    assert time.process_time() - began < 10 and len(i) >= len(texts)


def test_entries_meet_once_before_they_are_taken_apart(spark):
    """entries are exchanged whole, and of equal ones only the first go on."""
    rows = [(k, f"cup w{i}", (i % 7) / 10, "mixed") for k in (1, 2) for i in range(60)] + [(1, "cup", 0.9, None), (1, "é" * 45 + " b", 0.1, None), (1, "é" * 44 + " a", 0.2, None)]
    index = N.prefix_index(spark.createDataFrame(rows, "product_id long, phrase string, quality double, weak string"))
    assert plan(index).count("Exchange") == 1 and "home#" in plan(index).split("Exchange", 1)[1].split("\n", 1)[0]
    want = {}
    for product, phrase, quality, _ in rows:
        for entry in {phrase, *(w for w in phrase.split(" ") if len(w) >= 3)}:
            for n in range(2, min(40, len(entry)) + 1):
                want.setdefault((product, entry[:n]), []).append((-quality, phrase, entry))
    want = {(*key, k, phrase, entry) for key, found in want.items() for k, (_, phrase, entry) in enumerate(sorted(found)[:20], 1)}
    assert {(r.product_id, r.prefix, r.rank, r.text, r.insert_text) for r in index.collect()} == want
