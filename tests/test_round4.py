"""Faults that readers of the fourth round found."""

import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from opinspark.functions.vectors import hashed_trigrams
from opinspark.operators import folds
from opinspark.operators import keywords as K
from opinspark.plans import judging
from opinspark.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def test_rouge_of_long_texts_takes_no_table_of_all_places(spark):
    dice = random.Random(4)
    draw = lambda n: [f"w{dice.randrange(60)}" for _ in range(n)]
    few = [(i, draw(dice.randrange(9)), draw(dice.randrange(9))) for i in range(200)] + [(200, [], []), (201, ["a"], [])]
    got = folds.rouge_l(spark.createDataFrame(few, "id long, a array<string>, b array<string>"), "a", "b").collect()
    assert len(got) == len(few)
    for r in got:
        n = folds.lcs(r.a, r.b)
        p, q = n / max(len(r.a), 1), n / max(len(r.b), 1)
        assert (r.rouge_p, r.rouge_r, r.rouge_f) == (p, q, 2 * p * q / (p + q) if p + q else 0.0)
    a, b = draw(20_000), draw(20_000)
    began = time.time()
    row = folds.rouge_l(spark.createDataFrame([(1, a, b)], "id long, a array<string>, b array<string>"), "a", "b").first()
    assert row.rouge_p > 0 and time.time() - began < 20  # a table of 4e8 places takes minutes


def test_systems_are_compared_from_one_reading(spark):
    plan = judging._long(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    assert {r.metric for r in QUERIES["metric_chart"](spark, DATA).collect()} == {"coverage", "overall", "specificity"}


def test_turns_of_a_small_file_are_dealt_out(spark):
    assert judging.external(spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_best_keyphrases_come_from_as_many_phrases_as_it_takes(spark):
    dice = random.Random(5)
    words = ["battery", "batteries", "screens", "screen", "speakers", "camera", "cameras", "charger", "display", "displays"]
    texts = sorted({" ".join(dice.sample(words, 3)) + "s" * dice.randrange(3) for _ in range(400)})
    rows = [(p, t, dice.choice([0.1, 0.1 + 1e-12, 0.2, dice.random()])) for p in (1, 2) for t in texts] + [(3, "one phrase", 0.5)]
    found = spark.createDataFrame(rows, "product_id long, phrase string, raw_score double")
    stay = folds.distinct_phrases(found.withColumn("quality", -F.col("raw_score")), 90.0).select("product_id", "phrase")
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy(F.round("raw_score", 9), "phrase"))
    want = found.join(stay, ["product_id", "phrase"]).withColumn("rank", rank).filter("rank <= 12").collect()
    for first in (2, 40, 2000):
        got = K.best_keyphrases(found, 12, 90.0, first)
        assert got.columns == ["product_id", "phrase", "raw_score", "rank"]
        assert sorted(got.collect()) == sorted(want)


def test_keyphrase_union_reads_all_segments(spark):
    names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(1, (i, 0), f"word{n} thing{n}", [f"word{n}", f"thing{n}"]) for i, n in enumerate(names)]
    segs = spark.createDataFrame(rows, "product_id long, seq struct<review_id:long,span_index:int>, text string, tokens array<string>")
    count = lambda most: K.near_keyphrases(segs, hashed_trigrams(), segments=most).select("seq").distinct().count()
    assert (count(None), count(200)) == (300, 200)
    assert "<= 200" not in SQL["keyphrase_union"] and "<= 200" in SQL["near_keyphrases"]
