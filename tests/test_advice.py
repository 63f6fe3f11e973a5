"""Whole jobs: what an earlier version cut away."""

import json
import random

from pyspark.sql import functions as F

from opinspark.operators import folds
from opinspark.operators import summaries as M
from opinspark.plans import profiles as P
from opinspark.plans import queries as Q
from opinspark.sources.adapter import reviews
from opinspark.streaming import jobs as J


def test_forced_jobs_of_a_stream_pass_by(spark, tmp_path):
    src, stored = str(tmp_path / "src"), str(tmp_path / "stored")
    (tmp_path / "src").mkdir()
    jobs = [{"job_type": "product", "product_id": 1, "force": f, "attempt": n, "enqueued_at": f"2024-01-01T00:0{n}:00Z"} for n, f in enumerate((False, True, False, True))]
    (tmp_path / "src/a.json").write_text("\n".join(json.dumps({"payload": json.dumps(j)}) for j in jobs))
    run = J.rebuild_batch(lambda b: b, lambda b, n: b.write.mode("append").parquet(stored), lambda b, n: None, lambda b, n: None)
    J.start_worker(J.deduplicated(J.job_stream(spark, src)), run, str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(stored).collect()
    assert sorted(r.attempt for r in got if r.force) == [1, 3]
    assert sum(not r.force for r in got) == 1


def tables(spark, path, texts):
    rows = [(i, t, "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_segments_hold_whole_texts(spark, tmp_path):
    d = tables(spark, tmp_path, [". ".join(f"piece number{i}" for i in range(40)) + ". rare pair. rare pair"])
    segs = P.segments(spark, d)
    assert segs.count() == 42 and segs.agg(F.max("span_index")).first()[0] == 41
    assert P.phrase_bank(spark, d).filter("phrase = 'rare pair'").count() == 1
    assert Q.spans_capped(spark, d).count() == 30


def test_near_phrases_fall_over_the_whole_bank(spark):
    rng = random.Random(3)
    roots = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 45))).strip() or "x" for _ in range(60)]
    rows = {}
    for _ in range(900):
        word = list(rng.choice(roots))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        rows["".join(word) or "y"] = rng.randint(1, 9) / 10
    kept = []
    for phrase, quality in sorted(rows.items(), key=lambda x: (-x[1], x[0])):
        if all(folds.ratio(" ".join(phrase.split()), " ".join(k.split())) < 92 for k in kept):
            kept.append(phrase)
    bank = spark.createDataFrame([(1, p, q) for p, q in rows.items()], "product_id long, phrase string, quality double")
    assert sorted(r.phrase for r in folds.distinct_phrases(bank).collect()) == sorted(kept)
    assert len(kept) < len(rows)


def test_dedupe_returns_phrases_past_rank_200(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(500)]
    d = tables(spark, tmp_path, [" ".join(words)] + ["other"] * 49 + [" ".join(words)])
    assert P.phrase_dedupe(spark, d).count() > 900


def test_prefixes_of_rare_phrases(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxy") for _ in range(9)) for _ in range(1200)] + ["zz", "zebra"]
    d = tables(spark, tmp_path, [" ".join(words)] + ["other"] * 49 + [" ".join(words)])
    assert P.phrase_bank(spark, d).count() == 2000
    got = {r.text for r in P.prefix_index(spark, d).filter("prefix = 'zebra'").collect()}
    assert "zz zebra" in got


def test_llm_counts_80_phrases_when_nothing_is_filtered(spark, tmp_path):
    d = tables(spark, tmp_path, [" ".join(f"word{i}" for i in range(100))])

    def model(prompt):
        name, *parts = prompt.split("\t")
        if name != "generate":
            raise RuntimeError("no answer")
        return json.dumps({"general": str(len(json.loads(parts[0])))})

    row = M.llm(reviews(spark, d), model).first()
    assert row.texts.general == "80" and {p.sentiment for p in row.phrases} == {"neutral"}


def test_near_equal_labels_are_one_aspect(spark):
    schema = "review_id long, product_id long, rating double, title string, plus string, minus string, comment string"
    rows = spark.createDataFrame([(1, 1, 5.0, None, "дисплей", None, None), (2, 1, 5.0, None, "дисплеи", None, None)], schema)
    got = M.summarize("aspect_evidence", rows)["clusters"].collect()
    assert [(r.total, r.aliases) for r in got] == [(2, 2)]


def test_partial_ratio_against_all_pieces():
    rng = random.Random(5)
    for _ in range(800):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randint(0, 14))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        every = max((folds.ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)), default=0.0) if short else 0.0
        assert abs(folds.partial_ratio(a, b) - every) < 1e-9
        for least in (50, 72, 85):
            assert abs(folds.partial_ratio(a, b, least) - (every if every >= least else 0.0)) < 1e-9
