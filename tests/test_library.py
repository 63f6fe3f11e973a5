"""Operators one by one, on small literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from opinspark.functions import text as X
from opinspark.operators import aspects as A
from opinspark.operators import catalogue as C
from opinspark.operators import evaluation as E
from opinspark.operators import folds
from opinspark.operators import ngrams as N
from opinspark.operators import suggest as S
from opinspark.operators import summaries as M
from opinspark.sources import benchmark as B
from opinspark.streaming import jobs as J

REVIEW = "review_id long, product_id long, user_id long, source string, rating double, title string, plus string, minus string, comment string, review_date timestamp, created_at timestamp"


def reviews(spark, rows):
    base = dict(user_id=1, source="wb", rating=5.0, title="", plus=None, minus=None, comment=None, review_date=None, created_at=None)
    names = [c.split()[0] for c in REVIEW.split(", ")]
    return spark.createDataFrame([tuple({**base, "product_id": 1, **r}[n] for n in names) for r in rows], REVIEW)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_lexicon_sentiment(spark):
    mood = lambda t: tuple(one(spark, X.sentiment(F.lit(t))))
    assert mood("Отличный экран") == ("positive", pytest.approx(0.6))
    assert mood("ужасно шумный") == ("negative", pytest.approx(-0.7))
    assert mood("неудобно") == ("mixed", 0.0)
    assert mood("серый") == ("neutral", 0.0)
    assert mood("приятный") == ("positive", pytest.approx(0.7))  # listed twice


def test_text_functions(spark):
    assert one(spark, X.clean_html(F.lit("<b>a</b>  see https://x.y/z  b"))) == "a see b"
    assert one(spark, X.claims(F.lit("One is. Ok! Two are here"))) == ["One is.", "Two are here"]
    assert one(spark, X.reader(F.lit("Медицинский центр №1"))) == "пациенты"
    assert one(spark, X.reader(F.lit(""))) == "пользователи" == one(spark, X.reader(F.lit("чайник")))
    good = lambda p: one(spark, X.good_keyphrase(F.lit(p)))
    assert good("хороший звук") and not good("и в на") and not good("12 345 6") and not good("заказал тут") and not good("a@b.ru")
    assert not good("123") and not good("")  # no alphabetic word at all
    assert one(spark, X.full_text(F.lit("t"), F.lit(""), F.lit("p"), F.lit(None).cast("string"))) == "t\nПлюсы: p"
    state = one(spark, X.text_state(F.lit("Очень хор и"), F.lit(9)))
    assert (state.before, state.current_token, state.last_tokens) == ("Очень хор", "хор", ["очень", "хор"])


def test_pipeline_on_two_reviews(spark):
    rows = reviews(spark, [
        {"review_id": 1, "plus": "Отличная батарея. Красивый экран", "minus": "Нет"},
        {"review_id": 2, "plus": "Батарея супер", "minus": "Экран слабый", "rating": 3.0},
    ])
    long = A.sections(rows)
    assert {r.section for r in long.collect()} == {"plus", "minus"}
    assert {r.canonical_text for r in A.canonical_text(long).collect()} == {"[PLUS] Отличная батарея. Красивый экран\n[MINUS] Нет", "[PLUS] Батарея супер\n[MINUS] Экран слабый"}
    out = M.summarize("aspect_evidence", rows, A.Params(max_spans_per_review=10, max_selected=20))
    scored = {r.name: r for r in out["clusters"].collect()}
    assert scored["батарея супер"].positive == 1 and scored["экран слабый"].negative == 1
    assert out["verification"].first().passed
    text = out["summary"].first()
    assert "Сильные стороны" in text.text_overall and "экран слабый" in text.text_cons
    assert all(0 <= r.share <= 1 for r in out["key_phrases"].collect())
    assert all(r.rank <= 3 for r in out["evidence"].collect())


def test_span_cap_and_short_pieces(spark):
    rows = reviews(spark, [{"review_id": 1, "comment": "ab. " + ". ".join(f"span {i}" for i in range(40))}])
    got = A.spans(A.sections(rows)).orderBy("span_index").collect()
    assert [r.span_index for r in got] == list(range(30)) and got[0].span_text == "span 0"


def test_catalogue(spark):
    rows = reviews(spark, [{"review_id": i, "product_id": i % 2, "user_id": i if i else None, "rating": None if i == 3 else float(i)} for i in range(5)])
    assert C.filter_reviews(rows, rating_min=1, rating_max=3).count() == 2
    assert C.interface_bounds(0, 5) == {"rating_min": None, "rating_max": None}
    with pytest.raises(C.NotFoundError):
        C.get(rows, "review_id", 99)
    assert C.get_optional(rows, "review_id", 99).count() == 0
    counts = C.products_with_counts(spark.createDataFrame([(0,), (1,), (9,)], "product_id long"), rows)
    assert {r.product_id: r.reviews_count for r in counts.collect()} == {0: 3, 1: 2, 9: 0}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, C.upsert(old, new, "k").collect()), key=str) == [(1, "a"), (2, None), (3, "c")]
    assert sorted(map(tuple, C.patch(old, new, "k").collect())) == [(1, "a"), (2, "b")]
    kept, child = C.delete_cascade(old, {"c": new}, old.filter("k = 2"), "k")
    assert kept.count() == 1 and child["c"].count() == 1
    assert sorted(r.k or 0 for r in C.set_null(old, old.filter("k = 1"), "k").collect()) == [0, 2]
    assert C.page_of(old, ["k"], 99, 1).first().k == 2
    a, b = (C.fingerprint(rows.orderBy(o), "product_id").collect() for o in ("review_id", F.desc("review_id")))
    assert sorted(a) == sorted(b)
    changed = C.fingerprint(rows.withColumn("comment", F.lit("new")), "product_id").collect()
    assert not set(a) & set(changed)
    status = C.mark_status(spark.createDataFrame([(1, "ready", "h")], "product_id long, status string, source_hash string"), rows, "stale")
    assert {(r.product_id, r.status) for r in status.collect()} == {(0, "stale"), (1, "stale")}


def test_suggestions(spark):
    raw = spark.createDataFrame([(1, 1, 1, "plus", 5.0, "очень хор", 9)], "request_id long, product_id long, user_id long, field string, rating double, text string, cursor int")
    index = N.prefix_index(spark.createDataFrame([(1, "очень хороший звук", 0.9, "positive"), (1, "хорошо сидит", 0.5, "negative")], "product_id long, phrase string, quality double, weak string"))
    none = spark.createDataFrame([], "product_id long, context string, rank int, next string, n long, score double, weak string")
    got = S.suggest(raw, index, none, limit=10).collect()
    assert len(got) == 2 and got[0].insert_text == "хороший" and got[0].mode == "replace_current_token"
    assert not one(spark, X.safe_suggestion(F.lit("всего 500 руб"), F.lit("")))
    assert not one(spark, X.safe_suggestion(F.lit("через неделю"), F.lit("")))
    assert one(spark, S.insert(F.lit("очень хор"), F.lit(9), F.lit("хороший"), F.lit("replace_current_token"))) == "очень хороший"


def test_metrics(spark):
    ledger = spark.createDataFrame([(1, "экран", ["дисплей"], 0.6, "positive"), (1, "звук", ["звук"], 0.4, "negative")], "product_id long, name string, aliases array<string>, salience double, expected string")
    texts = spark.createDataFrame([(1, "Хороший дисплей. Хороший дисплей.", "дисплей ярко светит", None, None)], "product_id long, text_overall string, text_pros string, text_cons string, text_neutral string")
    proof = spark.createDataFrame([(1, "дисплей ярко светит всегда")], "product_id long, span_text string")
    row = E.all_metrics(ledger, texts, proof).first()
    assert row.coverage == 0.5 and row.coverage_weighted == pytest.approx(0.6) and row.sentiment_consistency == 1.0
    assert row.non_redundancy == pytest.approx(2 / 3) or row.non_redundancy == 0.5
    assert 0 <= row.aspect_balance <= 1 and 0 < row.specificity < 1 and 0 < row.overall <= 1
    long = E.long_form(E.all_metrics(ledger, texts, proof), "ours").unionByName(spark.createDataFrame([(1, "coverage", None, "ours")], "product_id long, metric string, value double, system string"))
    assert {r.metric: r["mean"] for r in E.system_means(long).collect()}["coverage"] == 0.5


def test_folds(spark):
    assert folds.ratio("abc", "abc") == 100 and folds.ratio("", "") == 100 and folds.partial_ratio("bc", "abcd") == 100
    labels = spark.createDataFrame([(1, x) for x in ("экран", "экраны", "звук")], "product_id long, label string")
    assert {r.label: r.name for r in folds.label_clusters(labels).collect()} == {"экран": "экран", "экраны": "экран", "звук": "звук"}
    phrases = spark.createDataFrame([(1, "хороший звук", 0.9), (1, "хороший звук!", 0.8), (1, "плохой", 0.7)], "product_id long, phrase string, quality double")
    assert {r.phrase for r in folds.distinct_phrases(phrases).collect()} == {"хороший звук", "плохой"}
    import numpy as np

    assert folds.average_link(np.array([[0.0], [0.1], [5.0]]), 1.1).tolist() == [0, 0, 1]


def test_catalogue_json(spark, tmp_path):
    item = {"benchmark_set_name": "s", "platform_name": "p", "product_title": "t", "snapshot_timestamp": "2024-01-01T00:00:00Z",
            "reviews": [{"id": "1", "review_date": "bad"}, {"id": "2", "review_date": "2024-02-03"}, {"id": "3"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps([item]))
    (tmp_path / "in/b.json").write_text(json.dumps({"items": [item, {**item, "id": "x"}]}))
    got = B.read_catalogue(spark, str(tmp_path / "in"))
    assert got.count() == 3 and got.filter("id is null").count() == 0
    dates = [r.review_date for r in B.review_rows(got).collect()]
    assert len(dates) == 9 and sum(d is not None for d in dates) == 3
    B.export_jsonl(got, str(tmp_path / "out"))
    assert all("external_summary" in json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect())
    with pytest.raises(Exception, match="snapshot_timestamp"):
        B.parse_text(spark, json.dumps([{k: v for k, v in item.items() if k != "snapshot_timestamp"}])).collect()


def test_streams(spark, tmp_path):
    src, stored, dead = (str(tmp_path / x) for x in ("src", "stored", "dead"))
    (tmp_path / "src").mkdir()
    jobs = [{"job_type": "product", "product_id": i % 2, "enqueued_at": f"2024-01-01T00:0{i}:00Z"} for i in range(4)]
    (tmp_path / "src/a.json").write_text("\n".join(json.dumps({"payload": json.dumps(j)}) for j in jobs))
    stream = J.deduplicated(J.job_stream(spark, src))
    run = J.rebuild_batch(lambda b: b, lambda b, n: b.write.mode("append").parquet(stored), lambda b, n: None, lambda b, n: None)
    J.start_worker(stream, run, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.product_id for r in spark.read.parquet(stored).collect()) == [0, 1]

    def fail(_):
        raise RuntimeError("no")

    bad = J.rebuild_batch(fail, lambda b, n: None, lambda b, n: b.write.mode("append").parquet(str(tmp_path / "retry")), lambda b, n: b.write.mode("append").parquet(dead))
    bad(spark.createDataFrame([("product", 1, 2), ("product", 2, 0)], "job_type string, product_id long, attempt int"), 0)
    assert [r.product_id for r in spark.read.parquet(dead).collect()] == [1]
    assert [(r.product_id, r.force) for r in spark.read.parquet(str(tmp_path / "retry")).collect()] == [(2, True)]


def test_model_hook(spark):
    asked = M.with_model(spark.createDataFrame([("a b",), (None,)], "prompt string"), "prompt", lambda p: M.echo_model(p), tries=2)
    texts = asked.select(M.answer_json(F.col("answer"), "positive string, general string").alias("t")).collect()
    assert texts[0].t.positive == "a b" and texts[1].t is None


def test_jobs_near_the_last_accepted_one_fall(spark):
    rows = [("product", 1, False, t) for t in (0, 2, 599, 600, 700, 1199, 1201, 5000)] + [("product", 2, True, 1), ("product", 2, True, 2)]
    jobs = spark.createDataFrame(rows, "job_type string, product_id long, force boolean, t long").withColumn("enqueued_at", F.timestamp_seconds("t"))
    got = J.deduplicated(jobs)
    assert sorted(r.t for r in got.filter("product_id = 1").collect()) == [0, 600, 1201, 5000]
    assert got.filter("product_id = 2").count() == 2


def test_failed_jobs_come_back_through_the_stream(spark):
    kept, again, dead = [], [], []

    def build(jobs):
        if jobs.filter("product_id = 3").limit(1).count():
            raise RuntimeError("no")
        return jobs

    run = J.rebuild_batch(build, lambda b, n: kept.extend(b.collect()), lambda b, n: again.extend(b.collect()), lambda b, n: dead.extend(b.collect()))
    jobs = spark.createDataFrame([("product", i, False, a) for i, a in ((1, 0), (2, 0), (3, 0), (3, 2))], "job_type string, product_id long, force boolean, attempt int")
    run(jobs, 0)
    assert sorted(r.product_id for r in kept) == [1, 2]
    assert [(r.product_id, r.force, r.attempt) for r in again] == [(3, True, 1)]
    assert [(r.product_id, r.attempt, r.error) for r in dead] == [(3, 3, "no")]


def test_fingerprint_sees_every_field(spark):
    base = dict(product_id=1, review_id=1, rating=4.0, title="a|b", comment="c", plus="", minus="", review_date="2024-01-01 00:00:00", created_at="2024-01-01 00:00:00")
    changes = [{}, {"title": "a", "comment": "b|c"}, {"review_date": "2024-01-02 00:00:00"}, {"rating": 4.5}, {"plus": "c", "comment": ""}]
    found = set()
    for c in changes:
        row = spark.createDataFrame([base | c]).withColumns({t: F.to_timestamp(t) for t in ("review_date", "created_at")})
        found.add(C.fingerprint(row, "product_id").first().source_hash)
    assert len(found) == len(changes)


def test_metrics_at_their_bounds(spark):
    ledger = spark.createDataFrame([(1, "battery", ["battery"], 0.75, "positive"), (1, "screen", ["screen", "display"], 0.25, "negative")], "product_id long, name string, aliases array<string>, salience double, expected string")
    texts = spark.createDataFrame([(1, 1, "The display is fine.", "Battery lasts long."), (1, 2, "", None), (9, 3, "no ledger here", None)], "product_id long, n long, text_overall string, text_pros string")
    proof = spark.createDataFrame([(1, "the battery lasts very long"), (1, " ")], "product_id long, span_text string")
    rows = {r.n: r for r in E.all_metrics(ledger, texts, proof).collect()}
    assert (rows[1].coverage, rows[1].coverage_weighted) == (1.0, 1.0) and rows[1].evidence_support == 0.5
    assert (rows[2].coverage, rows[2].aspect_balance, rows[2].evidence_support, rows[2].specificity) == (0.0, 1.0, 1.0, 0.0)
    assert (rows[3].coverage, rows[3].aspect_balance, rows[3].evidence_support, rows[3].unsupported_rate) == (1.0, 1.0, 0.0, 1.0)
