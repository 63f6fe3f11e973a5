import random

import pytest
from helpers import alnum, documents, rows

from opinspark.llm.decontamination import clean, decontaminate


def brute(docs, items):
    out = {}
    for doc, text in docs:
        words, hit, ids = alnum(text), set(), set()
        for item, body in items:
            w = alnum(body)
            length = min(10, len(w))
            windows = {tuple(w[i : i + length]) for i in range(len(w) - length + 1)} if w else set()
            for i in range(len(words) - length + 1 if windows else 0):
                if tuple(words[i : i + length]) in windows:
                    hit.update(range(i, i + length))
                    ids.add("" if item is None else str(item))
        out[doc] = (len(words), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0}, {"filter_words": 1}])
def test_matches_brute_force(spark, how):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 25)))) for i in range(25)]
    items += [(7, "again an item of the same id"), (None, "the null id has words too here"), (30, None), (31, "...")]
    pieces = [t for _, t in items if t] + [" ".join(t.split()[2:]) for _, t in items if t]
    docs = rows(5, 120, pieces=pieces)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(documents(spark, docs), bench, **how).collect()
    expected = brute([r[:2] for r in docs], items)
    assert {r.doc.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == expected
    assert sum(1 for x in expected.values() if x[1]) > 10
    for r in got:
        assert sum(s.end - s.first for s in r.spans) == r.n_hit


def test_empty_tables_and_repeats(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = documents(spark, [(1, "x One two, three y", "", "", 1, 1, "", 1)] * 3 + [(None, "one two three", "", "", 1, 1, "", 1)])
    assert [r.n_hit for r in decontaminate(docs, bench).collect()] == [3] * 4
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert [r.n_hit for r in decontaminate(docs, bench.limit(0)).collect()] == [0] * 4


def test_clean_keeps_the_rest(spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    docs = documents(spark, [(i, t, "", "", 1, 1, "", 1) for i, t in enumerate([None, "", "x One two, three", "one two", "a " + " ".join(f"W{i}" for i in range(5, 15)), "one two"])])
    for how in ({}, {"broadcast_bytes": 0}):
        got = clean(docs, bench, **how)
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == [0, 1, 3, 5]


def test_very_long_text(spark):
    long = " ".join(f"{i % 977}x{i % 1009}" for i in range(200_000))
    bench = spark.createDataFrame([(1, " ".join(long.split()[150_000:150_020])), (2, long[-200:])], "item_id long, text string")
    [row] = decontaminate(documents(spark, [(1, long, "", "", 1, 1, "", 1)]), bench).collect()
    assert (row.n_words, row["items"]) == (200_000, ["1", "2"])
    assert [(s.first, s.end) for s in row.spans][0] == (150_000, 150_020)
