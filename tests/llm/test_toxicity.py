import random

import numpy as np
from helpers import documents

from opinspark.llm.toxicity import fit, grade, train


def make(n, seed):
    rng = random.Random(seed)
    calm, harsh = [f"w{i}" for i in range(400)], [f"bad{i}" for i in range(6)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 6) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(harsh)
        toxic = any(w in harsh for w in words)
        docs.append((i, " ".join(words), "en", "s", 0, 0, "", 0))
        labels.append((i, 1, int(toxic) if rng.random() > 0.02 else 1 - int(toxic)))
    return docs, labels, {i for i, *_ in docs if any(w in harsh for w in docs[i][1].split())}


def test_held_out(spark):
    docs, labels, truth = make(1500, 1)
    table = documents(spark, docs)
    model = train(table, spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int"))
    got = {r.doc.doc_id: r for r in grade(table, model).collect() if r.doc.doc_id >= 1000}
    assert np.mean([got[i].toxic == (i in truth) for i in got]) > 0.98
    assert all(np.diff(model.thresholds) > 0)
    harsh = lambda i: sum(w.startswith("bad") for w in set(docs[i][1].split()))
    assert np.mean([got[i].severity for i in got if harsh(i) >= 3]) > np.mean([got[i].severity for i in got if harsh(i) == 1])


def test_awkward_rows(spark):
    docs, labels, _ = make(200, 2)
    docs = documents(spark, [*docs, (None, None, None, None, None, None, None, None), (5, "", "", "", 0, 0, "", 0)])
    rows = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    model = train(docs, rows)
    assert grade(docs, model).count() == 202
    assert grade(docs.limit(0), model).count() == 0
    empty = train(docs, rows.limit(0))
    assert {r.toxic for r in grade(docs, empty).collect()} <= {True, False}


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    grade_of = rng.integers(0, 4, 600)
    doc = np.repeat(np.arange(600), grade_of)
    word = np.concatenate([np.arange(g) for g in grade_of])
    weights, theta = fit(doc, word, grade_of, 3)
    assert (weights > 1).all() and (np.diff(theta) > 0).all()
