import random

from helpers import documents, rows, solid

from opinspark.llm.substring_dedup import substring_dedup


def brute(docs, window=50):
    first = {}
    for doc, text in docs:
        w = solid(text)
        doc = 10**18 if doc is None else doc
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        w, gone = solid(text), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (10**18 if doc is None else doc):
                gone.update(range(i, i + window))
        out.append((doc if doc is not None else -1, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def check(spark, docs):
    got = substring_dedup(documents(spark, docs)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute([r[:2] for r in docs])
    for r in got:
        assert sum(s.end - s.first for s in r.spans) == r.n_removed
        assert all(a.end < b.first for a, b in zip(r.spans, r.spans[1:]))
    return got


def test_matches_brute_force(spark):
    rng = random.Random(6)
    passages = [" ".join(f"p{rng.randrange(40)}" for _ in range(rng.choice([30, 49, 50, 51, 70, 120]))) for _ in range(12)]
    docs = rows(9, 250, longest=260, pieces=passages)
    docs += [(None, passages[-1] + " x", "", "", 0, 0, "", 0), (7, passages[3], "", "", 0, 0, "", 0), (5000, "aa " * 300, "", "", 0, 0, "", 0), (5001, "aa\n" * 80, "", "", 0, 0, "", 0)]
    got = check(spark, docs)
    assert sum(r.n_removed > 0 for r in got) > 40


def test_empty_and_equal_ids(spark):
    assert substring_dedup(documents(spark, [])).count() == 0
    long = " ".join(map(str, range(60)))
    check(spark, [(1, long, "", "", 0, 0, "", 0), (1, long, "", "", 0, 0, "", 0), (None, None, "", "", 0, 0, "", 0)])
