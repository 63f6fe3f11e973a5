import numpy as np
import pytest
from helpers import LOWER, documents, rows, solid

from opinspark.llm.ngram_join import _Salts, components, ngram_jaccard_components


def brute(docs):
    sets = {}
    for doc, text in docs:
        w = solid((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_matches_brute_force(spark):
    docs = rows(8, 300, longest=200)
    base = "w" + " w".join(map(str, range(150)))
    for i in range(60):  # a chain and a star of near copies
        words = base.split()
        words[(i * 7) % 150] = f"x{i}"
        words[(i * 11 + 3) % 150] = f"y{i}"
        docs.append((1000 + i, " ".join(words), "", "", 0, 0, "", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(documents(spark, docs)).collect()}
    expected = brute([r[:2] for r in docs])
    assert got == expected
    assert len({c for _, c in expected.values()}) < len(docs) - 50


def test_frequent_ngrams_in_blocks(spark):
    base = "w" + " w".join(map(str, range(150)))
    docs = rows(9, 100, longest=60)
    for i in range(90):  # near copies, copies of them in other partitions, and texts that share only rare n-grams
        words = base.split()
        words[(i * 7) % 150] = f"x{i}"
        docs += [(1000 + i, " ".join(words), "", "", 0, 0, "", 0), (2000 + i, " ".join(words), "", "", 0, 0, "", 0)]
        docs.append((3000 + i, "one two three four five " + " ".join(f"u{i % 30}-{j}" for j in range(9 + i % 4)), "", "", 0, 0, "", 0))
    found = documents(spark, docs).repartition(5, "doc_id")
    expected = brute([r[:2] for r in docs])
    for hot, block, rounds in ((1, 3, 4), (3, 7, 1), (64, 4096, 1)):
        got = ngram_jaccard_components(found, hot_rows=hot, block_rows=block, pivot_rounds=rounds)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == expected


def test_all_links_are_counted(spark):
    """classes that are connected already are compared too."""
    base = "w" + " w".join(map(str, range(150)))
    docs = [r for r in rows(10, 60, longest=60)]
    for i in range(40):  # a star, a chain and copies
        words = base.split()
        words[(i * 7) % 150] = f"x{i}"
        docs.append((1000 + i, " ".join(words), "", "", 0, 0, "", 0))
        docs.append((2000 + i, " ".join(f"c{j}" for j in range(2 * i, 2 * i + 60)), "", "", 0, 0, "", 0))
    docs.append((3000, docs[-1][1], "", "", 0, 0, "", 0))
    sets = {}
    for doc, text, *_ in docs:
        w = solid((text or "").translate(LOWER))
        sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    different = set(sets.values()) - {frozenset()}
    links = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in different) for a in different} | {frozenset(): 0}
    for blocks in (7, 256):
        got = ngram_jaccard_components(documents(spark, docs).repartition(4, "doc_id"), block_classes=blocks)
        assert {r.doc_id: r.n_links for r in got.collect()} == {d: links[s] for d, s in sets.items()}
    assert max(links.values()) > 30


def test_salts_leave_rows_in_place():
    salts = _Salts(2)
    grams = np.array([5, 6, 5, 5, 7, 5], np.uint64)
    first, second = salts(grams, np.arange(6)), salts(grams, np.arange(6, 12))
    assert (first[[0, 1, 2, 4]] == 0).all() and (first[[3, 5]] > 0).all()
    assert (second[[0, 2, 3, 5]] > 0).all() and (second[[1, 4]] == 0).all()


def test_awkward_rows(spark):
    docs = [(None, "a b c d e f", "", "", 0, 0, "", 0), (4, "a b c d e f", "", "", 0, 0, "", 0), (4, "a b c d e f", "", "", 0, 0, "", 0)]
    docs += [(9, None, "", "", 0, 0, "", 0), (8, " ", "", "", 0, 0, "", 0), (3, "A B", "", "", 0, 0, "", 0), (5, "a b", "", "", 0, 0, "", 0)]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_jaccard_components(documents(spark, docs)).collect()))
    assert got == [(0, 2, 4), (3, 1, 3), (4, 2, 4), (4, 2, 4), (5, 1, 3), (8, 0, 8), (9, 0, 9)]
    assert ngram_jaccard_components(documents(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {i: 0 for i in range(101)} | {500: 400, 400: 400}


def test_components_of_a_chain_settle_or_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, rounds=2)
