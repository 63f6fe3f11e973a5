import random
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import documents, rows

from opinspark.llm import kernels as K
from opinspark.llm.exchange import among_pairs
from opinspark.llm.suffix_dedup import fingerprints, repeated, suffix_dedup, suffix_ranks


def brute(docs, length):
    texts = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[1 + i : 1 + i + length] = True
        runs = int((np.diff(gone.astype(int)) == 1).sum())
        out.append((-1 if d is None else d, len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone[1:-1]])))
    return sorted(out)


def test_suffix_ranks_sort_suffixes():
    rng = np.random.default_rng(2)
    for n in range(1, 120):
        for kind in (2, 4, 200):
            s = rng.integers(1, kind, n) if kind > 2 or n % 2 else np.ones(n, int)
            ranks = suffix_ranks(s, 20)
            order = sorted(range(n), key=lambda i: s[i:].tolist())
            assert np.argsort(ranks, kind="stable").tolist() == order


def test_limited_depth_keeps_equal_prefixes_together():
    rng = np.random.default_rng(4)
    for _ in range(60):
        block = rng.integers(1, 4, 60)
        s = np.concatenate([np.concatenate((rng.integers(1, 4, rng.integers(1, 9)), block)) for _ in range(6)])
        for depth in (1, 2, 3):
            ranks, span = suffix_ranks(s, depth), 3**depth
            order = np.argsort(ranks, kind="stable")
            prefixes = [tuple(s[i : i + span].tolist()) for i in order]
            assert prefixes == sorted(prefixes)


def test_repeated_places():
    rng = random.Random(1)
    for _ in range(60):
        pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(rng.randint(1, 8))]
        pieces = list(dict.fromkeys(pieces))
        count = Counter(w for p in pieces for w in [p[i : i + 12] for i in range(len(p) - 11)])
        got = repeated(pieces, 12)
        assert [m.tolist() for m in got] == [[count[p[i : i + 12]] > 1 for i in range(max(0, len(p) - 11))] for p in pieces]


def test_equal_strings_have_equal_fingerprints():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    doc, place, first, last, hashes = fingerprints(K.Texts(pa.array(texts)), 16)
    seen = {}
    for d, p, a, b, h in zip(doc, place, first, last, hashes):
        for s in range(a, b + 1):
            key = texts[d][s : s + 16]
            assert len(key) == 16
            assert seen.setdefault(key, (p - s, h)) == (p - s, h)
    assert len(seen) == len({t[i : i + 16] for t in texts for i in range(len(t) - 15)})


def test_fingerprints_fill_ranges_alike():
    rng = random.Random(5)
    *_, hashes = fingerprints(K.Texts(pa.array(["".join(rng.choice("abcdefgh") for _ in range(60_000))])), 200)
    counts = np.bincount((hashes >> np.uint64(61)).astype(np.int64), minlength=8)
    assert counts.sum() > 800 and counts.max() < 2 * counts.min()


def check(spark, docs, length=200, **options):
    got = suffix_dedup(documents(spark, docs), length=length, **options).collect()
    result = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
    assert result == brute([r[:2] for r in docs], length)
    assert all(sum(s.end - s.first for s in r.spans) == r.n_removed for r in got)
    return got


def test_matches_brute_force(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([150, 199, 200, 230, 400]))) for _ in range(10)]
    docs = rows(13, 220, longest=120, pieces=passages)
    docs += [(None, passages[-1], "", "", 0, 0, "", 0), (6000, "aa " * 300, "", "", 0, 0, "", 0), (6001, "ab" * 100, "", "", 0, 0, "", 0)]
    got = check(spark, docs)
    assert sum(r.n_removed > 0 for r in got) > 60
    check(spark, docs[:80], 24)
    check(spark, docs[:80], 24, hot_pieces=1)


def test_passage_of_many_texts(spark):
    """Fingerprints that stand in a different piece of every text."""
    rng = random.Random(15)
    salad = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, ends = salad(260), [salad(60) for _ in range(4)]
    docs = [(i, salad(90) + rng.choice(ends) + passage + rng.choice(ends) + salad(i), "", "", 0, 0, "", 0) for i in range(120)]
    docs += [(500, docs[7][1], "", "", 0, 0, "", 0), (501, passage * 3, "", "", 0, 0, "", 0), (502, "ab" * 200, "", "", 0, 0, "", 0), (None, None, "", "", 0, 0, "", 0)]
    for most in (1, 20, 1024):
        got = check(spark, docs, hot_pieces=most)
    assert sum(r.n_removed > 200 for r in got) > 100


def test_empty_and_repeats(spark):
    assert suffix_dedup(documents(spark, [])).count() == 0
    check(spark, [(1, "x" * 150 + "y" * 150, "", "", 0, 0, "", 0)] * 2 + [(2, None, "", "", 0, 0, "", 0)])


def test_strings_are_matched_by_both_hashes():
    table = np.array([[5, 1], [5, 7], [9, 2]], np.uint64)
    keys, checks = np.array([5, 5, 5, 9, 9, 4], np.uint64), np.array([1, 7, 2, 2, 1, 1], np.uint64)
    assert among_pairs(table, keys, checks).tolist() == [True, True, False, True, False, False]
    assert among_pairs(table[:0], keys, checks).sum() == 0


def test_many_rows_without_an_id(spark):
    shared = "".join(chr(97 + i * 7 % 26) for i in range(230))
    docs = [(None, f"{i} {shared} {i * 31}", "en", "s", 0, 0, "", 0) for i in range(60)]
    got = suffix_dedup(documents(spark, docs), hot_pieces=16).collect()
    assert len(got) == 60 and {r.n_spans for r in got} == {1} and min(r.n_removed for r in got) >= 230
