"""Importance resampling against brute force; the checksum kernel against zlib."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import alnum, documents, rows

from opinspark.llm import kernels as K
from opinspark.llm.resampling import _packed, _unpacked, feature_buckets, resample


def features(text):
    w = alnum(text)
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def expected(docs, target):
    own = [(r[0], *features(r[1])) for r in docs]
    s, t = sum((c for _, _, c in own), Counter()), sum((features(x)[1] for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1.0) * (all_s + 10_000) / ((s[k] + 1.0) * (all_t + 10_000)))) for k in s}
    out = []
    for i, words, counts in own:
        weight = sum(gain[k] * n for k, n in counts.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, sum(counts.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for x in out:
        x.append(None)
    for place, x in enumerate(able[: 5 * len(able) // 100]):
        x[5] = place + 1
    return out


def line(r):
    return str(tuple(r))


@pytest.mark.parametrize("options", [{}, {"parts": 3, "blocks": 1}])
def test_same_as_brute_force(spark, options):
    docs = rows(7, 240, longest=120)
    docs += [(None, docs[0][1], *docs[0][2:]), (None, "x " * 50, *docs[0][2:]), docs[1], docs[1], (9000, "w" * 5000 + " Long", *docs[0][2:]), (9001, "rep " * 70_000, *docs[0][2:])]
    target = [docs[3][1], None, "", "é0 b1 A2 " * 5]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample(documents(spark, docs), bench, **options)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(line, got.collect())) == sorted(map(line, expected(docs, target)))


def test_empty_tables(spark):
    none = documents(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resample(none, bench).collect() == []
    docs = rows(8, 30)
    assert sorted(map(line, resample(documents(spark, docs), bench).collect())) == sorted(map(line, expected(docs, [])))


def test_checksums_of_any_length():
    words = ["a" * n for n in (1, 63, 64, 65, 127, 128, 129, 1000)] + ["é日ß", "z"]
    texts = K.Texts(pa.array([" ".join(words), None, "", "solo"]))
    bucket, doc = feature_buckets(K.Words(texts, K.ALNUM, True), 3, 2**31 - 1)
    want = sorted(zlib.crc32(" ".join(words[i : i + k]).encode()) % (2**31 - 1) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert sorted(bucket[doc == 0].tolist()) == want
    assert bucket[doc == 3].tolist() == [zlib.crc32(b"solo") % (2**31 - 1)]


def test_postings_round_trip():
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 20 << 16, 3000))
    bucket, place = key >> 16, key & 65535
    bucket[bucket == 7] = 8  # an empty one
    order = np.lexsort((place, bucket))
    bucket, place = bucket[order], place[order]
    count = rng.integers(1, 65536, len(bucket))
    for got, want in zip(_unpacked(_packed(bucket + 40, place, count, 40, 25), 25), (bucket, place, count), strict=True):
        assert got.tolist() == want.tolist()
