"""Alignment against the tokenizers over whole texts and a quadratic search for common ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from helpers import documents, rows
from tokenizers import Tokenizer

from opinspark.llm import kernels as K
from opinspark.llm.alignment import align_corpus, boundaries, pieces, stab, stretches
from opinspark.llm.common import table
from opinspark.llm.memo import Memo, vocabulary

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def expected(docs):
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    a_bytes, b_bytes = [x for x, _ in vocabulary(A)], pieces(B)[1]
    all_links, per = Counter(), []
    for i, text in docs:
        a = ta.encode(" " + (text or ""), add_special_tokens=False).ids
        b = tb.encode(text or "")
        want = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[x] for x in a) != want or b"".join(b_bytes[x] for x in b) != want:
            per.append((i, 0, 0, [], []))
            continue
        ends = [dict(zip(np.cumsum([len(t[x]) for x in ids]).tolist(), range(len(ids)), strict=True)) for ids, t in ((a, a_bytes), (b, b_bytes))]
        groups, links, p, q = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            r, s = ends[0][end], ends[1][end]
            groups.append(",".join(map(str, a[p : r + 1])) + "|" + ",".join(map(str, b[q : s + 1])))
            links.append((a[r], b[s]))
            p, q = r + 1, s + 1
        all_links.update(links)
        per.append((i, len(a), len(b), groups, links))
    most = Counter()
    for (_, y), n in all_links.items():
        most[y] = max(most[y], n)
    return [
        (i, n_a, n_b, len(g), len(x), sum(all_links[p] == most[p[1]] for p in x), sum(all_links[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, n_a, n_b, g, x in per
    ]


def same(got, docs):
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, expected(docs)))


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "\n\n x \t y \r\n", "it's  we'll 're", "<|endoftext|> and <s> </s> <unk>", "a▁b", "x  y 　z   w", "    q",
    "é ́ ok", "\x00 \x1c \x1d z \x7f", "\x1c a\x1c b", "日本語 テスト 日本", "🙂 🙂🙂 family 👨‍👩‍👧 ok", "0 00 1234567 3.14 1,000", "ÀÉ ß ẞ ǅ", "z" * 3000, " " * 500 + "end", "\u0085 a \u0085 b", "﻿x ​ y", "ﬁ ①",
]


def test_odd_texts(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "it's me"), (3, "it's me")]
    frame = spark.createDataFrame([(t, 1, i, 2) for i, t in docs], "text string, block int, doc_id long, pairs int")
    same(align_corpus(frame, A, B), docs)


def test_random_texts(spark):
    rng = random.Random(9)
    parts = [" ", "  ", "\n", "\t", " ", "　", "é", "word", "Wört", "'s", "12", "!?", "日", "🙂", "\x1c", "\x7f", "<|endoftext|>", "-"]
    docs = [(i, "".join(rng.choices(parts, k=rng.randint(1, 40)))) for i in range(400)]
    same(align_corpus(spark.createDataFrame(docs, "doc_id long, text string"), A, B), docs)


def test_test_documents(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    docs += [(r[0], r[1]) for r in rows(5, 60)]
    same(align_corpus(documents(spark, [(i, t, None, None, 1, 2, "x", 3) for i, t in docs]), A, B), docs)


def test_no_rows(spark):
    assert align_corpus(documents(spark, []), A, B).collect() == []


def test_stabbing():
    # A: [0,3) [3,4) [4,9); B: [0,2) [2,3) [3,6) [6,9)
    a, b = (np.array([0, 3, 4]), np.array([3, 4, 9])), (np.array([0, 2, 3, 6]), np.array([2, 3, 6, 9]))
    first, stop = stab(*a, *b)
    assert first.tolist() == [0, 2, 2] and stop.tolist() == [2, 3, 4]
    assert boundaries(a[1], a[0], *b).tolist() == [1, 3]


def test_stretches_hold_all_bytes():
    column = pa.array([" a b", " ", "  a  b c", " é à", " é a"])
    cuts, of = stretches(K.Texts(column))
    data = "".join(column.to_pylist()).encode()
    got = [data[p:q].decode() for p, q in zip(cuts[:-1], cuts[1:])]
    assert [got[p:q] for p, q in zip(of[:-1], of[1:])] == [[" a", " b"], [" "], ["  a  b", " c"], [" é à"], [" é", " a"]]


def test_memo_forgets():
    made = []
    memo = Memo(lambda new: (made.extend(new), {"n": (np.array([len(x) for x in new], np.int64), np.ones(len(new), np.int64)), "own": list(new)})[1], most=3)
    for words in ([b"a", b"bb", b"a"], [b"ccc", b"dddd", b"a"], [b"a"], []):
        places = memo.places(words)
        assert memo.of("n")[0][places].tolist() == [len(w) for w in words]
        assert [memo.of("own")[p] for p in places] == words
    assert made == [b"a", b"bb", b"ccc", b"dddd", b"a"]
