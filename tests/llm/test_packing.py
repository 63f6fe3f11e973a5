"""Packing: laws of the pieces over all rows, token ids against the tokenizer itself, the linear program against small cases."""

import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, rows
from tokenizers import Tokenizer

from opinspark.llm.memo import gather
from opinspark.llm.packing import best_pattern, cutting_stock, pack, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def held(spark, docs, capacity=4096, end=2, **options):
    """Checks every law and returns the tokens and what they take with padding."""
    got = pack(documents(spark, docs), PATH, capacity, end, **options).collect()
    encode = Tokenizer.from_file(PATH).encode
    want = sorted((str(i), [*encode(t or "", add_special_tokens=False).ids, end]) for i, t, *_ in docs)
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_row[r.row].append(r)
        by_sequence[r.sequence_id].append(r)
    texts = defaultdict(list)
    for i, ids in want:
        texts[i].append(ids)
    assert len(by_row) == len(docs)
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.start)
        cuts = [0, *np.cumsum([r.length for r in pieces]).tolist()]
        assert [r.start for r in pieces] == cuts[:-1] and {r.doc_tokens for r in pieces} == {cuts[-1]}
        crc = lambda ids: [zlib.crc32(np.array(ids[a:b], "<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        own = texts[str(pieces[0].doc_id)]
        own.remove(next(x for x in own if len(x) == cuts[-1] and crc(x) == [r.ids_crc32 for r in pieces]))
    assert not any(texts.values())
    taken = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces]).tolist()
        assert [r.offset for r in pieces] == [0, *ends[:-1]] and ends[-1] <= capacity
        taken += ends[-1] if ends[-1] & (ends[-1] - 1) == 0 else capacity
    return sum(len(x) for _, x in want), taken


def test_pieces(spark):
    docs = rows(11, 300, longest=500)
    docs += [docs[0], docs[0], (None, docs[1][1], *docs[1][2:]), (None, None, *docs[1][2:]), (9, "<|endoftext|>é x Σας ΣΑΣ\x1cq " * 3, *docs[1][2:])]
    docs += [(10_000 + i, "nb " * n, *docs[1][2:]) for i, n in enumerate((4094, 4095, 4096, 8191, 30_000))]
    tokens, taken = held(spark, docs)
    assert tokens <= taken <= 1.01 * tokens


def test_small_sequences(spark):
    tokens, taken = held(spark, rows(12, 200, longest=60), capacity=64, end=7, width=4)
    assert tokens <= taken <= 1.05 * tokens


@pytest.mark.parametrize("docs", [[], [(1, None, "en", "a", 0, 1, "x", 1)], [(i, "same words here", "en", "a", 0, 1, "x", 1) for i in range(500)]])
def test_few_and_equal_rows(spark, docs):
    tokens, taken = held(spark, docs)
    assert tokens <= taken <= 1.02 * tokens + 0


def test_dearest_pattern():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes, room = np.sort(rng.choice(np.arange(2, 12), 4, replace=False)), int(rng.integers(3, 25))
        prices = rng.random(4).round(3)
        value, counts = best_pattern(prices, sizes, room)
        every = product(*(range(room // s + 1) for s in sizes))
        best = max(float(prices @ np.array(c)) for c in every if sizes @ np.array(c) <= room)
        assert counts @ sizes <= room and value == pytest.approx(best) and prices @ counts == pytest.approx(best)


def test_linear_program():
    # sizes 3, 4, 5 in 10: 5+5, 3+3+4 leave nothing, so that the optimum is the size bound
    patterns, uses = cutting_stock(np.array([3, 4, 5]), np.array([200.0, 100.0, 60.0]), 10, 1e-9)
    assert uses @ patterns == pytest.approx([200, 100, 60]) and (uses >= 0).all()
    assert uses.sum() == pytest.approx(130)
    # size 6 in 10 leaves 4: at least one sequence each
    patterns, uses = cutting_stock(np.array([4, 6, 7]), np.array([5.0, 30.0, 10.0]), 10, 1e-9)
    assert uses.sum() == pytest.approx(40)


def test_words_go_through_the_merges_as_through_the_tokenizer():
    rng = np.random.default_rng(6)
    odd = ["", "don't", "'S'T'RE", "x\x01y", "\x01", "<|endoftext|>", "<|", "é", "É", "e\u0301", "ΣΑΣ", "İI", "ẞß", "12a3", "a-b_c...", "日本", "🙂🙂", "\u00a0x", "½²", "ŉ", "a" * 500, "—„“", "ab\u200dc", "Ǆǅ"]
    letters = list("abcdefgheinrstuABZÄÖéàß019'’-.,!?日本дж") + ["the", "ing", "'s", "'ll"]
    words = odd + ["".join(rng.choice(letters, rng.integers(1, 15))) for _ in range(3000)]
    memo, encode = word_ids(PATH), Tokenizer.from_file(PATH).encode
    places = memo.places([w.encode() for w in words])
    values, bounds = gather(*memo.of("ids"), places)
    assert [values[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [encode(w, add_special_tokens=False).ids for w in words]
