"""Aligning two tokenizations of the same text, and counting which tokens end together across a corpus.

B's tokens are a static interval index: sorted, disjoint byte ranges. Each token of A stabs it by bisection and gets the list
of B tokens that it overlaps; a gap between two B tokens inside such a list is spanned. Gaps that no A token spans, and that A has a
token's end at, bound the groups. Texts are cut into stretches that neither tokenizer joins across (a space between two solid characters),
each different stretch is tokenized and aligned once a worker, and a text's alignment is that of its stretches in turn.

Counts of linked id pairs are summed over blocks of documents before they are shuffled; each block then gets back the
counts of its own pairs, and its documents add them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize
from .memo import Columns, Memo, gather, joined, merger, tokenizer, vocabulary

SAFE = np.zeros(256, bool)  # solid to any tokenizer
SAFE[0x21:0x7F] = True
BLANK = np.zeros(256, bool)  # white space to some
BLANK[:0x21] = BLANK[0x7F] = True
WORD_START = "▁"  # stands for a space in pieces
SEPARATOR = b" a"  # a stretch that is cut off from those beside it, whatever they are
# fixed value: the pattern by which byte-level tokenizers split text before merging
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def stretches(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches begin (with the end of the data), and the bounds of each text's stretches. No stretch crosses texts.

    A cut is before a space with a solid byte on both sides, one of them plain ASCII: there a pattern that splits text before merging begins a
    match, whatever it takes for white space beyond ASCII, and no piece holds a word start after another character.
    """
    data = texts.data
    cut = np.zeros(len(data) + 1, bool)
    before, after = data[:-2], data[2:]
    cut[1:-2] = (data[1:-1] == 0x20) & ~BLANK[before] & ~BLANK[after] & (SAFE[before] | SAFE[after])
    cut[texts.bounds] = True
    at = np.flatnonzero(cut)
    return at, np.searchsorted(at, texts.bounds)


@lru_cache(4)
def pieces(path: str):
    """A piece model, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    piece = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(WORD_START in p.lstrip(WORD_START) for p in piece):
        raise ValueError("pieces that hold a word start after another character can't be cut at spaces")
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(WORD_START, " ").encode() for i, p in enumerate(piece)]


def stab(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A range, which B ranges it overlaps: first and end of their numbers. B is sorted and disjoint."""
    return np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")


def boundaries(a_end: np.ndarray, a_start: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """B tokens after which a group ends: those whose gap to the next one no A token spans, and the last."""
    first, stop = stab(a_start, a_end, b_start, b_end)
    spanned = np.zeros(len(b_end) + 1, np.int64)
    np.add.at(spanned, first, 1)  # an A token over B tokens first to stop - 1 spans the gaps after first to stop - 2
    np.add.at(spanned, np.maximum(stop - 1, first), -1)
    return np.flatnonzero(np.cumsum(spanned[:-1]) == 0)


def shown(ids: np.ndarray, last: np.ndarray, between: str, after: str) -> np.ndarray:
    """A row of bytes an id: its decimal digits, zero bytes before them, and what separates it from the next."""
    out = np.zeros((len(ids), 8), np.uint8)
    for k in range(7):
        place = 10**k
        out[:, 6 - k] = np.where((ids >= place) | (k == 0), ids // place % 10 + 48, 0)
    out[:, 7] = np.where(last, ord(after), ord(between))
    return out


class Aligner:
    """Tokens of both sides, their groups and links, by stretch."""

    def __init__(self, a_path: str, b_path: str):
        self.a_bytes, self.encode_a = [x for x, _ in vocabulary(a_path)], tokenizer(a_path, True).encode_batch
        self.merges = merger(a_path, BYTE_PATTERN)
        self.b_model, self.b_bytes = pieces(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.memo = Memo(self.align)

    def one_by_one(self, found: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], list[bool]]:
        """Tokens of both sides, how many each stretch has, and whether both give back its bytes."""
        texts = [x.decode() for x in found]
        a = [x.ids for x in self.encode_a(texts, add_special_tokens=False)]
        b = self.b_model.encode([t[1:] for t in texts], num_threads=1) if texts else []  # the model adds the space by itself
        back = lambda of, ids: b"".join(map(of.__getitem__, ids))
        return joined(a), joined(b), [len(t) > 1 and back(self.a_bytes, x) == t == back(self.b_bytes, y) for t, x, y in zip(found, a, b, strict=True)]

    def together(self, found: list[bytes]):
        """The same for stretches that begin with one space and end with a solid byte, as one text; None if that doesn't give back its bytes."""
        line = b"".join([x + SEPARATOR for x in found])
        text = line.decode()
        ends = np.cumsum([len(x) + len(SEPARATOR) for x in found])
        out = []
        for ids, of, size in ((self.merges.encode_ordinary(text), self.a_bytes, self.a_size), (self.b_model.encode(text[1:]), self.b_bytes, self.b_size)):
            if b"".join(map(of.__getitem__, ids)) != line:
                return None
            ids = np.array(ids, np.int64)
            end = np.cumsum(size[ids])
            stretch = np.searchsorted(ends, end, "left")
            mine = end <= ends[stretch] - len(SEPARATOR)
            if not np.isin(np.concatenate([ends, ends - len(SEPARATOR)]), end).all():
                return None
            out.append((ids[mine], np.bincount(stretch[mine], minlength=len(found))))
        return out[0], out[1], [True] * len(found)

    def align(self, found: list[bytes]) -> Columns:
        """Of each stretch: token counts, groups as text, linked pairs, whether bytes agree."""
        plain = [len(x) > 1 and not BLANK[x[1]] and not BLANK[x[-1]] and WORD_START.encode() not in x for x in found]
        fast, slow = [x for x, ok in zip(found, plain, strict=True) if ok], [x for x, ok in zip(found, plain, strict=True) if not ok]
        parts = [self.together(fast) if fast else None, self.one_by_one(slow)]
        if parts[0] is None:
            parts[0] = self.one_by_one(fast)
        (a, n_a), (b, n_b) = ((np.concatenate([x[i][0] for x in parts]), np.concatenate([x[i][1] for x in parts])) for i in (0, 1))
        whole, length = np.array(parts[0][2] + parts[1][2], bool), np.array([len(x) for x in fast + slow])
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        # whole stretches stand end to end on one line, which both sides tile: no token crosses from one to another
        a_end, b_end, line = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(length[whole])
        last_b = boundaries(a_end, a_end - self.a_size[a], b_end - self.b_size[b], b_end)
        last_a = np.searchsorted(a_end, b_end[last_b])
        groups = np.zeros(len(whole), np.int64)
        groups[whole] = np.diff(np.append(0, np.searchsorted(b_end[last_b], line, "right")))
        # ids in the order they are shown: each group's A ids, then its B ids
        is_last = lambda n, last: np.isin(np.arange(n), last)
        rows = np.concatenate([shown(a, is_last(len(a), last_a), ",", "|"), shown(b, is_last(len(b), last_b), ",", ";")])
        key = np.concatenate([2 * np.searchsorted(last_a, np.arange(len(a))), 2 * np.searchsorted(last_b, np.arange(len(b))) + 1])
        rows = rows[np.argsort(key, kind="stable")]
        text = rows[rows > 0].tobytes()
        cut = np.cumsum(np.append(0, np.count_nonzero(rows, axis=1)))
        edges = cut[np.append(0, np.cumsum(np.where(whole, n_a + n_b, 0)))].tolist()
        texts = [text[p:q] for p, q in zip(edges[:-1], edges[1:], strict=True)]
        pairs = a[last_a] << 32 | b[last_b]  # links: where groups end, the tokens of both sides do
        # back to the order asked for
        mask = np.array(plain, bool)
        order = np.empty(len(found), np.int64)
        order[mask], order[~mask] = np.arange(len(fast)), len(fast) + np.arange(len(slow))
        pairs, bounds = gather(pairs, np.append(0, np.cumsum(groups)), order)
        numbers = np.stack([whole.astype(np.int64), n_a, n_b, groups])[:, order]
        one = np.ones(len(found), np.int64)
        return {"numbers": (numbers.T.reshape(-1), 4 * one), "groups": [texts[i] for i in order.tolist()], "pairs": (pairs, np.diff(bounds))}


@lru_cache(1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs array<long>, counts array<long>"
KINDS = {"block": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string()}
KINDS |= {"links": pa.binary(), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}


def align(docs: DataFrame, a_path: str, b_path: str, each: int = 8 << 20) -> DataFrame:
    """Rows of two kinds: one a document, with the places of its links' pairs in its block's list, and one a block, with that list and its counts.

    ``docs`` has ``doc_id`` and ``text``. A block is closed at ``each`` bytes of text.
    """

    def closed(block: int, held: list[dict], links: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, place, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
        place = place.astype("<u4")
        edges = np.cumsum([0, *(x["n_groups"] for x in held)]).tolist()
        rows = [x | {"block": block, "links": place[p:q].tobytes()} for x, p, q in zip(held, edges[:-1], edges[1:], strict=True)]
        yield from pa.Table.from_pylist(rows, schema=pa.schema(KINDS)).to_batches(max_chunksize=2000)
        yield pa.RecordBatch.from_pylist([{"block": block, "pairs": pairs, "counts": counts}], schema=pa.schema(KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        memo, block, size, held, links = aligner.memo, TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for rows, _ in K.parts(batch, "text", 1 << 20):
                texts = K.Texts(pc.binary_join_element_wise(pa.scalar(" "), rows.column("text").fill_null(""), ""))
                cuts, of = stretches(texts)
                data, cuts = texts.data.tobytes(), cuts.tolist()
                places = memo.places([data[p:q] for p, q in zip(cuts[:-1], cuts[1:], strict=True)])
                total = lambda x: np.diff(np.append(0, np.cumsum(x[places]))[of])  # noqa: B023, E731
                pairs, bounds = memo.of("pairs")
                whole, n_a, n_b, n_groups = (total(x) for x in memo.of("numbers")[0].reshape(-1, 4).T)
                whole = whole == np.diff(of)
                texts_of = memo.of("groups")
                for i, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                    mine = places[of[i] : of[i + 1]]
                    if whole[i]:
                        sha = hashlib.sha256(b"".join([texts_of[p] for p in mine.tolist()])[:-1]).hexdigest()
                        held.append({"doc_id": doc_id, "n_a": int(n_a[i]), "n_b": int(n_b[i]), "n_groups": int(n_groups[i]), "groups_sha256": sha})
                        links.append(gather(pairs, bounds, mine)[0])
                    else:
                        held.append({"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "groups_sha256": ""})
                size += len(data)
                if size >= each:
                    yield from closed(block, held, [*links, np.zeros(0, np.int64)])
                    block, size, held, links = block + 1, 0, [], []
        if held:
            yield from closed(block, held, [*links, np.zeros(0, np.int64)])

    return docs.mapInArrow(run, ALIGNED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, count, best`` over the corpus; ``best`` where no pair of the same B id counts more. ``blocks`` has lists of pairs and counts."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count"))
    each = materialize(each.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    most = each.groupBy("b").agg(F.max("count").alias("most"))
    return each.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row per row of ``docs``.

    A is a byte-level vocabulary (JSON) over a space and the text, B a piece model that adds the space itself. Texts that are null or empty, or
    whose tokens don't give back their bytes, have no tokens: zeros, and an empty digest. Equal rows are rows of their own, all of
    them counted; other columns are not looked at. A link's count is how often its two ids are linked in the whole corpus.
    """
    rows = materialize(align(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), a_path, b_path))
    blocks = rows.filter("pairs is not null").select("block", "pairs", "counts")
    counts = materialize(pair_counts(blocks))
    asked = blocks.select(F.col("block").alias("asks"), F.explode("pairs").alias("pair")).join(counts, "pair").select("asks", "pair", "count", "best")

    def add(mine: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("pair")  # every pair of the block is among them, so places are those of the block's list
        count = np.append(known.column("count").to_numpy(), 0)
        best = np.append(known.column("best").to_numpy().astype(np.int64), 0)
        links = [np.frombuffer(x, "<u4") for x in mine.column("links").to_pylist()]
        edges = np.cumsum([0, *map(len, links)])
        place = np.concatenate(links).astype(np.int64) if links else np.zeros(0, np.int64)
        total = lambda x: pa.array(np.diff(np.append(0, np.cumsum(x[place]))[edges]))
        kept = mine.select(["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
        return kept.append_column("n_links", pa.array(np.diff(edges))).append_column("n_best", total(best)).append_column("count_sum", total(count))

    own = rows.filter("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    out = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    found = own.groupBy("block").cogroup(asked.groupBy("asks")).applyInArrow(add, out)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
