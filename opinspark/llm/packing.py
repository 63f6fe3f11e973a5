"""Packing documents into token sequences of one length, by cutting-stock column generation.

A document is cut into whole sequences and a rest. Rests are counted by length class, a linear program over patterns (how
many rests of each class fill a sequence) is solved by column generation, its columns priced by an unbounded knapsack over the
dual values, and the rounded patterns take the rests of each class in ranked order. Patterns are taken a little short: the
rests left over are poured, cut where need be, into the room that rounding to classes left in the sequences, and what
is over after that fills sequences of its own, the last one as powers of two. So next to nothing is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import global_order, materialize
from .memo import Columns, Memo, gather, joined, merger, tokenizer, vocabulary

MARK = "\x01"  # stands for the end of a word
# any but plain characters: those that are their own composed form, whose lower case doesn't depend on neighbours, and whose kind all Unicode versions agree on
OTHER = re.compile("[^\n!-;=-~\u00a1-\u012f\u0131-\u02af\u0391-\u03a1\u03a4-\u03c9\u0400-\u0482\u048a-\u04ff\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]")


@lru_cache(4)
def word_ids(path: str) -> Memo:
    """Token ids of words between ASCII white space, under ``ids``. The tokenizer must drop white space and see no word beyond it.

    New words of plain characters go through the merges together, as one long run of marked words; all others through the tokenizer itself.
    """
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    steps = [x["type"] for x in (known["normalizer"] or {}).get("normalizers", [])]
    split = ((known["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    ending = known["model"].get("end_of_word_suffix") or ""
    special = all(x["content"].startswith("<") for x in known["added_tokens"])  # no plain character
    encode = tokenizer(path, False).encode_batch
    merges = words = None
    if steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("behavior") == "Removed" and ending and special:
        merges = merger(path, f"[^{MARK}]+{MARK}", ending, MARK.encode())
        words = regex.compile(split["pattern"]["Regex"])
        ends = np.array([last for _, last in vocabulary(path, ending)] + [False])

    def make(new: list[bytes]) -> Columns:
        line = b"\n".join(new).decode()
        texts = line.split("\n") if new else []
        mask = np.full(len(new), merges is not None)
        mask[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), [m.start() for m in OTHER.finditer(line)], "right")] = False
        plain = mask.tolist()
        marked = words.sub(rf"\g<0>{MARK}", "\n".join([t for t, ok in zip(texts, plain, strict=True) if ok]).lower()) if any(plain) else ""
        ids = np.array(merges.encode_ordinary(marked.replace("\n", "")) if marked else [], np.int64)
        shown = np.frombuffer(marked.encode(), np.uint8)
        pieces = np.cumsum(shown == ord(MARK))[np.append(np.flatnonzero(shown == ord("\n")), len(shown) - 1)] if marked else np.zeros(0, np.int64)
        stops = np.append(0, np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1) if marked else np.zeros(1, np.int64)
        first = stops[np.append(0, pieces)].astype(np.int64)
        rest, sizes = joined([x.ids for x in encode([t for t, ok in zip(texts, plain, strict=True) if not ok], add_special_tokens=False)])
        order = np.empty(len(new), np.int64)
        order[mask], order[~mask] = np.arange(mask.sum()), mask.sum() + np.arange((~mask).sum())
        bounds = np.concatenate([first, first[-1] + np.cumsum(sizes)]).astype(np.int64)
        values, bounds = gather(np.concatenate([ids, rest]), bounds, order)
        return {"ids": (values.astype(np.uint32), np.diff(bounds))}

    return Memo(make)


TOKENIZED = "row long, source_part int, full_before long, doc_id long, n_tokens long, checks array<long>, rest int, rest_crc32 long, rest_ids binary, ord long"


def tokenize(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """A row a document: its number of ids with the ``end`` id, checksums of its whole sequences and its rest, and the rest's ids.

    ``row`` tells rows apart, ``full_before`` counts the whole sequences of the same input part before, ``ord`` is a hash of ``row``.
    """
    kinds = {"row": pa.int64(), "source_part": pa.int32(), "full_before": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "checks": pa.list_(pa.int64())}
    kinds |= {"rest": pa.int32(), "rest_crc32": pa.int64(), "rest_ids": pa.binary(), "ord": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, full = TaskContext.get().partitionId(), 0, 0
        memo = word_ids(path)
        for batch in batches:
            for rows, texts in K.parts(batch, "text", 1 << 20):
                words = K.Words(texts, K.SOLID, False)
                data, n = texts.data.tobytes(), len(texts)
                places = memo.places([data[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)])
                ids, bounds = gather(*memo.of("ids"), places)
                begin = bounds[words.of]
                ids = np.insert(ids, begin[1:], end).astype("<u4")  # the end id after each document's own
                begin = begin + np.arange(n + 1)
                row = (np.int64(part) << 33) + np.arange(at, at + n)
                out = {"row": row, "source_part": np.full(n, part), "doc_id": rows.column("doc_id"), "ord": K.mix(row.astype(np.uint64)).view(np.int64)}
                out |= {c: [] for c in kinds if c not in out}
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    whole = (b - a) // capacity
                    rest = ids[a + whole * capacity : b].tobytes()
                    out["full_before"].append(full)
                    out["n_tokens"].append(b - a)
                    out["checks"].append([zlib.crc32(ids[i : i + capacity]) for i in range(a, a + whole * capacity, capacity)])
                    out["rest"].append(len(rest) // 4)
                    out["rest_crc32"].append(zlib.crc32(rest))
                    out["rest_ids"].append(rest)
                    full += whole
                at += n
                yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in kinds.items()], names=list(kinds))

    return docs.mapInArrow(run, TOKENIZED)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of ``sizes`` that fits into ``room``: an unbounded knapsack by dynamic programming."""
    value, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        fits = np.searchsorted(sizes, r, "right")  # sizes ascend
        value[r] = value[r - 1]
        if fits:
            got = prices[:fits] + value[r - sizes[:fits]]
            i = int(got.argmax())
            if got[i] > value[r]:
                value[r], pick[r] = got[i], i
    counts, r = np.zeros(len(sizes)), room
    while r > 0:
        if pick[r] < 0:
            r -= 1
        else:
            counts[pick[r]] += 1
            r -= int(sizes[pick[r]])
    return float(value[room]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-4, rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each, counts by size) and how often to use each (a fraction), so that every demand is met exactly.

    Column generation by the revised simplex method, begun with patterns of one size each. It ends when the bound that a pricing round gives
    (the sum of uses over the best pattern's price) says that no solution saves more than the share ``gap``.
    """
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    uses = inverse @ demand
    for turn in range(rounds):
        price, column = best_pattern(inverse.sum(axis=0), sizes, room)
        if price <= 1 + gap:
            break
        step = inverse @ column
        ratio = np.full(m, np.inf)
        some = step > 1e-9
        ratio[some] = uses[some] / step[some]
        out = int(ratio.argmin())
        uses = np.maximum(uses - ratio[out] * step, 0)
        uses[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        if turn % 200 == 199:  # against drift
            inverse = np.linalg.inv(basis)
            uses = np.maximum(inverse @ demand, 0)
    return basis.T, uses


def whole_uses(patterns: np.ndarray, uses: np.ndarray, demand: np.ndarray, mean: np.ndarray, capacity: int) -> np.ndarray:
    """Whole uses, short by such a share that the rests left over can fill what room is left."""
    tokens = patterns @ mean
    waste = 1 - float(uses @ tokens) / max(float(uses.sum()) * capacity, 1e-9)
    short = max(0.0, min(waste, 0.5))
    number = np.floor(uses * (1 - short) + 1e-9)
    over = number @ patterns > demand + 1e-6  # rounding errors of the solver
    while over.any():
        number[(patterns[:, over] > 0).any(axis=1) & (number > 0)] -= 1
        over = number @ patterns > demand + 1e-6
    return number.astype(np.int64)


def _overlaps(room: DataFrame, filler: DataFrame, block: int) -> DataFrame:
    """Stretches of the running total that a row of both covers. Stretches are short against ``block``, so each lies in a few blocks."""
    blocks = lambda x, a, b: x.withColumn("block", F.explode(F.expr(f"sequence({a} div {block}, ({b} - 1) div {block})")))
    both = blocks(room.filter("r1 > r0"), "r0", "r1").join(blocks(filler.filter("f1 > f0"), "f0", "f1"), "block")
    both = both.withColumns({"low": F.greatest("r0", "f0"), "high": F.least("r1", "f1")})
    return both.filter(f"high > low and low div {block} = block")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 2, width: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row a piece, each id in exactly one piece.

    A null text is an empty one: the ``end`` id alone. ``doc_id`` may be null or repeat (``row`` tells rows apart); an empty table gives an
    empty one; other columns are not looked at. Ties of rank can't be: ranks go by a hash of ``row``. To the driver come at
    most ``capacity / width`` counts, whatever the size of the table.
    """
    rows = materialize(tokenize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), path, capacity, end))
    rests = rows.filter("rest > 0").withColumn("class", F.ceil(F.col("rest") / width).cast("int"))
    counted = rests.groupBy("class").agg(F.count("*").alias("n"), F.sum("rest").alias("tokens")).orderBy("class").collect()  # one row a class
    sizes, demand, tokens = (np.array([r[c] for r in counted], np.int64) for c in ("class", "n", "tokens"))
    patterns, uses = cutting_stock(sizes, demand.astype(float), capacity // width) if len(sizes) else (np.zeros((0, 0)), np.zeros(0))
    number = whole_uses(patterns, uses, demand, tokens / np.maximum(demand, 1), capacity)
    sequences = int(number.sum())

    # which ranks of each class go to which sequences
    spans, used, first = [], np.zeros(len(sizes), np.int64), np.cumsum(number) - number
    for p, n in enumerate(number.tolist()):
        for i in np.flatnonzero(patterns[p]) if n else ():
            take = n * round(float(patterns[p][i]))
            spans.append((int(sizes[i]), int(used[i]), int(used[i]) + take, int(first[p]), n))
            used[i] += take
    spark = docs.sparkSession
    dealt = spark.createDataFrame(spans, "in_class int, low long, high long, first long, n long")  # at most the square of the number of classes
    begins = spark.createDataFrame(list(zip(sizes.tolist(), (np.cumsum(demand) - demand).tolist(), strict=True)), "class int, begins long")
    ranked = global_order(rests.select("class", "ord", "row", "doc_id", "n_tokens", "rest", "rest_crc32"), ["class", "ord"], [])
    ranked = ranked.join(F.broadcast(begins), "class").withColumn("rank", F.col("row_index") - F.col("begins"))
    within = (F.col("class") == F.col("in_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    sequence = (F.col("first") + (F.col("rank") - F.col("low")) % F.col("n")).alias("sequence_id")
    placed = materialize(ranked.join(F.broadcast(dealt), within, "left").select("class", "ord", "row", "doc_id", "n_tokens", "rest", "rest_crc32", sequence))
    before = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)  # a sequence's rows: capacity / width at most
    offset = F.coalesce(F.sum("rest").over(before), F.lit(0)).alias("offset")
    length = F.col("rest").cast("long").alias("length")
    start = F.col("n_tokens") - F.col("rest")
    patterned = materialize(
        placed.filter("sequence_id is not null").select("row", "doc_id", start.alias("start"), length, F.col("rest_crc32").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", offset)
    )

    # the rests left over are poured into the room that is left, then into sequences of their own
    left = placed.filter("sequence_id is null")
    f0, r0 = F.col("rest_before"), F.col("spare_before")
    filler = global_order(left.select("row", "rest"), ["row"], ["rest"]).select("row", f0.alias("f0"), (f0 + F.col("rest")).alias("f1"))
    spare = patterned.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("spare", capacity - F.col("used")).filter("spare > 0")
    spare = materialize(global_order(spare, ["sequence_id"], ["spare"]).select("sequence_id", "used", r0.alias("r0"), (r0 + F.col("spare")).alias("r1")))
    held = spare.agg(F.coalesce(F.max("r1"), F.lit(0))).first()[0]
    full, last = divmod(max(0, left.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0] - held), capacity)
    at = held + F.col("id") * capacity
    own = spark.range(full).select((F.col("id") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("used"), at.alias("r0"), (at + capacity).alias("r1"))
    tail, at = [], held + full * capacity
    for size in (1 << k for k in reversed(range(capacity.bit_length())) if last >> k & 1):
        tail.append((sequences + full + len(tail), 0, at, at + size))
        at += size
    own = own.unionByName(spark.createDataFrame(tail, "sequence_id long, used long, r0 long, r1 long"))
    poured = _overlaps(spare.unionByName(own), filler, capacity).select(
        "row", (F.col("low") - F.col("f0")).alias("at"), (F.col("high") - F.col("low")).alias("length"), "sequence_id", (F.col("used") + F.col("low") - F.col("r0")).alias("offset")
    )
    lowest = left.groupBy("class").agg(F.min("ord").alias("lowest"))  # one row a class: what was left over ranks last
    ids = rests.join(F.broadcast(lowest), "class").filter("ord >= lowest").select("row", "doc_id", "n_tokens", "rest", "rest_ids")
    columns = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stretch = zip(*(batch.column(c).to_pylist() for c in ("rest_ids", "at", "length")), strict=True)
            crc = pa.array([zlib.crc32(x[4 * a : 4 * (a + n)]) for x, a, n in stretch], pa.int64())
            yield pa.RecordBatch.from_arrays([crc if c == "ids_crc32" else batch.column(c) for c in columns], names=columns)

    poured = (
        poured.join(ids, "row")
        .select("row", "doc_id", (start + F.col("at")).alias("start"), "length", F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset", "rest_ids", "at")
        .mapInArrow(checked, patterned.select(columns).schema)
    )

    # whole sequences of one document come after all others
    fulls = rows.groupBy("source_part").agg(F.max(F.expr(f"full_before + n_tokens div {capacity}")).alias("fulls"))
    earlier = F.sum("fulls").over(Window.orderBy("source_part").rowsBetween(Window.unboundedPreceding, -1))
    fulls = fulls.select("source_part", (F.coalesce(earlier, F.lit(0)) + F.lit(sequences + full + len(tail))).alias("base"))  # one row an input part
    whole = (
        rows.filter(f"n_tokens >= {capacity}")
        .join(F.broadcast(fulls), "source_part")
        .select("row", "doc_id", "n_tokens", (F.col("base") + F.col("full_before")).alias("first"), F.posexplode("checks").alias("nth", "ids_crc32"))
    )
    whole = whole.select(
        "row", "doc_id", (F.col("nth").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32",
        F.col("n_tokens").alias("doc_tokens"), (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return whole.unionByName(patterned).unionByName(poured)
