"""Reference ledgers and summary metrics, in long form: one row per product, system and metric."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..functions.vectors import Model, embedded
from ..sources.stored import kept

WEIGHTS = {"coverage_weighted": 0.30, "sentiment_consistency": 0.20, "evidence_support": 0.25, "specificity": 0.15, "non_redundancy": 0.10}


def ledger(named: DataFrame) -> DataFrame:
    """Aspects of a product: salience, expected polarity (ties are mixed), rarity."""
    labels = ("positive", "negative", "neutral", "mixed")
    per = named.groupBy("product_id", "name").agg(
        F.count("*").alias("n"),
        F.countDistinct("review_id").alias("reviews"),
        F.array_sort(F.collect_set("aspect")).alias("aliases"),
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in labels],
    )
    top = F.greatest(*labels)
    leaders = sum(((F.col(s) == top).cast("int") for s in labels), F.lit(0))
    dominant = F.when(leaders > 1, "mixed")
    for s in labels:
        dominant = dominant.when(F.col(s) == top, s)
    whole = F.sum("n").over(Window.partitionBy("product_id"))
    return per.select(
        "product_id", "name", "aliases", "n", (F.col("n") / whole).alias("salience"), dominant.alias("expected"),
        ((F.col("n") <= 2) & (F.col("reviews") <= 2)).alias("rare"), *[(F.col(s) / F.col("n")).alias(f"share_{s}") for s in labels],
    )


def ledger_evidence(named: DataFrame, most: int = 5) -> DataFrame:
    """The first few mentions of an aspect, of one review and text only once."""
    key = X.strip(F.lower("span_text"))
    first = Window.partitionBy("product_id", "name", "review_id", "_key").orderBy("span_index", "aspect")
    rows = named.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
    order = Window.partitionBy("product_id", "name").orderBy("review_id", "span_index", "aspect")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return rows.select("product_id", "name", "rank", "review_id", "span_text", "section", "sentiment", "confidence")


TEXTS = ("text_overall", "text_neutral", "text_pros", "text_cons", "summary_text")


def with_flat(summary: DataFrame) -> DataFrame:
    """Adds ``flat``: the texts of a summary that aren't blank, then its key phrases (an array of texts), by line."""
    some = [F.nullif(X.strip(F.col(c)), F.lit("")) for c in TEXTS if c in summary.columns]
    phrases = [F.filter("key_phrases", lambda p: p != "")] if "key_phrases" in summary.columns else []
    return summary.withColumn("flat", F.concat_ws("\n", *some, *phrases))


def ledger_arrays(ledgers: DataFrame) -> DataFrame:
    """A product's ledger as one array, by name; a product has no more aspects than candidates."""
    names = F.array_distinct(F.concat(F.array(F.lower("name")), F.transform("aliases", lambda a: F.lower(a))))
    item = F.struct("name", F.filter(names, lambda n: n != "").alias("names"), "salience", "expected", F.lower("name").alias("low"), "aliases")
    return ledgers.groupBy("product_id").agg(F.array_sort(F.collect_list(item)).alias("ledger"))


def judged(ledgers: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each summary beside its product's ledger (empty where there is none): what all metrics read, without one row an aspect."""
    rows = with_flat(summaries).join(ledger_arrays(ledgers), "product_id", "left").withColumn("low", F.lower("flat"))
    kind = "array<struct<name:string,names:array<string>,salience:double,expected:string,low:string,aliases:array<string>>>"
    return rows.withColumn("ledger", F.coalesce("ledger", F.array().cast(kind)))


def _keys(summaries: DataFrame) -> list[str]:
    return [c for c in summaries.columns if c not in (*TEXTS, "key_phrases")]


def _inside(text: Column, aspect: Column) -> Column:
    return F.coalesce(F.exists(aspect["names"], lambda n: F.contains(text, n)), F.lit(False))


def _share(items: Column, holds) -> Column:
    return F.size(F.filter(items, holds)) / F.size(items)


def coverage(ledgers: DataFrame, summaries: DataFrame) -> DataFrame:
    """Share of the ledger's aspects that a summary names, plain and by salience; 1 where there are none."""
    rows, none = judged(ledgers, summaries), F.size("ledger") == 0
    hit = lambda x: _inside(F.col("low"), x)
    total = F.aggregate("ledger", F.lit(0.0), lambda s, x: s + x["salience"])
    found = F.aggregate("ledger", F.lit(0.0), lambda s, x: s + F.when(hit(x), x["salience"]).otherwise(0.0))
    weighted = F.when(total > 0, found / total).otherwise(_share(F.col("ledger"), hit))
    return rows.select(
        *_keys(summaries), F.when(none, 1.0).otherwise(_share(F.col("ledger"), hit)).alias("coverage"), F.when(none, 1.0).otherwise(weighted).alias("coverage_weighted")
    )


def normalized_weights(rows: DataFrame, weight: str, *by: str) -> DataFrame:
    """Weights to shares of their sum; all alike where it isn't above 0."""
    own = Window.partitionBy(*by)
    total = F.sum(weight).over(own)
    return rows.withColumn(weight, F.when(total > 0, F.col(weight) / total).otherwise(1.0 / F.count("*").over(own)))


GOOD, BAD = ("хорош", "отлич", "нрав", "+"), ("плох", "ужас", "минус")


def sentiment_consistency(ledgers: DataFrame, summaries: DataFrame, good: tuple = GOOD, bad: tuple = BAD) -> DataFrame:
    """Over named aspects: 1 for the expected polarity, 0 for its opposite, else one half; unknown ones don't count."""
    rows = judged(ledgers, summaries)
    low = {c: F.lower(F.coalesce(c, F.lit(""))) if c in summaries.columns else F.lit("") for c in TEXTS}
    frag = F.when(low["text_overall"] != "", low["text_overall"]).otherwise(low["text_neutral"])
    plus, minus = X.any_of(frag, good), X.any_of(frag, bad)

    def value(x: Column) -> Column:
        pros, cons = _inside(low["text_pros"], x), _inside(low["text_cons"], x)
        general = F.when(plus & ~minus, "positive").when(minus & ~plus, "negative")
        got = F.when(pros & cons, "mixed").when(pros, "positive").when(cons, "negative")
        got = got.when(_inside(low["text_overall"], x) | _inside(low["text_neutral"], x), general)
        opposite = got.isin("positive", "negative") & x["expected"].isin("positive", "negative")
        worth = F.when(got == x["expected"], 1.0).when(opposite, 0.0).otherwise(0.5)
        return F.when(got.isNotNull() & _inside(F.col("low"), x), worth)

    values = F.filter(F.transform("ledger", value), lambda v: v.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)
    return rows.select(*_keys(summaries), F.when(F.size(values) == 0, 1.0).otherwise(mean).alias("sentiment_consistency"))


def evidence_support(summaries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of a summary's claims with two words of four characters or more (repeats count) in one piece of evidence, and of the others.

    Words are what stands between white space. Without claims 1 and 0, without evidence 0 and 1.
    """
    rows = with_flat(summaries).withColumn("claims", X.claims(X.strip(F.lower("flat"))))
    rows = rows.withColumn("claims", F.transform("claims", lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 3)))
    texts = evidence.filter(X.strip(F.col("span_text")) != "").groupBy("product_id").agg(F.collect_set(F.lower("span_text")).alias("texts"))
    held = lambda words: F.exists("texts", lambda t: F.size(F.filter(words, lambda w: F.contains(t, w))) >= 2)
    rows = rows.join(texts, "product_id", "left")
    rate = F.when(F.size("claims") == 0, 1.0).when(F.col("texts").isNull(), 0.0).otherwise(_share(F.col("claims"), held))
    return rows.select(*_keys(summaries), rate.alias("evidence_support")).withColumn("unsupported_rate", 1 - F.col("evidence_support"))


def specificity(ledgers: DataFrame, summaries: DataFrame, generic: tuple = L.GENERIC_TOKENS) -> DataFrame:
    """.6 of the share of words that aren't generic and .4 of the share of aspects named (one half without aspects)."""
    rows = judged(ledgers, summaries)
    words = F.filter(F.split("low", r"\s+"), lambda w: F.length(w) > 2)
    content = F.size(F.filter(words, lambda w: ~w.isin(*generic))) / F.size(words)
    hits = F.when(F.size("ledger") == 0, 0.5).otherwise(_share(F.col("ledger"), lambda x: _inside(F.col("low"), x)))
    return rows.select(*_keys(summaries), F.when(F.size(words) == 0, 0.0).otherwise(0.6 * content + 0.4 * hits).alias("specificity"))


def aspect_balance(ledgers: DataFrame, summaries: DataFrame) -> DataFrame:
    """1 less the Jensen-Shannon distance (base 2) of salience and mentions; counts don't overlap, each plus .001. 1 without aspects or text."""
    rows = judged(ledgers, summaries)
    count = lambda n: F.when(F.length(n) > 0, (F.length("low") - F.length(F.replace(F.col("low"), n, F.lit("")))) / F.length(n)).otherwise(0.0)
    hits = lambda x: F.aggregate(F.concat(F.array(x["low"]), F.transform(x["aliases"], lambda a: F.lower(a))), F.lit(0.001), lambda s, n: s + count(n))
    rows = rows.withColumn("h", F.transform("ledger", hits)).withColumn("w", F.transform("ledger", lambda x: x["salience"]))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("ht", total("h")).withColumn("wt", total("w"))
    half = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def apart(w: Column, h: Column) -> Column:
        p, q = w / F.col("wt"), h / F.col("ht")
        m = (p + q) / 2
        return (half(p, m) + half(q, m)) / 2

    js = F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with("w", "h", apart))))
    value = F.when((F.size("ledger") == 0) | (X.strip(F.col("flat")) == ""), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - js))
    return rows.select(*_keys(summaries), value.alias("aspect_balance"))


def non_redundancy(summaries: DataFrame) -> DataFrame:
    """Share of claims that differ; 1 for one or none."""
    rows = with_flat(summaries).withColumn("c", X.claims(X.strip(F.lower(F.replace(F.col("flat"), F.lit("\n"), F.lit(" "))))))
    value = F.when(F.size("c") <= 1, 1.0).otherwise(F.size(F.array_distinct("c")) / F.size("c"))
    return rows.select(*_keys(summaries), value.alias("non_redundancy"))


def non_redundancy_by_vectors(claims: DataFrame, keys: list[str], order: str, vector: str, least: float = 0.92) -> DataFrame:
    """The same over vectors of claims: a claim starts a cluster unless an earlier start is as near as ``least`` (cosine).

    One array a summary: its claims are few.
    """
    rows = claims.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, vector))).alias("c"))
    near = lambda a, b: X.cosine(a, b) >= least
    start = F.array(F.get("c", 0)[vector])
    starts = F.aggregate(
        F.slice("c", 2, F.size("c")), start, lambda kept, x: F.when(F.exists(kept, lambda k: near(k, x[vector])), kept).otherwise(F.concat(kept, F.array(x[vector])))
    )
    return rows.select(*keys, F.when(F.size("c") <= 1, 1.0).otherwise(F.size(starts) / F.size("c")).alias("non_redundancy"))


def supported_by_vectors(claims: DataFrame, evidence: DataFrame, keys: list[str], vector: str, least: float = 0.55, parts: int = 32) -> DataFrame:
    """Share of claims whose nearest piece of evidence of the product is as near as ``least`` (cosine); bounds as in ``evidence_support``.

    A product's claims are dealt out to ``parts`` groups, each of which gets its evidence: there two blocks of vectors meet as a product of
    matrices. What comes out within rounding of ``least`` is judged by ``cosine``.
    """
    names = list(dict.fromkeys(["product_id", *keys]))
    whole = F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector)).alias("_vector")
    one = claims.select(*names, whole, F.pmod(F.xxhash64(*claims.columns), F.lit(parts)).cast("int").alias("_part"))
    two = evidence.filter("product_id is not null").select("product_id", whole, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    two = two.filter("_vector is not null")
    schema = type(one.schema)([one.schema[n] for n in names]).add("_claims", "long").add("_held", "long")

    def by_length(rows: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Vectors of each length, with their places; those of different lengths aren't compared."""
        sizes = np.array([-1 if v is None else len(v) for v in rows], int)
        return {n: (np.flatnonzero(sizes == n), np.stack([np.asarray(v, float) for v in rows[sizes == n]])) for n in set(sizes.tolist()) - {-1, 0}}

    def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Summed component by component, as ``text.cosine`` does."""
        dot = lambda x, y: np.cumsum(x * y, axis=-1)[..., -1]
        return dot(a, b) / ((np.sqrt(dot(a, a)) + 1e-9) * (np.sqrt(dot(b, b)) + 1e-9))

    def held(mine: np.ndarray, theirs: np.ndarray, block: int = 1024) -> np.ndarray:
        length = lambda x: np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        out = np.zeros(len(mine), bool)
        a, b = mine / length(mine), theirs / length(theirs)
        for at in range(0, len(a), block):
            for to in range(0, len(b), block):
                found = a[at : at + block] @ b[to : to + block].T
                out[at : at + block] |= ((found > least + 1e-9) | np.isnan(found)).any(1)  # NaN is more than any number
                i, j = np.nonzero((np.abs(found - least) <= 1e-9) & ~out[at : at + block, None])
                if len(i):
                    out[at + i[cosine(mine[at + i], theirs[to + j]) >= least]] = True
        return out

    def judge(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        ok, proof = np.zeros(len(mine), np.int64), by_length(theirs["_vector"])
        with np.errstate(invalid="ignore"):
            for n, (at, vectors) in by_length(mine["_vector"]).items():
                if n in proof:
                    ok[at] = held(vectors, proof[n][1])
        return mine[names].assign(_claims=1, _held=ok).groupby(names, dropna=False, as_index=False).sum()

    judged = one.groupBy("product_id", "_part").cogroup(two.groupBy("product_id", "_part")).applyInPandas(judge, schema)
    return judged.groupBy(*keys).agg((F.sum("_held") / F.sum("_claims")).alias("evidence_support"))


def overall(metrics: DataFrame) -> DataFrame:
    total = sum(WEIGHTS.values())
    return metrics.withColumn("overall", sum((F.col(m) * (w / total) for m, w in WEIGHTS.items()), F.lit(0.0)))


def glass_box(planned: DataFrame, summaries: DataFrame) -> DataFrame:
    """Share of planned aspects that the text names, and of claims that name a planned aspect."""
    names = planned.groupBy("product_id").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("names"))
    rows = with_flat(summaries).join(names, "product_id").withColumn("low", F.lower("flat")).withColumn("claims", X.claims(X.strip(F.lower("flat"))))
    shown = F.size(F.filter("names", lambda n: F.contains(F.col("low"), n)))
    hit = F.size(F.filter("claims", lambda c: F.exists("names", lambda n: F.contains(c, n))))
    return rows.select(
        *_keys(summaries), (shown / F.greatest(F.size("names"), F.lit(1))).alias("plan_reflected"), (hit / F.greatest(F.size("claims"), F.lit(1))).alias("claims_planned")
    )


def all_metrics(
    ledgers: DataFrame, summaries: DataFrame, evidence: DataFrame, good: tuple = GOOD, bad: tuple = BAD, generic: tuple = L.GENERIC_TOKENS
) -> DataFrame:
    """All of a summary's metrics; its key columns (all but the texts) must tell summaries apart."""
    keys, out = _keys(summaries), coverage(ledgers, summaries)
    for part in (
        sentiment_consistency(ledgers, summaries, good, bad), evidence_support(summaries, evidence), specificity(ledgers, summaries, generic),
        aspect_balance(ledgers, summaries), non_redundancy(summaries),
    ):
        out = out.join(part, keys, "left")
    return overall(out)


def long_form(metrics: DataFrame, system: Column | str) -> DataFrame:
    names = [c for c, kind in metrics.dtypes if kind == "double"]
    keys = [c for c in metrics.columns if c not in names]
    return metrics.unpivot(keys, names, "metric", "value").withColumn("system", F.lit(system))


def numeric(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose column is a number, as a double: texts count where they spell one, truth values and nulls don't."""
    value = F.col(column).try_cast("double")
    return rows.withColumn(column, value).filter(F.col(column).isNotNull())


def system_means(rows: DataFrame) -> DataFrame:
    """Means by system and metric; what isn't a number doesn't count."""
    return numeric(rows, "value").groupBy("system", "metric").agg(F.avg("value").alias("mean"))


def functional_comparison(rows: DataFrame) -> DataFrame:
    """How many of its functions (all columns but the first) each system has; ``yes`` marks one."""
    name, *marks = rows.columns
    return rows.select(name, sum((F.col(m) == "yes").cast("int") for m in marks).cast("long").alias("functions"))


def metric_chart(rows: DataFrame) -> DataFrame:
    """The frame of a bar chart: a row a metric, a column a system, by metric."""
    means = kept(system_means(rows))  # read twice
    systems = sorted(r.system for r in means.select("system").distinct().collect())  # a handful
    return means.groupBy("metric").pivot("system", systems).agg(F.first("mean"))


def judge_lines(ledgers: DataFrame, evidence: DataFrame, most: int = 2) -> DataFrame:
    """A line an aspect for a judge: name, expected polarity, salience, some evidence."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "span_text"))), lambda x: x["span_text"])
    proof = evidence.groupBy("product_id", "name").agg(F.array_join(F.slice(texts, 1, most), " | ").alias("proof"))
    rows = ledgers.join(proof, ["product_id", "name"], "left")
    line = F.format_string("- %s (expected %s, salience %s): %s", "name", "expected", F.format_number("salience", 3), F.coalesce("proof", F.lit("")))
    return rows.select("product_id", "name", line.alias("line"))


def pseudo_reference(evidence: DataFrame, most: int = 50) -> DataFrame:
    """A product's reference text: its first pieces of evidence, by aspect and rank."""
    order = Window.partitionBy("product_id").orderBy("name", "rank")
    rows = evidence.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_n", "span_text"))), lambda x: x["span_text"])
    return rows.groupBy("product_id").agg(F.array_join(texts, "\n").alias("reference"))


def pairwise_winner(votes: DataFrame) -> DataFrame:
    """Answers A, B or tie of two rounds (ours is A in the first, B in the second) to a winner: ours, external or tie.

    A side wins with more votes than the other; null answers don't vote, and without any vote there is no winner.
    """
    def side(answer: str, ours: str) -> Column:
        low = F.upper(F.trim(answer))
        return F.when(low == "TIE", "tie").when(low == ours, "ours").when(low.isin("A", "B"), "external")

    rows = votes.withColumn("first_winner", side("first", "A")).withColumn("second_winner", side("second", "B"))
    count = lambda who: F.coalesce((F.col("first_winner") == who).cast("int"), F.lit(0)) + F.coalesce((F.col("second_winner") == who).cast("int"), F.lit(0))
    ours, external = count("ours"), count("external")
    some = F.col("first_winner").isNotNull() | F.col("second_winner").isNotNull()
    return rows.withColumn("winner", F.when(some, F.when(ours > external, "ours").when(external > ours, "external").otherwise("tie")))


def reference_cosine(pairs: DataFrame, model: Model, text: str = "flat", reference: str = "reference") -> DataFrame:
    """Adds ``embedding_cosine_reference``: how near a text's vector is to its reference's. Null where one of them is blank or null.

    Each different reference is embedded once; ``pairs`` has a row a text, beside its reference.
    """
    references = pairs.select(reference).distinct()
    vectors = embedded(references, reference, model, "_there").select(F.col(reference).alias("_of"), "_there")
    rows = embedded(pairs, text, model, "_here").join(vectors, F.col(reference).eqNullSafe(F.col("_of")))
    blank = (F.coalesce(X.strip(F.col(text)), F.lit("")) == "") | (F.coalesce(X.strip(F.col(reference)), F.lit("")) == "")
    return rows.withColumn("embedding_cosine_reference", F.when(~blank, X.cosine(F.col("_here"), F.col("_there")))).drop("_here", "_there", "_of")


def token_alignment(pairs: DataFrame, model: Model, text: str = "flat", reference: str = "reference", block: int = 1024) -> DataFrame:
    """Adds ``precision``, ``recall`` and ``f1`` of a greedy alignment of two texts' token vectors: each token meets its nearest on the other side.

    Precision is the mean over the text's tokens, recall over the reference's, repeats counted; null where one side has no token. Distinct tokens are
    embedded once a task, their cosines taken ``block`` by ``block``.
    """
    rows = pairs.withColumns({"_a": X.tokens(F.col(text)), "_b": X.tokens(F.col(reference))})
    kept = [c for c in rows.columns if c not in ("_a", "_b")]
    schema = pairs.withColumns({c: F.lit(None).cast("double") for c in ("precision", "recall", "f1")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed, known = model(), {}

        def units(tokens: list[str]) -> np.ndarray:
            if len(known) > 100_000:
                known.clear()
            new = [t for t in tokens if t not in known]
            if new:
                found = np.asarray(embed(new), float)
                known.update(zip(new, found / (np.linalg.norm(found, axis=1, keepdims=True) + 1e-9), strict=True))
            return np.stack([known[t] for t in tokens])

        def best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.concatenate([(a[i : i + block] @ b.T).max(1) for i in range(0, len(a), block)])

        for batch in batches:
            out = []
            for x, y in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True):
                if not x or not y:
                    out.append((None, None, None))
                    continue
                (tx, nx), (ty, ny) = (tuple(zip(*Counter(t).items(), strict=True)) for t in (x, y))
                a, b = units(list(tx)), units(list(ty))
                p, r = float(np.average(best(a, b), weights=nx)), float(np.average(best(b, a), weights=ny))
                out.append((p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0))
            added = [pa.array(c, pa.float64()) for c in zip(*out, strict=True)] if out else [pa.nulls(0, pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *added], names=[*kept, "precision", "recall", "f1"])

    return rows.mapInArrow(run, schema)


def semantic_coverage(ledgers: DataFrame, summaries: DataFrame, model: Model, least: float = 0.72) -> DataFrame:
    """Coverage where an aspect also counts as named if one of its names is as near to the summary as ``least`` in vectors.

    ``nearest`` is the mean over aspects not named of the nearest name's cosine (null where all are named). A blank summary is near to nothing.
    """
    rows = judged(ledgers, summaries)
    keys = _keys(summaries)
    each = rows.select(*keys, "flat", F.explode("ledger").alias("x"))
    each = each.select(*keys, "flat", "x.name", "x.salience", _inside(F.lower("flat"), F.col("x")).alias("named"), F.concat(F.array("x.name"), "x.aliases").alias("labels"))
    labels = each.filter("not named").select(F.explode("labels").alias("label")).distinct()
    vectors = embedded(labels, "label", model, "_label")
    texts = embedded(with_flat(summaries).select(*keys, "flat"), "flat", model, "_text").select(*keys, "_text")
    asked = each.filter("not named and flat <> ''").select(*keys, "name", F.explode("labels").alias("label"))
    near = asked.join(vectors, "label").join(texts, keys).groupBy(*keys, "name").agg(F.max(X.cosine(F.col("_label"), F.col("_text"))).alias("near"))
    got = each.join(near, [*keys, "name"], "left").withColumn("covered", F.col("named") | F.coalesce(F.col("near") >= least, F.lit(False)))
    share = F.sum(F.when(F.col("covered"), F.col("salience")).otherwise(0.0)) / F.sum("salience")
    per = got.groupBy(*keys).agg(
        F.avg(F.col("covered").cast("double")).alias("coverage"),
        F.when(F.sum("salience") > 0, share).otherwise(F.avg(F.col("covered").cast("double"))).alias("coverage_weighted"),
        F.avg("near").alias("nearest"),
    )
    return summaries.select(*keys).join(per, keys, "left").fillna(1.0, ["coverage", "coverage_weighted"])


def latest_trees(ledgers: DataFrame, items: DataFrame, key: str = "ledger_id", by: str = "product_id", created: str = "created_at") -> DataFrame:
    """The newest ledger of each product with its items as one array."""
    newest = Window.partitionBy(by).orderBy(F.desc_nulls_last(created), F.desc(key))
    rows = ledgers.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1).drop("_n")
    rest = [c for c in items.columns if c != key]
    gathered = items.join(rows.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("items"))
    return rows.join(gathered, key, "left")
