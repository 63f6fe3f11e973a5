"""Summarization methods by name, the model hook, and what is stored of a summary."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from . import aspects as A
from .folds import label_clusters, representative, stratified
from .ngrams import bigrams_and_trigrams

Model = Callable[[str], str]


def with_model(df: DataFrame, prompt: str, model: Model, out: str = "answer", tries: int = 3) -> DataFrame:
    """Adds a model's answer to a prompt column; null after ``tries`` failures. The model runs on the executors."""
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def ask(text: str) -> str | None:
        for _ in range(tries):
            try:
                return model(text)
            except Exception:  # noqa: BLE001  any failure of a plug-in counts as a try
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: [ask(p) for p in batch[prompt]]})

    return df.mapInPandas(run, schema)


def echo_model(prompt: str) -> str:
    """A deterministic stand-in: the words of the prompt, counted, as JSON."""
    words = re.findall(r"\w+", prompt.lower())
    return "```json\n" + json.dumps({"positive": " ".join(words[:5]), "negative": "", "general": str(len(words))}, ensure_ascii=False) + "\n```"


def answer_json(c, schema: str):
    """The outermost object in an answer, fences or not; null if it doesn't parse."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)


def prompt_of(planned: DataFrame, found: DataFrame, most_aspects: int = 8, most_evidence: int = 3, only: str | None = None) -> DataFrame:
    """One JSON prompt per product: planned aspects with some evidence each; ``only`` those of one target, all where a product has none."""
    texts = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "span_text"))), lambda x: x["span_text"]), 1, most_evidence)
    per = found.groupBy("product_id", "name").agg(texts.alias("evidence"))
    rows = planned.select("product_id", "name", "target", F.col("rank").alias("place")).join(per, ["product_id", "name"])
    gathered = rows.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("place", "name", "target", "evidence"))).alias("items"))
    items = F.col("items")
    if only is not None:
        own = F.filter("items", lambda x: x["target"] == only)
        items = F.when(F.size(own) > 0, own).otherwise(items)
    return gathered.select("product_id", F.to_json(F.slice(items, 1, most_aspects)).alias("prompt"))


SECTIONS = {"positive": ("P", "text_pros"), "negative": ("N", "text_cons"), "general": ("G", "text_neutral")}


def generate(texts: DataFrame, model: Model, tries: int = 3) -> DataFrame:
    """A model's three sections of a product's summary, asked for one by one; a section that fails keeps the grounded text.

    ``partial`` says that any did; where all fail, the whole grounded text stands. The model answers with ``{"text": ...}``.
    """
    out = texts.select("product_id", *[F.coalesce(c, F.lit("")).alias(c) for _, c in SECTIONS.values()])
    for name, (mark, column) in SECTIONS.items():
        prompt = F.concat_ws("\t", F.col("product_id").cast("string"), F.lit(mark), F.col(column))
        out = with_model(out.withColumn("_prompt", prompt), "_prompt", model, f"_{name}", tries).drop("_prompt")
        out = out.withColumn(f"_{name}", answer_json(F.col(f"_{name}"), "text string")["text"])
    partial = F.col("_positive").isNull() | F.col("_negative").isNull() | F.col("_general").isNull()
    return out.select("product_id", *[F.coalesce(f"_{n}", c).alias(n) for n, (_, c) in SECTIONS.items()], partial.alias("partial"))


def verify_texts(texts: DataFrame, model: Model, tries: int = 3) -> DataFrame:
    """A model's verdict on a text, with a revised one where it fails; without an answer after ``tries`` the text counts as valid (``assumed``)."""
    prompt = F.concat_ws("\t", F.col("product_id").cast("string"), F.concat_ws("\n", "text_overall", "text_pros", "text_cons", "text_neutral"))
    rows = with_model(texts.withColumn("_prompt", prompt), "_prompt", model, "_answer", tries)
    said = answer_json(F.col("_answer"), "passed boolean, revised string")
    assumed = said["passed"].isNull()
    rows = rows.withColumns({"assumed": assumed, "passed": F.coalesce(said["passed"], F.lit(True)), "revised": F.when(~F.coalesce(said["passed"], F.lit(True)), said["revised"])})
    return rows.drop("_prompt", "_answer")


def stub(reviews: DataFrame, overall: bool = False) -> DataFrame:
    """Counts, and the first three pluses and minuses by id; or, ``overall``, those as one text. Only three of each are gathered."""
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("said")) for c in ("plus", "minus")])).alias("x")
    said = reviews.select("product_id", "review_id", sides).select("product_id", "review_id", "x.*").filter("said <> ''")
    first = Window.partitionBy("product_id", "side").orderBy("review_id", "said")
    said = said.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 3)
    of = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("_n", "said")))), lambda x: x["said"]), "; ")
    texts = said.groupBy("product_id").agg(of("plus").alias("pros"), of("minus").alias("cons"))
    rows = reviews.groupBy("product_id").agg(F.count("*").alias("reviews_count"), F.avg("rating").alias("rating_avg")).join(texts, "product_id", "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    if overall:
        return rows.select("product_id", "reviews_count", "rating_avg", F.concat_ws("\n", some("pros"), some("cons")).alias("text_overall"))
    return rows.select("product_id", "reviews_count", "rating_avg", some("pros").alias("text_pros"), some("cons").alias("text_cons"))


def stub_texts(reviews: DataFrame, overall: bool = False) -> DataFrame:
    """The stub's whole summary: its fixed sentences around counts and quotes, and its fixed key phrases; ``overall`` has one text and no phrases."""
    rows = stub(reviews)
    if overall:
        return rows.select("product_id", "reviews_count", "rating_avg", F.format_string(L.STUB["overall"], "reviews_count").alias("text_overall"))
    quoted = lambda c, kind: F.when(F.col(c).isNotNull(), F.format_string(L.STUB[kind], c)).otherwise(L.STUB[f"no_{kind}"])
    phrases = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(m).alias("sentiment"), F.lit(n).cast("long").alias("count"), F.lit(s).alias("share")) for p, m, n, s in L.STUB_PHRASES])
    return rows.select(
        "product_id", "reviews_count", "rating_avg", F.format_string(L.STUB["neutral"], "reviews_count").alias("text_neutral"),
        quoted("text_pros", "pros").alias("text_pros"), quoted("text_cons", "cons").alias("text_cons"), phrases.alias("key_phrases"),
    )


def with_text(reviews: DataFrame) -> DataFrame:
    """Reviews that say something, with their ``full_text``."""
    text = X.full_text(F.col("title"), F.col("comment"), F.col("plus"), F.col("minus"))
    return reviews.withColumn("full_text", text).filter("full_text <> ''")


def useful_reviews(reviews: DataFrame) -> DataFrame:
    """A product's useful reviews; all of them where none is."""
    rows = with_text(reviews).withColumn("useful", X.useful(F.col("full_text")))
    some = F.max("useful").over(Window.partitionBy("product_id"))
    return rows.withColumn("_some", some).filter(F.col("useful") | ~F.col("_some")).drop("_some")


def phrase_reviews(phrases: DataFrame, reviews: DataFrame, column: str = "full_text") -> DataFrame:
    """How many of a product's reviews hold each phrase as whole words. A product's phrases travel as one bounded array."""
    arrays = phrases.groupBy("product_id").agg(F.collect_set("phrase").alias("phrases"))
    low = F.lower(column)
    whole = lambda p: F.rlike(low, F.concat(F.lit(r"(?U)\b\Q"), p, F.lit(r"\E\b")))
    rows = reviews.join(arrays, "product_id").select("product_id", F.explode(F.filter("phrases", lambda p: F.contains(low, p) & whole(p))).alias("phrase"))
    return rows.groupBy("product_id", "phrase").agg(F.count("*").alias("reviews"))


def task(name: str, *parts) -> Column:
    """A prompt: the task's name, then its parts, by tabs."""
    return F.concat_ws("\t", F.lit(name), *parts)


TEXTS = "positive string, negative string, general string"


def asked(rows: DataFrame, prompt, model: Model, schema: str, out: str, tries: int) -> DataFrame:
    """Adds what a model answers, parsed; null where it fails or answers what the schema can't hold."""
    rows = with_model(rows.withColumn("_prompt", prompt), "_prompt", model, "_answer", tries)
    return rows.withColumn(out, answer_json(F.col("_answer"), schema)).drop("_prompt", "_answer")


def llm(reviews: DataFrame, model: Model = echo_model, top: int = 80, stop=L.STOP_WORDS, representative_count: int = 10) -> DataFrame:
    """The phrase method: frequent phrases of useful reviews; a model filters them by sentiment and generalizes them, they are counted by
    review, and go with representative reviews into a text that the model writes and corrects.

    ``product_id, phrases`` (phrase, sentiment, short, reviews; by falling count) and ``texts``. Tries 3, 3, 4 and 3. Without an answer
    all phrases stay as neutral ones, a phrase is its own short form, and an uncorrected text stands.
    """
    rows = useful_reviews(reviews)
    # phrases are read several times; a product has ``top`` of them
    frequent = bigrams_and_trigrams(rows, "product_id", "full_text", top, stop)
    lists = frequent.groupBy("product_id").agg(F.array_sort(F.collect_list("phrase")).alias("all"))
    judged = asked(lists, task("filter", F.to_json("all")), model, "map<string,string>", "_kept", 3)
    kept = F.when(F.col("_kept").isNull(), F.col("all")).otherwise(F.filter("all", lambda p: F.element_at("_kept", p).isin("positive", "negative")))
    judged = judged.withColumn("kept", kept)
    judged = asked(judged, task("generalize", F.to_json("kept")), model, "map<string,string>", "_short", 3)
    phrase = F.explode(F.transform("kept", lambda p: F.struct(p.alias("phrase"), F.coalesce(F.element_at("_kept", p), F.lit("neutral")).alias("sentiment"), F.coalesce(F.element_at("_short", p), p).alias("short"))))
    chosen = judged.select("product_id", phrase.alias("p")).select("product_id", "p.*")
    counted = phrase_reviews(chosen.select("product_id", "phrase"), rows)
    item = F.struct((-F.col("reviews")).alias("k"), "phrase", "sentiment", "short", "reviews")
    gathered = chosen.join(counted, ["product_id", "phrase"]).groupBy("product_id").agg(F.array_sort(F.collect_list(item)).alias("phrases"))
    shown = representative(rows, representative_count).groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("review_id", "full_text"))).alias("_reviews"))
    out = gathered.join(shown, "product_id", "left")
    texts = F.transform("_reviews", lambda r: r["full_text"])
    out = asked(out, task("generate", F.to_json("phrases"), F.to_json(texts)), model, TEXTS, "_texts", 4)
    out = asked(out, task("correct", F.to_json("_texts")), model, TEXTS, "_fixed", 3)
    return out.select("product_id", "phrases", F.coalesce("_fixed", "_texts").alias("texts"))


def aspect(reviews: DataFrame, model: Model, sample: int = 50, per_aspect: int = 5, representative_count: int = 10, seed: int = 0) -> DataFrame:
    """The aspect method: a model names aspects with word stems from a sample of a product's reviews; their sentences are counted, and a model writes the text.

    ``product_id, phrases`` (aspect, sentiment, phrase, reviews; by rank) and ``texts``. Aspects can be given instead: see ``aspect_phrases``.
    """
    drawn = stratified(with_text(reviews), sample, seed).groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("review_id", "full_text"))).alias("_reviews"))
    texts = F.transform("_reviews", lambda r: r["full_text"])
    named = asked(drawn, task("aspects", F.to_json(texts)), model, "map<string,array<string>>", "_aspects", 3)
    pairs = F.array_sort(F.map_entries("_aspects"))
    keys = named.select("product_id", F.posexplode(pairs).alias("ord", "a")).select("product_id", "ord", F.col("a.key").alias("aspect"), F.explode("a.value").alias("keyword"))
    found = aspect_phrases(reviews, keys, per_aspect)
    item = F.struct("ord", "sentiment", "rank", "aspect", "phrase", "reviews")
    gathered = found.groupBy("product_id").agg(F.array_sort(F.collect_list(item)).alias("phrases"))
    shown = representative(with_text(reviews), representative_count).groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("review_id", "full_text"))).alias("_shown"))
    out = gathered.join(shown, "product_id", "left")
    out = asked(out, task("generate", F.to_json("phrases"), F.to_json(F.transform("_shown", lambda r: r["full_text"]))), model, TEXTS, "texts", 4)
    return out.select("product_id", "phrases", "texts")


def sentence_sentiments(reviews: DataFrame) -> DataFrame:
    """Sentences of pluses, minuses, comments and titles, in this order: pluses positive, minuses negative, others by rating."""
    fields = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), F.col(f).alias("text")) for i, f in enumerate(("plus", "minus", "comment", "title"))])
    rows = reviews.select("product_id", "review_id", "rating", F.explode(fields).alias("f")).filter("f.text is not null")
    mood = F.when(F.col("f.field") == "plus", "positive").when(F.col("f.field") == "minus", "negative")
    mood = mood.when(F.col("rating") >= 4, "positive").when(F.col("rating") <= 2, "negative").otherwise("neutral")
    return rows.select("product_id", "review_id", F.col("f.place").alias("place"), mood.alias("sentiment"), F.posexplode(X.sentences(F.col("f.text"))).alias("pos", "sentence"))


def aspect_phrases(reviews: DataFrame, keywords: DataFrame, per_aspect: int = 5) -> DataFrame:
    """Sentences by given aspects (aspect, ord, keyword): the most common phrases of each aspect and sentiment; the first aspect keeps a shared one.

    Aspects are given by hand or a model for all products: a table that travels as one array, so that sentences are never multiplied by keywords.
    """
    rows = sentence_sentiments(reviews).select("product_id", "review_id", "sentiment", F.lower("sentence").alias("phrase"))
    own = ["product_id"] if "product_id" in keywords.columns else []  # a product's own aspects, or the same for all
    lists = keywords.groupBy(*own, "aspect", "ord").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    whole = lists.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("ord", "aspect", "keywords"))).alias("_aspects"))
    met = rows.join(whole, "product_id") if own else rows.join(F.broadcast(whole))  # one row
    held = F.filter("_aspects", lambda a: F.exists(a["keywords"], lambda k: F.contains(F.col("phrase"), k)))
    hit = met.select("product_id", "review_id", "sentiment", "phrase", F.explode(held).alias("a"))
    counted = hit.groupBy("product_id", F.col("a.aspect").alias("aspect"), F.col("a.ord").alias("ord"), "sentiment", "phrase")
    counted = counted.agg(F.countDistinct("review_id").alias("reviews"))
    order = Window.partitionBy("product_id", "aspect", "sentiment").orderBy(F.desc("reviews"), "phrase")
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_aspect)
    first = Window.partitionBy("product_id", "phrase", "sentiment").orderBy("ord")
    return top.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")


def aspect_evidence(reviews: DataFrame, p: A.Params = A.Params()) -> dict[str, DataFrame]:
    """The whole deterministic method, all products in one plan; the artifacts by name."""
    spanned = A.review_pieces(reviews, most=p.max_spans_per_review)
    raw = A.mentions(spanned, A.candidates(spanned, p), p)
    found = A.canonical(raw, label_clusters(raw.select("product_id", F.col("aspect").alias("label")).distinct()))
    totals = reviews.groupBy("product_id").agg(F.count("*").alias("reviews_count"))
    scored = A.stats(found, totals, p)
    planned = A.plan(scored, p)
    proof = A.evidence(found, planned, p)
    sentences = A.grounded(planned, proof)
    texts = A.summary_text(sentences)
    return {
        "mentions": found, "clusters": scored, "plan": planned, "evidence": proof, "key_phrases": sentences,
        "summary": texts, "verification": A.verify(planned, proof, texts),
    }


METHODS: dict[str, Callable] = {"stub": stub, "stub_texts": stub_texts, "llm": llm, "aspect": aspect, "aspect_phrases": aspect_phrases, "aspect_evidence": aspect_evidence}


def register(name: str, method: Callable) -> None:
    """Adds a method to those that ``summarize`` knows; a name that is taken raises."""
    if name in METHODS:
        raise KeyError(f"there is a method {name} already")
    METHODS[name] = method


def summarize(method: str, reviews: DataFrame, *args, **params):
    if method not in METHODS:
        raise KeyError(f"no such method: {method}; there are {', '.join(sorted(METHODS))}")
    return METHODS[method](reviews, *args, **params)
