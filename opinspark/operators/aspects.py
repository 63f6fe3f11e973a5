"""Aspects of products: sections, spans, candidates, mentions, statistics, plan, evidence, text, verification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from .ngrams import grams


@dataclass(frozen=True)
class Params:
    max_spans_per_review: int = 30
    min_candidate_len: int = 3
    max_candidates: int = 120
    keywords: int = 50
    candidates_per_span: int = 3
    max_selected: int = 8
    evidence_per_aspect: int = 3
    rarity_share: float = 0.08
    prevalence_weight: float = 0.35
    polarity_weight: float = 0.2
    informativeness_weight: float = 0.2
    diversity_weight: float = 0.2
    rarity_bonus: float = 0.15
    positive: Sequence[str] = L.POSITIVE
    negative: Sequence[str] = L.NEGATIVE


def sections(reviews: DataFrame) -> DataFrame:
    """Long form: one row per non-empty section, in the order title, plus, minus, comment."""
    pairs = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("text")) for s in ("title", "plus", "minus", "comment")])
    some = F.filter(pairs, lambda x: x["text"].isNotNull() & (x["text"] != ""))
    rows = reviews.select("review_id", "product_id", F.posexplode(some).alias("section_pos", "s"))
    return rows.select("review_id", "product_id", "section_pos", F.col("s.section").alias("section"), X.strip(F.col("s.text")).alias("text"))


def canonical_text(long: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.upper("section"), F.lit("] "), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("section_pos", line.alias("line")))), lambda x: x["line"])
    return long.groupBy("review_id").agg(F.array_join(lines, "\n").alias("canonical_text"))


def pieces(long: DataFrame) -> DataFrame:
    """All pieces between sentence ends, semicolons and line ends, of three characters or more, numbered within a review."""
    parts = F.transform(F.split("text", r"[.!?;\n]+"), X.strip)
    rows = long.select("review_id", "product_id", "section", "section_pos", F.posexplode(parts).alias("pos", "span_text"))
    order = Window.partitionBy("review_id").orderBy("section_pos", "pos")
    rows = rows.filter(F.length("span_text") >= 3).withColumn("span_index", F.row_number().over(order) - 1)
    return rows.select("review_id", "product_id", "section", "span_index", "span_text", F.lower("span_text").alias("normalized"))


def spans(long: DataFrame, p: Params = Params()) -> DataFrame:
    """The first few pieces of a review: the cap is of aspects alone, other readers take ``pieces``."""
    return pieces(long).filter(F.col("span_index") < p.max_spans_per_review)


def review_pieces(reviews: DataFrame, *more: str, most: int | None = None) -> DataFrame:
    """``pieces`` of all sections of reviews, the first ``most`` of each, with the columns ``more``: cut and numbered in the review's row, without an exchange."""
    none = F.array().cast("array<struct<section:string,span_text:string>>")

    def cut(section: str) -> Column:
        parts = F.filter(F.transform(F.split(X.strip(F.col(section)), r"[.!?;\n]+"), X.strip), lambda t: F.length(t) >= 3)
        return F.coalesce(F.transform(parts, lambda t: F.struct(F.lit(section).alias("section"), t.alias("span_text"))), none)

    found = F.concat(*[cut(s) for s in ("title", "plus", "minus", "comment")])
    found = found if most is None else F.slice(found, 1, most)
    rows = reviews.select("review_id", "product_id", *more, F.posexplode(found).alias("span_index", "p"))
    return rows.select("review_id", "product_id", *more, "p.section", "span_index", "p.span_text", F.lower("p.span_text").alias("normalized"))


def candidates(spanned: DataFrame, p: Params = Params()) -> DataFrame:
    """The most frequent 1- to 3-grams of a product; its top words count once more. Short ones go after the cut."""
    runs = grams(spanned.select("product_id", X.tokens(F.col("normalized")).alias("tokens")), 1, 3)
    counted = runs.groupBy("product_id", "home", F.col("phrase").alias("candidate")).agg(F.count("*").alias("n")).drop("home")
    # who is among the first after the bonus is so among words or among phrases before it: the rest goes where it was counted
    own = Window.partitionBy("product_id", "phrase").orderBy(F.desc("n"), "candidate")
    counted = counted.withColumn("phrase", F.contains(F.col("candidate"), F.lit(" "))).withColumn("own", F.row_number().over(own))
    counted = counted.filter(F.col("own") <= max(p.max_candidates, p.keywords))
    counted = counted.withColumn("n", F.col("n") + (~F.col("phrase") & (F.col("own") <= p.keywords)).cast("long"))
    order = Window.partitionBy("product_id").orderBy(F.desc("n"), "candidate")
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.max_candidates)
    return top.filter(F.length("candidate") >= p.min_candidate_len).select("product_id", "candidate", "n")


def mentions(spanned: DataFrame, chosen: DataFrame, p: Params = Params()) -> DataFrame:
    """Spans with the longest candidates they hold. A product's candidates travel as one bounded array."""
    key = F.struct((-F.length("candidate")).alias("k"), F.col("candidate").alias("c"))
    arrays = chosen.groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["c"]).alias("cands"))
    held = F.slice(F.filter("cands", lambda c: F.contains(F.col("normalized"), c)), 1, p.candidates_per_span)
    # a span's mood once, not once for each thing that is read of it
    rows = spanned.withColumn("mood", X.sentiment(F.col("normalized"), p.positive, p.negative))
    rows = rows.join(arrays, "product_id").select("*", F.explode(held).alias("aspect")).drop("cands")
    return rows.select(
        "product_id", "review_id", "section", "span_index", "span_text", "aspect",
        F.col("mood.label").alias("sentiment"), F.col("mood.score").alias("score"),
        X.confidence(F.col("mood.label")).alias("confidence"),
    )


def canonical(found: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Mentions under their cluster's name; without clusters each label is its own."""
    if labels is None:
        return found.withColumn("name", F.col("aspect"))
    return found.join(labels.select("product_id", F.col("label").alias("aspect"), "name"), ["product_id", "aspect"])


def stats(named: DataFrame, totals: DataFrame, p: Params = Params()) -> DataFrame:
    """Counts and scores per (product, aspect); ``totals`` has every product's number of reviews."""
    counted = named.groupBy("product_id", "name").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "negative", "neutral", "mixed")],
        F.countDistinct("review_id").alias("review_count"),
        F.countDistinct("aspect").alias("aliases"),
    )
    n = F.greatest(F.lit(1), F.col("reviews_count"))
    both = F.col("positive") + F.col("negative")
    rows = counted.join(totals.select("product_id", "reviews_count"), "product_id").select(
        "*",
        (F.col("total") / n).alias("prevalence"),
        F.when(both == 0, 0.0).otherwise(1.0 - F.abs(F.col("positive") - F.col("negative")) / both).alias("balance"),
        F.least(F.lit(1.0), 0.2 + F.col("aliases") * 0.12).alias("informativeness"),
        F.least(F.lit(1.0), F.col("review_count") / n).alias("diversity"),
    )
    rare = F.col("prevalence") <= p.rarity_share
    importance = (
        p.prevalence_weight * F.col("prevalence")
        + p.polarity_weight * F.col("balance")
        + p.informativeness_weight * F.col("informativeness")
        + p.diversity_weight * F.col("diversity")
        + F.when(rare, p.rarity_bonus).otherwise(0.0)
    )
    return rows.withColumn("importance", importance).withColumn("rare", rare).drop("reviews_count")


def target_polarity() -> Column:
    p, n, u = F.col("positive"), F.col("negative"), F.col("neutral")
    return F.when(p > n, "positive").when(n > p, "negative").when(u >= F.greatest(p, n), "neutral").otherwise("balanced")


def plan(scored: DataFrame, p: Params = Params()) -> DataFrame:
    order = Window.partitionBy("product_id").orderBy(F.desc("importance"), "name")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.max_selected)
    return ranked.withColumn("target", target_polarity())


def plan_diagnostics(scored: DataFrame, planned: DataFrame) -> DataFrame:
    all_ = scored.groupBy("product_id").agg(F.count("*").alias("aspects"))
    own = planned.groupBy("product_id").agg(
        F.count("*").alias("selected"), F.count_if("rare").alias("rare_selected"), F.avg("importance").alias("mean_importance")
    )
    return all_.join(own, "product_id").withColumn("dropped", F.col("aspects") - F.col("selected"))


def evidence(named: DataFrame, planned: DataFrame, p: Params = Params()) -> DataFrame:
    """The best mention of each review (of the target polarity, if there is one), for the first few reviews of an aspect."""
    rows = named.join(planned.select("product_id", "name", "target"), ["product_id", "name"])
    place = ["review_id", "span_index", "aspect"]
    fits = (F.col("sentiment") == F.col("target")) & F.col("target").isin("positive", "negative")
    best = Window.partitionBy("product_id", "name", "review_id").orderBy(F.desc(fits), "span_index", "aspect")
    rows = rows.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == 1).drop("_n")
    order = Window.partitionBy("product_id", "name").orderBy(*place)
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.evidence_per_aspect)
    return ranked.select("product_id", "name", "rank", "review_id", "section", "span_text", "sentiment")


def grounded(planned: DataFrame, found: DataFrame) -> DataFrame:
    """One sentence per planned aspect with evidence: its bucket by polarity, and its key phrase."""
    snippets = F.transform(F.array_sort(F.collect_list(F.struct("rank", "span_text"))), lambda x: x["span_text"])
    per = found.groupBy("product_id", "name").agg(
        snippets.alias("snippets"),
        F.every(F.col("sentiment") == "positive").alias("all_positive"),
        F.every(F.col("sentiment") == "negative").alias("all_negative"),
        F.count("*").alias("count"),
    )
    total = Window.partitionBy("product_id")
    rows = planned.select("product_id", "name", "target", F.col("rank").alias("plan_rank")).join(per, ["product_id", "name"])
    return rows.select(
        "product_id",
        "plan_rank",
        "name",
        F.when(F.col("all_positive"), "pros").when(F.col("all_negative"), "cons").otherwise("neutral").alias("bucket"),
        F.concat("name", F.lit(": "), F.array_join(F.slice("snippets", 1, 2), "; ")).alias("sentence"),
        F.col("target").alias("sentiment"),
        "count",
        F.least(F.lit(1.0), F.col("count") / F.sum("count").over(total)).alias("share"),
    )


def summary_text(sentences: DataFrame) -> DataFrame:
    """Texts of a product: pros, cons, neutral, and the whole with its headings."""
    def lines(bucket: str):
        own = F.filter(F.col("rows"), lambda x: x["bucket"] == bucket)
        return F.transform(own, lambda x: x["sentence"])

    rows = sentences.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("plan_rank", "bucket", "sentence"))).alias("rows"))
    rows = rows.select("product_id", *[lines(b).alias(b) for b in ("pros", "cons", "neutral")])
    some = lambda b, sep: F.nullif(F.array_join(b, sep), F.lit(""))
    heads = {"pros": "Сильные стороны: ", "cons": "Слабые стороны: ", "neutral": "Смешанные наблюдения: "}
    whole = F.concat_ws("\n", *[F.concat(F.lit(h), some(b, " | ")) for b, h in heads.items()])
    return rows.select("product_id", F.nullif(whole, F.lit("")).alias("text_overall"), *[some(b, "\n").alias(f"text_{b}") for b in heads])


def verify(planned: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """Planned aspects without evidence (errors), and aspects that the text doesn't name (warnings)."""
    names = planned.groupBy("product_id").agg(F.array_sort(F.collect_set("name")).alias("planned"))
    have = found.groupBy("product_id").agg(F.collect_set("name").alias("have"))
    none = F.array().cast("array<string>")
    rows = names.join(have, "product_id", "left").join(texts, "product_id", "left")
    blob = F.lower(F.concat_ws(" ", "text_overall", "text_pros", "text_cons", "text_neutral"))
    rows = rows.select(
        "product_id",
        F.array_sort(F.array_except("planned", F.coalesce("have", none))).alias("missing"),
        F.filter("planned", lambda a: ~F.contains(blob, F.lower(a))).alias("unmentioned"),
        F.coalesce("text_overall", "text_pros", "text_cons").isNull().alias("empty_text"),
    )
    return rows.withColumn("passed", (F.size("missing") == 0) & ~F.col("empty_text"))


def section_sentiment(found: DataFrame) -> DataFrame:
    labels = ["positive", "negative", "neutral", "mixed"]
    return found.groupBy("section").pivot("sentiment", labels).count().na.fill(0, labels)


def search_mentions(found: DataFrame, text: str, sections_in: Sequence[str] = (), sentiments: Sequence[str] = ()) -> DataFrame:
    """Mentions that hold a text literally, in the sections and sentiments given."""
    out = found.filter(F.contains(F.lower("aspect"), F.lit(text.lower())) | F.contains(F.lower("span_text"), F.lit(text.lower())))
    out = out.filter(F.col("section").isin(*sections_in)) if sections_in else out
    return out.filter(F.col("sentiment").isin(*sentiments)) if sentiments else out


def section_histogram(found: DataFrame) -> DataFrame:
    """How many mentions of an aspect each section has, as a map."""
    per = found.groupBy("product_id", "name", "section").agg(F.count("*").alias("n"))
    return per.groupBy("product_id", "name").agg(F.map_from_entries(F.collect_list(F.struct("section", "n"))).alias("sections"))


def key_phrase_sentiment() -> Column:
    """The plan's target where there is one (positive or negative, else neutral), else the majority, mixed first."""
    p, n, m = F.col("positive"), F.col("negative"), F.col("mixed")
    planned = F.when(F.col("target").isin("positive", "negative"), F.col("target")).when(F.col("target").isNotNull(), "neutral")
    return F.coalesce(planned, F.when((m > 0) & (m >= p) & (m >= n), "neutral").when(p > n, "positive").when(n > p, "negative").otherwise("neutral"))


def key_phrases(scored: DataFrame, planned: DataFrame, most: int = 25) -> DataFrame:
    """A product's first aspects by importance as key phrases: sentiment, count, share (never over 1)."""
    order = Window.partitionBy("product_id").orderBy(F.desc("importance"), "name")
    rows = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    rows = rows.join(planned.select("product_id", "name", "target"), ["product_id", "name"], "left")
    share = F.least(F.lit(1.0), F.round("prevalence", 3))
    return rows.select("product_id", "rank", F.col("name").alias("phrase"), key_phrase_sentiment().alias("sentiment"), F.col("total").alias("count"), share.alias("share"))


def bucketed(phrases: DataFrame) -> DataFrame:
    """Key phrases by sentiment, the most counted first; what isn't positive, negative or neutral is other."""
    known = F.lower(F.trim("sentiment"))
    rows = phrases.withColumn("bucket", F.when(known.isin("positive", "negative", "neutral"), known).otherwise("other"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "phrase")))
    return rows.groupBy("product_id", "bucket").agg(F.count("*").alias("n"), F.transform(order, lambda x: x["phrase"]).alias("phrases"))


def generation_input(planned: DataFrame, scored: DataFrame, found: DataFrame, most: int = 3) -> DataFrame:
    """What a model gets of each planned aspect: its numbers (0 where there are none) and its first evidence with a score by rank."""
    own = Window.partitionBy("product_id", "name")
    score = F.round(1.0 - (F.col("rank") - 1) / F.count("*").over(own), 3)
    rows = found.withColumn("score", score).filter(F.col("rank") <= most)
    item = F.struct("rank", F.col("span_text").alias("text"), "section", "sentiment", "score")
    lists = rows.groupBy("product_id", "name").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    counts = ("total", "positive", "negative", "neutral")
    numbers = scored.select("product_id", "name", "prevalence", *counts)
    out = planned.select("product_id", "rank", "name", "importance", "target", F.col("rare").alias("must_include"))
    out = out.join(numbers, ["product_id", "name"], "left").join(lists, ["product_id", "name"], "left")
    none = F.array().cast("array<struct<rank:int,text:string,section:string,sentiment:string,score:double>>")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return out.withColumns({"prevalence": F.coalesce("prevalence", F.lit(0.0)), "evidence": F.coalesce("evidence", none)})


def stored(found: DataFrame, clusters: DataFrame) -> DataFrame:
    """Evidence rows under their cluster's id; what has no cluster isn't stored."""
    rows = found.join(clusters.select("product_id", "name", "cluster_id"), ["product_id", "name"])
    return rows.select("product_id", "cluster_id", "rank", "review_id", F.col("span_text").alias("evidence_text"), F.col("sentiment").alias("supports"))
