"""N-gram statistics and the indexes that suggestions read: keyphrases, phrases, continuations, prefixes, user style."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X


FIELDS, WEAK = ("title", "plus", "minus", "comment"), ("positive", "negative", "mixed", "neutral")
HOMES = 1 << 16
SEPARATOR = "\x1f"  # stands in no token


def _code(c: str, labels: Sequence[str]) -> Column:
    """A label's number from 1; 0 for null and any other."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, labels)), F.col(c)), F.lit(0))


def _label(c: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), F.pmod(c, F.lit(10)).cast("int") - 1)


def _ordered(place: str | None = None) -> Column:
    """``seq`` (and a place in the segment) as one number, its last two digits the field and weak sentiment there.

    Numbers of fixed width keep an aggregate in its hash table; structs and texts would have all rows sorted.
    """
    seq = "cast(seq.review_id as decimal(19,0)) * 100000000BD + seq.span_index"
    order = F.expr(f"cast({seq} as decimal(27,0))")
    if place:
        order = (order * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(36,0)") + F.col(place)
    return (order.cast("decimal(36,0)") * 100 + _code("field", FIELDS) * 10 + _code("weak", WEAK)).cast("decimal(38,0)")


def _home(word: Column) -> Column:
    """Rows of one word meet in one place: it goes into the keys, so that one exchange serves all steps."""
    return F.pmod(F.hash(word), F.lit(HOMES))


def grams(segs: DataFrame, least: int, longest: int, *more: str, stop: Sequence[str] = ()) -> DataFrame:
    """``product_id, home, phrase`` and ``more``: all runs of ``least`` to ``longest`` tokens, none of them in ``stop``.

    A place's longest run travels, and is cut up where it arrives.
    """
    size = F.size("tokens")
    if stop:
        # a run ends before the first stop-word: what holds one doesn't travel
        word = lambda i, k: F.get("_clean", i + (k - 1))

        def run(i: Column) -> Column:
            out = word(i, longest - 1)
            for k in range(longest - 2, -1, -1):
                out = F.concat(word(i, k), F.lit(" "), out) if k < least - 1 else F.when(word(i, k).isNotNull(), F.concat_ws(" ", word(i, k), out))
            return out

        segs = segs.withColumn("_clean", F.transform("tokens", lambda w: F.when(~w.isin(*stop), w)))
        places = F.array_compact(F.transform(F.sequence(F.lit(1), size - (least - 1)), run))
    else:
        places = F.transform(F.sequence(F.lit(1), size - (least - 1)), lambda i: F.array_join(F.slice("tokens", i, longest), " "))
    rows = segs.filter(size >= least).select("product_id", *more, F.explode(places).alias("words"))
    rows = rows.withColumn("home", _home(F.substring_index("words", " ", 1))).repartition("product_id", "home")
    runs = F.array_distinct(F.array(*[F.substring_index("words", " ", n) for n in range(least, longest + 1)]))
    return rows.select("product_id", "home", *more, F.explode(runs).alias("phrase"))


def segments(spans: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Spans with tokens and the weak sentiment of their field; ``seq`` (review, place) orders them without a sort of a whole product.

    Rating and user come from ``reviews``, where the spans don't have them already.
    """
    rows = spans if reviews is None else spans.join(reviews.select("review_id", "rating", "user_id"), "review_id")
    return rows.select(
        "product_id", "user_id", "review_id", "span_index", F.col("section").alias("field"), F.col("span_text").alias("text"), "rating",
        X.surface_tokens(F.col("span_text")).alias("tokens"),
        X.weak_sentiment(F.col("section"), F.col("rating")).alias("weak"),
        F.struct("review_id", "span_index").alias("seq"),
    )


def frequent_ngrams(texts: DataFrame, key: str, column: str, n: int, top: int, stop: Sequence[str] = L.STOP_WORDS) -> DataFrame:
    """The most frequent n-grams without stop-words, by count, then text."""
    words = F.filter(X.tokens(F.col(column)), lambda w: ~w.isin(*stop))
    # words are a column of their own: inside the n-gram lambda they would be split anew for every place
    rows = texts.select(key, words.alias("_words"))
    counted = rows.select(key, F.explode(X.ngrams(F.col("_words"), n)).alias("phrase")).groupBy(key, "phrase").agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "phrase")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def bigrams_and_trigrams(texts: DataFrame, key: str, column: str, top: int = 80, stop: Sequence[str] = L.STOP_WORDS) -> DataFrame:
    """Half of the places for bigrams, half for trigrams."""
    two, three = (frequent_ngrams(texts, key, column, n, top // 2, stop).withColumn("size", F.lit(n)) for n in (2, 3))
    return two.unionByName(three)


def keyphrases(segs: DataFrame, most: int = 400, stop: Sequence[str] = L.KEYPHRASE_STOP) -> DataFrame:
    """1- to 3-grams that come twice or more, hold no stop-word and pass the keyphrase filter; score min(1, n / 10)."""
    rows = grams(segs.withColumn("at", _ordered()), 1, 3, "at", stop=stop)
    counted = rows.groupBy("product_id", "home", "phrase").agg(F.count("*").alias("n"), F.min("at").alias("first_seq")).drop("home")
    # by the count as well: a filter on the text alone would be tried on every occurrence
    counted = counted.filter(F.when(F.col("n") >= 2, X.good_keyphrase(F.col("phrase"))))
    counted = counted.withColumns({"field": _label(F.floor(F.col("first_seq") / 10), FIELDS), "weak": _label(F.col("first_seq"), WEAK), "score": F.least(F.lit(1.0), F.col("n") / 10)})
    order = Window.partitionBy("product_id").orderBy(F.desc("score"), "first_seq", "phrase")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def phrase_bank(segs: DataFrame) -> DataFrame:
    """Surface 2- and 3-grams of four characters or more that come twice or more, with their last field and sentiment and mean rating;
    no specific facts. All of them.
    """
    rows = grams(segs.withColumn("at", _ordered()), 2, 3, "at", "rating").filter(F.length("phrase") >= 4)
    counted = rows.groupBy("product_id", "home", "phrase").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.avg("rating").alias("rating_avg"))
    # by the count as well: a filter on the text alone would be tried on every occurrence
    counted = counted.filter(F.when(F.col("n") >= 2, (F.length("phrase") <= 120) & ~X.specific_fact(F.col("phrase"))))
    return counted.select(
        "product_id", "phrase", "n", _label(F.floor(F.col("last") / 10), FIELDS).alias("field"), _label(F.col("last"), WEAK).alias("weak"), "rating_avg",
        F.least(F.lit(1.0), 0.3 + F.col("n") / 20).alias("quality"),
    )


def whole_bank(bank: DataFrame, keys: DataFrame | None = None, aspects: DataFrame | None = None, most: int = 120) -> DataFrame:
    """A bank with the best keyphrases (quality: their score) and the aspects' representative phrases (.55) in it, and each phrase's aspect.

    ``keys`` as ``keyphrases`` gives them, ``aspects`` as ``discover_aspects`` does. A text that comes from several sources stands once,
    with its best quality.
    """
    names = ["product_id", "phrase", "n", "field", "weak", "rating_avg", "quality"]
    out, none = bank.select(*names), F.lit(None).cast("double")
    fresh = lambda rows, text, weak, field, quality: rows.select(
        "product_id", text.alias("phrase"), F.lit(1).cast("long").alias("n"), field.alias("field"), weak.alias("weak"), none.alias("rating_avg"), quality.alias("quality")
    )
    if keys is not None:
        out = out.unionByName(fresh(keys.filter(F.col("rank") <= most), F.col("phrase"), F.col("weak"), F.col("field"), F.col("score")))
    if aspects is not None:
        shown = aspects.select("product_id", F.explode(F.slice("representative", 1, 10)).alias("phrase"))
        out = out.unionByName(fresh(shown, F.col("phrase"), F.lit("neutral"), F.lit("comment"), F.lit(0.55)))
    out = out.filter((F.length("phrase") <= 120) & ~X.specific_fact(F.col("phrase")))
    best = F.max_by(F.struct(*names[2:]), F.struct("quality", "n"))
    out = out.groupBy("product_id", "phrase").agg(best.alias("b")).select("product_id", "phrase", "b.*")
    return out if aspects is None else with_aspect(out, aspects)


def with_aspect(phrases: DataFrame, aspects: DataFrame) -> DataFrame:
    """Phrases with the aspect that has them as a keyword; the last one, where several do."""
    keyword = aspects.select("product_id", "ord", "aspect_id", F.posexplode("keywords").alias("_pos", "_key"))
    keyword = keyword.groupBy("product_id", X.collapse(F.col("_key")).alias("_key")).agg(F.max_by("aspect_id", F.struct("ord", "_pos")).alias("aspect_id"))
    return phrases.withColumn("_key", X.collapse(F.col("phrase"))).join(keyword, ["product_id", "_key"], "left").drop("_key")


def keyphrase_union(parts: list[DataFrame]) -> DataFrame:
    """Keyphrases (product_id, phrase, score, ...) of several sources: the first source of equal texts wins."""
    union = None
    for place, part in enumerate(parts):
        part = part.withColumn("source_ord", F.lit(place))
        union = part if union is None else union.unionByName(part)
    first = Window.partitionBy("product_id", "_key").orderBy("source_ord", F.desc("score"), "phrase")
    rows = union.withColumn("_key", X.collapse(F.col("phrase"))).withColumn("_n", F.row_number().over(first))
    return rows.filter(F.col("_n") == 1).drop("_n", "_key")


def discover_aspects(keys: DataFrame, clusters: DataFrame, bank: DataFrame, most: int = 20, phrases: int = 10) -> DataFrame:
    """product_id, ord, aspect_id, label, keywords, representative, positive, negative: clusters of keyphrases as aspects.

    ``clusters`` (product_id, label, name) groups the keyphrases' texts; the largest ``most`` of a product stay, by their keyphrases' count.
    Representative phrases are the bank's best that hold a keyword of the aspect.
    """
    rows = keys.join(clusters.withColumnRenamed("label", "phrase"), ["product_id", "phrase"])
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "phrase")))
    per = rows.groupBy("product_id", "name").agg(F.sum("n").alias("weight"), F.transform(order, lambda x: x["phrase"]).alias("keywords"))
    by_weight = Window.partitionBy("product_id").orderBy(F.desc("weight"), "name")
    per = per.withColumn("ord", F.row_number().over(by_weight)).filter(F.col("ord") <= most)
    per = per.select("product_id", "ord", F.concat_ws("-", F.lit("aspect"), F.col("ord").cast("string")).alias("aspect_id"), F.col("name").alias("label"), "keywords")
    # a product's aspects and their keywords are few; they meet its phrases as one array
    words = per.groupBy("product_id").agg(F.collect_list(F.struct("ord", "keywords")).alias("_aspects"))
    held = F.filter("_aspects", lambda a: F.exists(F.slice(a["keywords"], 1, 20), lambda k: F.contains(F.col("phrase"), k)))
    hits = bank.select("product_id", "phrase", "quality", "weak").join(words, "product_id").select("product_id", "phrase", "quality", "weak", F.explode(F.transform(held, lambda a: a["ord"])).alias("ord"))
    # ranked by kind, so that a task keeps only the first of each
    kinds = F.array_compact(F.array(F.lit("representative"), F.when(F.col("weak").isin("positive", "negative"), F.col("weak"))))
    place = F.row_number().over(Window.partitionBy("product_id", "ord", "kind").orderBy(F.desc("quality"), "phrase"))
    hits = hits.select("product_id", "ord", "phrase", "quality", F.explode(kinds).alias("kind")).withColumn("_place", place).filter(F.col("_place") <= phrases)
    best = lambda kind: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_place", "phrase")))), lambda x: x["phrase"]
    ).alias(kind)
    lists = hits.groupBy("product_id", "ord").agg(*[best(k) for k in ("representative", "positive", "negative")])
    return per.join(lists, ["product_id", "ord"], "left").withColumns(
        {k: F.coalesce(k, F.array().cast("array<string>")) for k in ("representative", "positive", "negative")}
    )


def stored_phrases(bank: DataFrame, most: int = 2000) -> DataFrame:
    """The part of a bank that a profile keeps."""
    order = Window.partitionBy("product_id").orderBy(F.desc("quality"), F.desc("n"), "phrase")
    return bank.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def continuations(segs: DataFrame, following: int = 1, most: int = 30, column: str = "tokens", keywords: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """What follows each context of one to four tokens: first-seen order, at most 30 a context.

    Score .55 for a single sighting, else min(1, .5 + n / 15). ``column`` holds surface tokens (one follows) or lemmas (``following`` 2).
    With ``keywords`` (product_id, aspect_id, ord, keyword) the aspect of the first keyword that context and next hold together; with
    ``asked`` (product_id, context) only those contexts.
    """
    size = F.size(column)
    chain = lambda start, n: F.array_join(F.slice(column, start, n), SEPARATOR)
    places = F.transform(
        F.sequence(F.lit(1), size - 1),
        lambda i: F.struct(
            chain(F.greatest(F.lit(1), i - 3), F.least(F.lit(4), i)).alias("words"), F.array_join(F.slice(column, i + 1, F.lit(following)), " ").alias("next"), i.alias("i")
        ),
    )
    rows = segs.filter(size >= 2).select("product_id", "seq", "field", "weak", F.explode(places).alias("c")).select("product_id", "seq", "field", "weak", "c.*")
    rows = rows.select("product_id", "words", "next", _ordered("i").alias("at"))
    if asked is not None:  # what is asked for travels with the rest, as a context that nothing follows
        none = F.lit(None)
        rows = rows.unionByName(asked.distinct().select("product_id", F.replace("context", F.lit(" "), F.lit(SEPARATOR)).alias("words"), none.cast("string").alias("next"), none.cast("decimal(38,0)").alias("at")))
    # a place's contexts end with the same token: they travel as one row, and are cut up where they arrive
    rows = rows.withColumn("home", _home(F.substring_index("words", SEPARATOR, -1))).repartition("product_id", "home")
    ends = F.array_distinct(F.array(*[F.substring_index("words", SEPARATOR, -n) for n in (1, 2, 3, 4)]))
    ends = F.when(F.col("at").isNull(), F.array("words")).otherwise(ends)
    rows = rows.select("product_id", "home", "next", "at", F.explode(F.transform(ends, lambda c: F.translate(c, SEPARATOR, " "))).alias("context"))
    counted = rows.groupBy("product_id", "home", "context", "next").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    own = Window.partitionBy("product_id", "home", "context")
    # what is asked for has no place and so comes first
    order = F.row_number().over(own.orderBy("first", "next"))
    if asked is not None:
        counted = counted.withColumn("_asked", F.first(F.col("first").isNull()).over(own.orderBy("first", "next"))).filter("_asked")
        order = order - 1
    ranked = counted.withColumn("rank", order).filter((F.col("rank") <= most) & F.col("first").isNotNull())
    ranked = ranked.withColumn("weak", _label(F.col("first"), WEAK))
    score = F.when(F.col("n") == 1, 0.55).otherwise(F.least(F.lit(1.0), 0.5 + F.col("n") / 15))
    out = ranked.select("product_id", "context", "rank", "next", "n", score.alias("score"), "weak")
    if keywords is None:
        return out
    return first_aspect(out.withColumn("phrase", F.concat_ws(" ", "context", "next")), keywords).drop("phrase")


def lemmas(tokens, known: dict[str, str] | None = None, least: int = 3):
    """Tokens of ``least`` characters or more by a table of lemmas (a plug-in; without one each token is its own)."""
    long = F.filter(tokens, lambda w: F.length(w) >= least)
    if not known:
        return long
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(long, lambda w: F.coalesce(F.element_at(table, w), w))


def prefix_index(phrases: DataFrame, most: int = 20, asked: DataFrame | None = None) -> DataFrame:
    """Phrases by each prefix of 2 to 40 characters, of the phrase and of its words of three letters or more.

    A phrase comes once a product, so distinct entries of a phrase are distinct rows. With ``asked`` (product_id, prefix) only those
    prefixes' buckets are built, and the cut begins before the shuffle.
    """
    return prefix_rows(phrases, most, asked).drop("home")


def prefix_rows(phrases: DataFrame, most: int = 20, asked: DataFrame | None = None) -> DataFrame:
    """``prefix_index`` with the ``home`` where a prefix's rows are.

    All prefixes of an entry begin with its first two characters: entries meet by these before they are taken apart, and of equal ones
    only the first ``most`` go on.
    """
    entries = F.array_distinct(F.concat(F.array("phrase"), F.filter(F.split("phrase", " "), lambda w: F.length(w) >= 3)))
    rows = phrases.filter(F.length("phrase") >= 2).select("product_id", "phrase", "quality", "weak", F.explode(entries).alias("insert_text"))
    rows = rows.filter(F.length("insert_text") >= 2).withColumn("home", _home(F.left("insert_text", F.lit(2))))
    place = lambda own: F.row_number().over(Window.partitionBy("product_id", "home", own).orderBy(F.desc("quality"), "phrase", "insert_text"))
    if asked is None:
        # an entry's whole text, as far as prefixes go: who isn't among the first there isn't so for any prefix
        rows = rows.repartition("product_id", "home").withColumn("longest", F.left("insert_text", F.lit(40)))
        rows = rows.withColumn("rank", place("longest")).filter(F.col("rank") <= most).drop("rank", "longest")
    prefixes = F.transform(F.sequence(F.lit(2), F.least(F.lit(40), F.length("insert_text"))), lambda n: F.left("insert_text", n))
    rows = rows.select("*", F.explode(prefixes).alias("prefix"))
    rows = rows.join(asked.distinct(), ["product_id", "prefix"], "left_semi") if asked is not None else rows
    ranked = rows.withColumn("rank", place("prefix")).filter(F.col("rank") <= most)
    return ranked.select("product_id", "prefix", "rank", F.col("phrase").alias("text"), "insert_text", F.col("quality").alias("score"), "weak", "home")


def user_style(segs: DataFrame, top: int = 15) -> DataFrame:
    """How a user writes: openers, connectors (second and third token), mean length, how often an exclamation mark, flags."""
    rows = segs.filter(F.col("user_id").isNotNull())
    base = rows.groupBy("user_id").agg(
        F.count("*").alias("segments"),
        F.avg(F.size("tokens")).alias("mean_tokens"),
        F.avg(F.contains(F.col("text"), F.lit("!")).cast("double")).alias("exclamation_rate"),
    )
    base = base.withColumn("short_practical", F.when(F.col("mean_tokens") < 8, 1.0).otherwise(0.3))
    kinds = F.array(
        F.struct(F.lit("opener").alias("kind"), F.get("tokens", 0).alias("token")),
        F.struct(F.lit("connector").alias("kind"), F.when(F.size("tokens") > 2, F.array_join(F.slice("tokens", 2, 2), " ")).alias("token")),
    )
    words = rows.select("user_id", F.explode(kinds).alias("k")).filter("k.token is not null")
    counted = words.groupBy("user_id", "k.kind", "k.token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("user_id", "kind").orderBy(F.desc("n"), "token")
    counted = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    lists = counted.groupBy("user_id").pivot("kind", ["opener", "connector"]).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), ",")
    )
    return base.join(lists, "user_id", "left")


def user_phrases(keys: DataFrame, most: int = 40) -> DataFrame:
    """A user's common phrases by place, from keyphrases of the user's own segments (``keyphrases`` with the user as the product)."""
    return keys.filter(F.col("rank") <= most).select(F.col("product_id").alias("user_id"), F.col("rank").alias("place"), X.collapse(F.col("phrase")).alias("phrase"))


def first_aspect(phrases: DataFrame, keywords: DataFrame) -> DataFrame:
    """Each phrase with the first aspect (by ``ord``) one of whose keywords it holds; null without."""
    key = F.struct("ord", "keyword", "aspect_id")
    arrays = keywords.groupBy("product_id").agg(F.array_sort(F.collect_list(key)).alias("ks"))
    held = F.filter("ks", lambda k: F.contains(F.col("phrase"), k["keyword"]))
    return phrases.join(arrays, "product_id", "left").withColumn("aspect_id", F.get(held, 0)["aspect_id"]).drop("ks")


def profile_counts(reviews: DataFrame, segs: DataFrame, bank: DataFrame) -> DataFrame:
    """A product profile's own numbers: reviews, segments, phrases, phrases with an aspect."""
    rows = reviews.groupBy("product_id").agg(F.count("*").alias("reviews_count"))
    own = segs.groupBy("product_id").agg(F.count("*").alias("segments_count"))
    phrases = bank.groupBy("product_id").agg(F.count("*").alias("phrases"), F.count("aspect_id").alias("with_aspect"))
    return phrases.join(rows, "product_id").join(own, "product_id")
