"""Text expressions: everything here is a Column built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

TOKEN = r"[\p{L}\p{N}_]+"
SURFACE = r"[\p{L}\p{N}]+(-[\p{L}\p{N}]+)*"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Lower-cased, white space runs to one space, none at the ends."""
    return strip(F.regexp_replace(F.lower(c), r"\s+", " "))


def preprocess(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-zA-Zа-яёА-ЯЁ\s.,!?]", ""), r"\s+", " "))


def clean_html(c: Column) -> Column:
    """Tags and links give way to spaces, white space runs to one space."""
    out = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"https?://\S+|www\.\S+", " ")
    return strip(F.regexp_replace(out, r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def surface_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(SURFACE), F.lit(0))


def sentences(c: Column) -> Column:
    parts = F.transform(F.split(c, r"[.!?]+"), strip)
    return F.filter(parts, lambda x: x != "")


def claims(c: Column) -> Column:
    """Sentences with their end signs, of more than three characters."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda x: F.length(x) > 3)


def ngrams(words: Column, n: int) -> Column:
    count = F.size(words) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(count >= 1, grams).otherwise(F.array().cast("array<string>"))


def hits(c: Column, markers: Sequence[str]) -> Column:
    """How many of the markers the text holds; a marker listed twice counts twice."""
    return sum((F.contains(c, F.lit(m)).cast("int") for m in markers), F.lit(0))


def any_of(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def sentiment(c: Column, positive: Sequence[str] = L.POSITIVE, negative: Sequence[str] = L.NEGATIVE) -> Column:
    """struct(label, score) of a text by its markers; both kinds make it mixed."""
    p, n = hits(F.lower(c), positive), hits(F.lower(c), negative)
    label = F.when((p > 0) & (n > 0), "mixed").when(p > 0, "positive").when(n > 0, "negative").otherwise("neutral")
    score = (
        F.when((p > 0) & (n > 0), F.lit(0.0))
        .when(p > 0, F.least(F.lit(1.0), 0.5 + 0.1 * p))
        .when(n > 0, F.greatest(F.lit(-1.0), -0.5 - 0.1 * n))
        .otherwise(F.lit(0.0))
    )
    return F.struct(label.alias("label"), score.alias("score"))


def confidence(label: Column) -> Column:
    return F.when(label != "neutral", 0.75).otherwise(0.55)


def weak_sentiment(field: Column, rating: Column) -> Column:
    return (
        F.when(field == "plus", "positive")
        .when(field == "minus", "negative")
        .when((field == "comment") & (rating >= 4), "positive")
        .when((field == "comment") & (rating <= 2), "negative")
        .when((field == "comment") & (F.abs(rating - 3) < 0.25), "mixed")
        .otherwise("neutral")
    )


def useful(c: Column) -> Column:
    """At least three of: ten words, two sentences, a detail word, two commas, a digit."""
    words = F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    marks = [
        words >= 10,
        F.size(sentences(c)) >= 2,
        any_of(F.lower(c), L.DETAIL),
        F.length(c) - F.length(F.replace(c, F.lit(","), F.lit(""))) >= 2,
        F.rlike(c, F.lit(r"\d")),
    ]
    return sum((m.cast("int") for m in marks), F.lit(0)) >= 3


def good_keyphrase(c: Column) -> Column:
    """Short, no contact data, few digits, not stop-words alone, nothing about delivery or prices."""
    p, low = strip(c), F.lower(strip(c))
    words = F.filter(F.split(p, r"\s+"), lambda x: x != "")
    alphabetic = F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{L}+$")))
    return (
        (p != "")
        & (F.length(p) <= 120)
        & ~F.rlike(p, F.lit(L.EMAIL))
        & ~F.rlike(p, F.lit(L.PHONE))
        & F.size(words).between(1, 5)
        & ~F.rlike(p, F.lit(L.MANY_DIGITS))
        & ~F.forall(alphabetic, lambda w: F.lower(w).isin(*L.KEYPHRASE_STOP))
        & ~any_of(low, L.EXPERIENCE)
    )


def has_punctuation(c: Column) -> Column:
    """Any ASCII punctuation sign."""
    return F.rlike(c, F.lit(r"\p{Punct}"))


def lemmatize(c: Column, known: dict[str, str] | None = None, stop: Sequence[str] = L.STOP_WORDS) -> Column:
    """Letters and spaces alone, each word by a table of lemmas (a plug-in; without one it's its own), stop-words dropped afterwards."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\s]", " "), r"\s+"), lambda w: w != "")
    if known:
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*stop)), " ")


NOMINAL = ("NOUN", "PROPN", "ADJ", "NUM")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not once for each thing that is read of it."""
    return F.get(F.transform(F.array(value), body), 0)


def nominal_chunks(tagged: Column, least: int = 3) -> Column:
    """Longest runs of nouns, names, adjectives and numerals in an array of (token, pos); runs of fewer than ``least`` characters go.

    What stands between two tokens of other kinds is cut out at once: the work is by the tokens, however many runs there are.
    """

    def runs(words: Column) -> Column:
        other = F.transform(words, lambda x, i: F.when(~F.coalesce(x["pos"].isin(*NOMINAL), F.lit(False)), i + 1))
        ends = F.concat(F.array(F.lit(0)), F.array_compact(other), F.array(F.size(words) + 1))
        return _let(ends, lambda at: F.transform(at, lambda end, k: F.struct(F.when(k > 0, F.get(at, k - 1)).otherwise(0).alias("start"), end.alias("end"))))

    def chunks(words: Column) -> Column:
        return _let(
            F.filter(runs(words), lambda r: r["end"] > r["start"] + 1),
            lambda some: F.transform(some, lambda r: F.array_join(F.transform(F.slice(words, r["start"] + 1, r["end"] - r["start"] - 1), lambda x: x["token"]), " ")),
        )

    return F.filter(_let(tagged, chunks), lambda c: F.length(c) >= least)


def specific_fact(c: Column) -> Column:
    return F.rlike(c, F.lit(f"(?iu){L.SPECIFIC}"))


def safe_suggestion(text: Column, context: Column) -> Column:
    low, typed = strip(F.lower(text)), F.lower(context)
    return (
        (F.length(text) <= 80)
        & ~F.rlike(text, F.lit(f"(?iu){L.UNSAFE}"))
        & ~F.rlike(text, F.lit(L.DATE))
        & ~((low != "") & F.contains(typed, low))
        & ~(any_of(low, L.DURATION) & ~any_of(typed, L.DURATION_TYPED))
    )


def full_text(title: Column, comment: Column, plus: Column, minus: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    named = lambda name, c: F.concat(F.lit(f"{name}: "), some(c))
    return F.concat_ws("\n", some(title), some(comment), named("Плюсы", plus), named("Минусы", minus))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def reader(category: Column) -> Column:
    """Who reads reviews of a category: exact key first, then the first key inside it."""
    low = strip(F.lower(category))
    pairs = list(L.READERS.items())
    out = F.when(low.isNull() | (low == ""), F.lit(L.READERS_DEFAULT))
    for key, who in pairs:
        out = out.when(low == key, F.lit(who))
    for key, who in pairs:
        out = out.when(F.contains(low, F.lit(key)), F.lit(who))
    return out.otherwise(F.lit(L.READERS_DEFAULT))


def text_state(text: Column, cursor: Column) -> Column:
    """What stands before the cursor: text, last token, last eight tokens, emptiness, trailing space."""
    at = F.greatest(F.lit(0), F.least(cursor, F.length(text)))
    before = F.substring(text, F.lit(1), at)
    found = F.regexp_extract_all(F.lower(before), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
    last = F.slice(found, F.greatest(F.lit(1), F.size(found) - 7), F.lit(8))
    return F.struct(
        before.alias("before"),
        F.try_element_at(found, F.lit(-1)).alias("current_token"),
        last.alias("last_tokens"),
        (strip(text) == "").alias("is_empty"),
        F.rlike(before, F.lit(r"\s$")).alias("ends_with_space"),
    )
