"""Registered queries over text functions, requests' text states, sampled vectors and small folds."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import aspects as A
from ..operators import catalogue as C
from ..operators import suggest as S
from ..operators import summaries as M
from ..sources import benchmark as B
from ..sources.adapter import reviews, table
from .queries import GRAMS, SPANS_SQL, SQL, STOP, STRIP, USEFUL_SQL, WITH_REVIEWS, query

# Tails that trip the filters, dealt out by id.
TAILS = ("", " 12 руб", " ДОСТАВКА", " Заказал вчера", " 5 дн", " через неделю сломался", " a.b+c@d-e.fg", " +7 900 123-45-67", " 1a2b3c4", " 01.02.2024", " и не все", " полгода")
TAIL_SQL = "([" + ", ".join(f"'{t}'" for t in TAILS) + f"])[(review_id + span_index) % {len(TAILS)} + 1]"
PIECES_SQL = f"""{SPANS_SQL}, tailed AS (SELECT review_id, product_id, span_index, span_text || {TAIL_SQL} AS phrase FROM all_spans)"""


def _pieces(spark, d):
    tails = F.array(*[F.lit(t) for t in TAILS])
    rows = A.review_pieces(reviews(spark, d))
    tail = F.get(tails, ((F.col("review_id") + F.col("span_index")) % len(TAILS)).cast("int"))
    return rows.select("review_id", "product_id", "span_index", F.concat("span_text", tail).alias("phrase"))


def _any(low: str, parts) -> str:
    return f"len(list_filter({list(parts)}, lambda w: contains({low}, w))) > 0"


_WORDS = "list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '')"


@query(f"""{PIECES_SQL} SELECT review_id, span_index, phrase FROM (SELECT *, {STRIP.format("phrase")} AS p FROM tailed) WHERE p <> '' AND length(p) <= 120
  AND NOT regexp_matches(p, '{L.EMAIL}') AND NOT regexp_matches(p, '{L.PHONE}') AND len({_WORDS}) BETWEEN 1 AND 5 AND NOT regexp_matches(p, '{L.MANY_DIGITS}')
  AND len(list_filter({_WORDS}, lambda w: regexp_full_match(w, '\\p{{L}}+') AND lower(w) NOT IN {L.KEYPHRASE_STOP})) > 0 AND NOT {_any("lower(p)", L.EXPERIENCE)}""")
def keyphrase_filter(spark, d):
    return _pieces(spark, d).filter(X.good_keyphrase(F.col("phrase"))).select("review_id", "span_index", "phrase")


@query(f"{PIECES_SQL} SELECT review_id, span_index, regexp_matches(phrase, '(?i){L.SPECIFIC}') AS specific FROM tailed")
def specific_facts(spark, d):
    return _pieces(spark, d).select("review_id", "span_index", X.specific_fact(F.col("phrase")).alias("specific"))


@query(f"""{PIECES_SQL} SELECT t.review_id, span_index, phrase FROM tailed t JOIN reviews r USING (review_id) WHERE length(phrase) <= 80 AND NOT regexp_matches(phrase, '(?i){L.UNSAFE}')
  AND NOT regexp_matches(phrase, '{L.DATE}') AND NOT ({STRIP.format("lower(phrase)")} <> '' AND contains(lower(comment), {STRIP.format("lower(phrase)")}))
  AND NOT ({_any(STRIP.format("lower(phrase)"), L.DURATION)} AND NOT {_any("lower(comment)", L.DURATION_TYPED)})""")
def safety_filter(spark, d):
    rows = _pieces(spark, d).join(reviews(spark, d).select("review_id", "comment"), "review_id")
    return rows.filter(X.safe_suggestion(F.col("phrase"), F.col("comment"))).select("review_id", "span_index", "phrase")


@query(f"{PIECES_SQL} SELECT review_id, span_index, regexp_matches(phrase, '[[:punct:]]') AS punctuation FROM tailed")
def punctuation(spark, d):
    return _pieces(spark, d).select("review_id", "span_index", X.has_punctuation(F.col("phrase")).alias("punctuation"))


@query(f"{PIECES_SQL} SELECT review_id, span_index, CASE WHEN length(phrase) > 12 THEN left(phrase, 12) || '…' ELSE phrase END AS label, printf('%s (%d отз.)', left(phrase, 5), span_index) AS counted FROM tailed")
def clipped_labels(spark, d):
    rows = _pieces(spark, d)
    return rows.select("review_id", "span_index", C.clipped(F.col("phrase"), 12).alias("label"), C.counted_label(F.left("phrase", F.lit(5)), F.col("span_index")).alias("counted"))


@query(f"""{WITH_REVIEWS} SELECT review_id, {STRIP.format("regexp_replace(lower(comment), '\\s+', ' ', 'g')")} AS clean, comment <> '' AS some,
  array_to_string(regexp_extract_all(lower(comment), '[\\p{{L}}\\p{{N}}_]+'), ' ') AS words, array_to_string(regexp_extract_all(lower(comment), '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*'), ' ') AS surface FROM reviews""")
def normalized_text(spark, d):
    c = F.col("comment")
    return reviews(spark, d).select(
        "review_id", X.collapse(c).alias("clean"), (c != "").alias("some"), F.array_join(X.tokens(c), " ").alias("words"), F.array_join(X.surface_tokens(c), " ").alias("surface")
    )


LEMMAS = {"then": "the", "thein": "the", "thation": "ation", "und": "and"}
_LEMMA_SQL = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEMMAS.items()) + " ELSE w END"


@query(f"""{WITH_REVIEWS} SELECT review_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(comment), '[^\\p{{L}}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> ''),
  lambda w: {_LEMMA_SQL}), lambda w: w NOT IN ('the', 'of', 'de')), ' ') AS lemmas FROM reviews""")
def lemmatized(spark, d):
    return reviews(spark, d).select("review_id", X.lemmatize(F.col("comment"), LEMMAS, ("the", "of", "de")).alias("lemmas"))


@query(f"""{WITH_REVIEWS}, w AS (SELECT review_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT review_id, regexp_extract_all(lower(comment), '[\\p{{L}}\\p{{N}}_]+') AS t FROM reviews)),
g AS (SELECT *, sum(CASE WHEN length(token) % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY review_id ORDER BY i) AS run FROM w),
c AS (SELECT review_id, min(i) AS i, string_agg(token, ' ' ORDER BY i) AS chunk FROM g WHERE length(token) % 4 > 0 GROUP BY review_id, run)
SELECT review_id, string_agg(chunk, '|' ORDER BY i) AS chunks FROM c WHERE length(chunk) >= 9 GROUP BY review_id""")
def nominal_chunks(spark, d):
    # a stand-in tagger: tokens of 4, 8, ... characters are verbs
    tagged = F.transform(X.tokens(F.col("comment")), lambda t: F.struct(t.alias("token"), F.when(F.length(t) % 4 == 0, "VERB").otherwise("NOUN").alias("pos")))
    chunks = F.array_join(X.nominal_chunks(tagged, 9), "|")
    # exploded, so that the filter reads what was made and doesn't make it again
    return reviews(spark, d).select("review_id", F.explode(F.filter(F.array(chunks), lambda c: c != "")).alias("chunks"))


CATEGORIES = ("Отель", " Кафе-бар ", "", "неизвестно", "SPA салон", None, "Школа танцев", "банк", "супермаркет у дома", "дом отдыха", "туроператор и отдых")
_READERS = ", ".join(f"({i}, '{k}', '{w}')" for i, (k, w) in enumerate(L.READERS.items()))
_CATEGORIES = "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in CATEGORIES) + "]"


@query(f"""WITH d AS (SELECT doc_id, {STRIP.format(f"lower(({_CATEGORIES})[doc_id % {len(CATEGORIES)} + 1])")} AS low FROM documents), r(i, k, who) AS (VALUES {_READERS})
SELECT doc_id, coalesce((SELECT min_by(who, CASE WHEN k = low THEN i - 1000 ELSE i END) FROM r WHERE low <> '' AND contains(low, k)), '{L.READERS_DEFAULT}') AS reader FROM d""")
def readers_of_category(spark, d):
    categories = F.array(*[F.lit(c).cast("string") for c in CATEGORIES])
    rows = table(spark, d, "documents").select("doc_id", F.get(categories, (F.col("doc_id") % len(CATEGORIES)).cast("int")).alias("category"))
    return rows.select("doc_id", X.reader(F.col("category")).alias("reader"))


@query(f"""{WITH_REVIEWS}, f AS (SELECT review_id, rating, 0 AS place, 'plus' AS field, plus AS t FROM reviews UNION ALL SELECT review_id, rating, 1, 'minus', minus FROM reviews
  UNION ALL SELECT review_id, rating, 2, 'comment', comment FROM reviews UNION ALL SELECT review_id, rating, 3, 'title', title FROM reviews),
s AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda x: {STRIP.format("x")}), lambda x: x <> '') AS parts FROM f WHERE t IS NOT NULL)
SELECT review_id, place, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS sentence,
  CASE WHEN field = 'plus' THEN 'positive' WHEN field = 'minus' THEN 'negative' WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment FROM s""")
def sentence_sentiments(spark, d):
    return M.sentence_sentiments(reviews(spark, d)).select("review_id", "place", "pos", "sentence", "sentiment")


ASPECTS = (("first", 0, "the"), ("first", 0, "tion"), ("second", 1, "ment"), ("second", 1, "the "))


@query(f"""{WITH_REVIEWS}, f AS (SELECT review_id, product_id, rating, 'plus' AS field, plus AS t FROM reviews UNION ALL SELECT review_id, product_id, rating, 'minus', minus FROM reviews
  UNION ALL SELECT review_id, product_id, rating, 'comment', comment FROM reviews UNION ALL SELECT review_id, product_id, rating, 'title', title FROM reviews),
s AS (SELECT review_id, product_id, CASE WHEN field = 'plus' THEN 'positive' WHEN field = 'minus' THEN 'negative' WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment,
  unnest(list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda x: lower({STRIP.format("x")})), lambda x: x <> '')) AS phrase FROM f WHERE t IS NOT NULL),
k(aspect, ord, keyword) AS (VALUES {", ".join(map(str, ASPECTS))}),
c AS (SELECT product_id, aspect, ord, sentiment, phrase, count(DISTINCT review_id) AS reviews FROM s JOIN k ON contains(phrase, keyword) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY product_id, aspect, sentiment ORDER BY reviews DESC, phrase) AS rank FROM c)
SELECT product_id, aspect, ord, sentiment, phrase, reviews, rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id, phrase, sentiment ORDER BY ord) AS n FROM r WHERE rank <= 5) WHERE n = 1""")
def aspect_method_phrases(spark, d):
    return M.aspect_phrases(reviews(spark, d), spark.createDataFrame(list(ASPECTS), "aspect string, ord int, keyword string"))


def stand_in(prompt: str) -> str:
    """A model that answers the methods' tasks by rules: it drops phrases of 3, 6, ... characters, shortens to the first word, counts, and sets full stops."""
    name, *parts = prompt.split("\t")
    given = [json.loads(p) for p in parts]
    if name == "filter":
        answer = {p: "negative" if len(p) % 2 else "positive" for p in given[0] if len(p) % 3}
    elif name == "generalize":
        answer = {p: p.split()[0] for p in given[0]}
    elif name == "aspects":
        answer = {"first": ["the", "tion"], "second": ["ment", "the "]}
    elif name == "generate":
        count = lambda kind: str(sum(p["sentiment"] == kind for p in given[0]))
        answer = {"positive": count("positive"), "negative": count("negative"), "general": str(len(given[1]))}
    else:
        answer = {k: v + "." for k, v in given[0].items()}
    return "```json\n" + json.dumps(answer, ensure_ascii=False) + "\n```"


_WORD = r"[^\p{L}\p{N}_]"


@query(f"""{USEFUL_SQL}, words AS (SELECT product_id, review_id, 0 AS span_index, list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x NOT IN {STOP}) AS w FROM useful),
g AS (SELECT product_id, unnest(g) AS phrase, 2 AS size FROM ({GRAMS.format(n=2)}) UNION ALL SELECT product_id, unnest(g), 3 FROM ({GRAMS.format(n=3)})),
r AS (SELECT *, row_number() OVER (PARTITION BY product_id, size ORDER BY n DESC, phrase) AS rank FROM (SELECT product_id, phrase, size, count(*) AS n FROM g GROUP BY 1, 2, 3)),
kept AS (SELECT product_id, phrase FROM r WHERE rank <= 40 AND length(phrase) % 3 > 0),
cnt AS (SELECT k.product_id, phrase, count(*) AS reviews FROM kept k JOIN useful u ON k.product_id = u.product_id AND contains(lower(t), phrase) AND regexp_matches(lower(t), '(^|{_WORD})' || phrase || '($|{_WORD})') GROUP BY 1, 2),
shown AS (SELECT product_id, least(10, count(*)) AS n FROM useful GROUP BY 1)
SELECT product_id, count(*) AS phrases, sum(reviews)::BIGINT AS reviews, count(*) FILTER (length(phrase) % 2 = 0) || '.' AS positive, count(*) FILTER (length(phrase) % 2 = 1) || '.' AS negative, any_value(shown.n) || '.' AS general,
  string_agg(DISTINCT string_split(phrase, ' ')[1], ',' ORDER BY string_split(phrase, ' ')[1]) AS shorts FROM cnt JOIN shown USING (product_id) GROUP BY 1""")
def llm_summary(spark, d):
    rows = M.llm(reviews(spark, d), stand_in, stop=STOP)
    total = F.aggregate("phrases", F.lit(0).cast("long"), lambda s, p: s + p["reviews"])
    shorts = F.array_join(F.array_sort(F.array_distinct(F.transform("phrases", lambda p: p["short"]))), ",")
    return rows.select("product_id", F.size("phrases").cast("long").alias("phrases"), total.alias("reviews"), "texts.*", shorts.alias("shorts"))


_ASPECT_SQL = SQL["aspect_method_phrases"]


@query(f"""SELECT a.product_id, count(*) AS phrases, sum(reviews)::BIGINT AS reviews, count(*) FILTER (sentiment = 'positive')::VARCHAR AS positive, count(*) FILTER (sentiment = 'negative')::VARCHAR AS negative, any_value(n)::VARCHAR AS general
FROM ({_ASPECT_SQL}) a JOIN (SELECT doc_id % 50 AS product_id, least(10, count(*)) AS n FROM documents WHERE text <> '' GROUP BY 1) s ON s.product_id = a.product_id GROUP BY 1""")
def aspect_summary(spark, d):
    rows = M.aspect(reviews(spark, d), stand_in)
    total = F.aggregate("phrases", F.lit(0).cast("long"), lambda s, p: s + p["reviews"])
    return rows.select("product_id", F.size("phrases").cast("long").alias("phrases"), total.alias("reviews"), "texts.*")


REQUESTS_SQL = f"""{WITH_REVIEWS}, requests AS (SELECT review_id AS request_id, product_id, user_id, (['title', 'plus', 'minus', 'comment'])[review_id % 4 + 1] AS field, rating, comment AS text,
  CAST(5 + review_id * 13 % 400 AS INTEGER) AS cursor FROM reviews),
cut AS (SELECT *, substring(text, 1, greatest(0, least(cursor, length(text)))) AS before FROM requests),
found AS (SELECT *, regexp_extract_all(lower(before), '[\\p{{L}}\\p{{N}}_-]+') AS w FROM cut),
states AS (SELECT request_id, product_id, user_id, field, rating, text, cursor, before, w[-1] AS current_token, w[greatest(1, len(w) - 7) : len(w)] AS last_tokens, {STRIP.format("text")} = '' AS is_empty FROM found)"""


def requests(spark, d):
    """A request for each review: its whole comment, typed up to some cursor."""
    fields = F.array(*[F.lit(f) for f in ("title", "plus", "minus", "comment")])
    return reviews(spark, d).select(
        F.col("review_id").alias("request_id"), "product_id", "user_id", F.get(fields, (F.col("review_id") % 4).cast("int")).alias("field"), "rating",
        F.col("comment").alias("text"), (5 + F.col("review_id") * 13 % 400).cast("int").alias("cursor"),
    )


@query(f"{REQUESTS_SQL} SELECT request_id, product_id, before, current_token, array_to_string(last_tokens, ' ') AS last_tokens, is_empty FROM states")
def text_state(spark, d):
    rows = S.requests(requests(spark, d))
    return rows.select("request_id", "product_id", "before", "current_token", F.array_join("last_tokens", " ").alias("last_tokens"), "is_empty")


@query(rf"""{REQUESTS_SQL} SELECT request_id, CASE WHEN request_id % 3 = 0 THEN regexp_replace(before, '[\p{{L}}\p{{N}}_-]+\s*$', '') || 'NEXT'
  ELSE before || CASE WHEN before = '' OR regexp_matches(before, '\s$') THEN '' ELSE ' ' END || 'NEXT' END || substring(text, least(cursor, length(text)) + 1, length(text)) AS text FROM states""")
def suggestion_insert(spark, d):
    mode = F.when(F.col("request_id") % 3 == 0, "replace_current_token").when(F.col("request_id") % 3 == 1, "replace_suffix").otherwise("append")
    return requests(spark, d).select("request_id", S.insert(F.col("text"), F.col("cursor"), F.lit("NEXT"), mode).alias("text"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) / ((sqrt(list_inner_product(a.e, a.e)) + 1e-9) * (sqrt(list_inner_product(b.e, b.e)) + 1e-9)) AS cosine
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM p) WHERE rank <= 5""")
def embedding_cosine_topk(spark, d):
    rows = table(spark, d, "embeddings").filter("embedding is not null").select("vec_id", "label", "embedding")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    pairs = asked.join(rows, "label").filter("query_id <> vec_id").withColumn("cosine", X.cosine(F.col("q"), F.col("embedding")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("query_id", "rank", "vec_id", F.round("cosine", 6).alias("cosine"))


@query("""WITH e AS (SELECT event_id, ts, event_id % 8 AS k FROM events),
f AS (SELECT event_id, CASE k WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'bad' WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
  WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+03:00' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS text,
  CASE WHEN k <= 2 THEN NULL WHEN k = 3 THEN epoch(date_trunc('day', ts))::BIGINT WHEN k = 6 THEN epoch(date_trunc('second', ts))::BIGINT - 10800 ELSE epoch(date_trunc('second', ts))::BIGINT END AS seconds FROM e)
SELECT event_id, text, seconds FROM f""")
def lenient_times(spark, d):
    k, ts = F.col("event_id") % 8, F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 1, "").when(k == 2, "bad").when(k == 3, F.date_format(ts, "yyyy-MM-dd")).when(k == 4, F.concat(iso, F.lit("Z")))
    text = text.when(k == 5, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 6, F.concat(iso, F.lit("+03:00"))).when(k == 7, iso)
    rows = table(spark, d, "events").select("event_id", text.alias("text"))
    return rows.select("event_id", "text", F.unix_seconds(B.lenient_time(F.col("text"))).alias("seconds"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN length(text) END AS general, CASE WHEN turn % 3 < 2 THEN 'yes' END AS positive FROM conversations""")
def answers_from_json(spark, d):
    # answers with fences, with talk around the object, and broken ones
    body = F.concat(F.lit('{"positive": "yes", "general": '), F.length("text").cast("string"), F.lit("}"))
    kind = F.col("turn") % 3
    answer = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise("{broken")
    rows = table(spark, d, "conversations").select("conv_id", "turn", M.answer_json(answer, "positive string, general long").alias("x"))
    return rows.select("conv_id", "turn", "x.general", "x.positive")


@query("""SELECT conv_id, turn, 'n=' || length(text) AS answer FROM conversations""")
def model_answers(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return M.with_model(rows, "text", lambda prompt: f"n={len(prompt)}").select("conv_id", "turn", "answer")
