"""Registered queries over profiles: keyphrases, phrases, continuations, prefixes, styles, aspects, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import aspects as A
from ..operators import folds
from ..operators import catalogue as C
from ..operators import ngrams as N
from ..operators import profiles as P
from ..operators import suggest as S
from ..operators import summaries as M
from ..sources.adapter import reviews
from ..sources.stored import kept, new_folder
from .queries import GRAMS, SPANS_SQL, SQL, STOP, WITH_REVIEWS, query
from .texts import REQUESTS_SQL, requests

WEAK_SQL = """CASE WHEN section = 'plus' THEN 'positive' WHEN section = 'minus' THEN 'negative' WHEN section = 'comment' AND rating >= 4 THEN 'positive'
  WHEN section = 'comment' AND rating <= 2 THEN 'negative' WHEN section = 'comment' AND abs(rating - 3) < 0.25 THEN 'mixed' ELSE 'neutral' END"""
SEGMENTS_SQL = f"""{SPANS_SQL}, words AS (SELECT s.product_id, user_id, s.review_id, span_index, section AS field, rating, span_text, {WEAK_SQL} AS weak,
  regexp_extract_all(normalized, '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*') AS w FROM all_spans s JOIN reviews r USING (review_id))"""


def _grams(sizes) -> str:
    return " UNION ALL ".join(
        f"SELECT product_id, review_id, span_index, field, weak, rating, unnest(g) AS phrase, {n * 1_000_000} + generate_subscripts(g, 1) AS pos FROM (SELECT *, list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' ')) AS g FROM words)"
        for n in sizes
    )


def _filtered(p: str) -> str:
    words = f"list_filter(regexp_split_to_array({p}, '\\s+'), lambda x: x <> '')"
    return f"""length({p}) <= 120 AND len({words}) BETWEEN 1 AND 5 AND NOT regexp_matches({p}, '{L.PHONE}') AND NOT regexp_matches({p}, '{L.MANY_DIGITS}')
  AND len(list_filter({words}, lambda w: regexp_full_match(w, '\\p{{L}}+') AND lower(w) NOT IN {L.KEYPHRASE_STOP})) > 0
  AND len(list_filter({list(L.EXPERIENCE)}, lambda w: contains(lower({p}), w))) = 0"""


KEYPHRASES_SQL = f"""{SEGMENTS_SQL}, kg AS ({_grams((1, 2, 3))}),
kn AS (SELECT product_id, phrase, count(*) AS n, min([review_id, span_index]) AS first, min_by(field, [review_id, span_index]) AS field, min_by(weak, [review_id, span_index]) AS weak FROM kg
  WHERE len(list_filter(string_split(phrase, ' '), lambda x: x IN {STOP})) = 0 GROUP BY 1, 2 HAVING count(*) >= 2),
keyphrases AS (SELECT * FROM (SELECT product_id, phrase, n, field, weak, least(1.0::DOUBLE, n / 10::DOUBLE) AS score, row_number() OVER (PARTITION BY product_id ORDER BY least(1.0::DOUBLE, n / 10::DOUBLE) DESC, first, phrase) AS rank
  FROM kn WHERE {_filtered("phrase")}) WHERE rank <= 400)"""
BANK_SQL = f"""{SEGMENTS_SQL}, bg AS (SELECT * FROM ({_grams((2, 3))}) WHERE length(phrase) >= 4),
bank AS (SELECT product_id, phrase, count(*) AS n, max_by(field, [review_id, span_index, pos]) AS field, max_by(weak, [review_id, span_index, pos]) AS weak, avg(rating) AS rating_avg,
  least(1.0::DOUBLE, 0.3::DOUBLE + count(*) / 20::DOUBLE) AS quality FROM bg WHERE length(phrase) <= 120 AND NOT regexp_matches(phrase, '(?i){L.SPECIFIC}') GROUP BY 1, 2 HAVING count(*) >= 2)"""
CONTINUATIONS_SQL = f"""{SEGMENTS_SQL}, cw AS (SELECT product_id, review_id, span_index, weak, w, i, unnest(range(1, least(4, i) + 1)) AS k
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM words WHERE len(w) >= 2)),
cn AS (SELECT product_id, array_to_string(list_slice(w, i - k + 1, i), ' ') AS context, w[i + 1] AS next, count(*) AS n, min([review_id, span_index, i]) AS first, min_by(weak, [review_id, span_index, i]) AS weak FROM cw GROUP BY 1, 2, 3),
conts AS (SELECT * FROM (SELECT product_id, context, row_number() OVER (PARTITION BY product_id, context ORDER BY first, next) AS rank, next, n,
  CASE WHEN n = 1 THEN 0.55::DOUBLE ELSE least(1.0::DOUBLE, 0.5::DOUBLE + n / 15::DOUBLE) END AS score, weak FROM cn) WHERE rank <= 30)"""


def segments(spark, d):
    return N.segments(A.review_pieces(reviews(spark, d), "user_id", "rating"))


@query(f"{KEYPHRASES_SQL} SELECT * FROM keyphrases")
def keyphrases(spark, d):
    return N.keyphrases(segments(spark, d), stop=STOP).drop("first_seq")


@query(f"{BANK_SQL} SELECT * FROM bank")
def phrase_counts(spark, d):
    return N.phrase_bank(segments(spark, d))


@query(f"""{BANK_SQL} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY quality DESC, n DESC, phrase) AS rank FROM bank) WHERE rank <= 50""")
def phrases_stored(spark, d):
    return N.stored_phrases(N.phrase_bank(segments(spark, d)), 50)


def bank(segs):
    return folds.distinct_phrases(N.phrase_bank(segs))


@query()
def phrase_bank(spark, d):
    return N.stored_phrases(bank(segments(spark, d)))


@query()
def phrase_dedupe(spark, d):
    return bank(segments(spark, d))


@query(f"{CONTINUATIONS_SQL} SELECT * FROM conts")
def continuation_index(spark, d):
    return N.continuations(segments(spark, d))


KEYWORDS = (("a1", 0, "the "), ("a2", 1, "tion"), ("a3", 2, "en"))


@query(f"""{SEGMENTS_SQL}, lw AS (SELECT * REPLACE (list_filter(w, lambda x: length(x) >= 3) AS w) FROM words),
cw AS (SELECT product_id, review_id, span_index, weak, w, i, unnest(range(1, least(4, i) + 1)) AS k FROM (SELECT *, unnest(range(1, len(w))) AS i FROM lw WHERE len(w) >= 2)),
cn AS (SELECT product_id, array_to_string(list_slice(w, i - k + 1, i), ' ') AS context, array_to_string(list_slice(w, i + 1, i + 2), ' ') AS next, count(*) AS n, min([review_id, span_index, i]) AS first,
  min_by(weak, [review_id, span_index, i]) AS weak FROM cw GROUP BY 1, 2, 3),
c AS (SELECT *, row_number() OVER (PARTITION BY product_id, context ORDER BY first, next) AS rank FROM cn)
SELECT product_id, context, rank, next, n, CASE WHEN n = 1 THEN 0.55::DOUBLE ELSE least(1.0::DOUBLE, 0.5::DOUBLE + n / 15::DOUBLE) END AS score, weak,
  CASE WHEN contains(context || ' ' || next, 'the ') THEN 'a1' WHEN contains(context || ' ' || next, 'tion') THEN 'a2' WHEN contains(context || ' ' || next, 'en') THEN 'a3' END AS aspect_id FROM c WHERE rank <= 30""")
def lemma_continuations(spark, d):
    segs = segments(spark, d)
    keywords = segs.select("product_id").distinct().crossJoin(spark.createDataFrame(list(KEYWORDS), "aspect_id string, ord int, keyword string"))  # three rows
    return N.continuations(segs.withColumn("lemmas", N.lemmas(F.col("tokens"))), 2, column="lemmas", keywords=keywords)


@query()
def prefix_index(spark, d):
    return N.prefix_index(bank(segments(spark, d)))


PREFIXES_SQL = f"""entries AS (SELECT product_id, phrase, quality, weak, unnest(list_distinct(list_prepend(phrase, list_filter(string_split(phrase, ' '), lambda w: length(w) >= 3)))) AS insert_text FROM bank),
prefixes AS (SELECT product_id, phrase, quality, weak, insert_text, left(insert_text, unnest(range(2, least(40, length(insert_text)) + 1))) AS prefix FROM entries WHERE length(insert_text) >= 2),
index_of AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, prefix ORDER BY quality DESC, phrase, insert_text) AS rank FROM prefixes) WHERE rank <= 20)"""


@query(f"""{BANK_SQL}, {PREFIXES_SQL} SELECT product_id, prefix, count(*) AS entries, string_agg(phrase || '>' || insert_text || '>' || weak, '|' ORDER BY rank) AS texts, max(quality) AS best FROM index_of GROUP BY 1, 2""")
def prefix_buckets(spark, d):
    rows = N.prefix_rows(N.phrase_bank(segments(spark, d)))
    line = F.concat_ws(">", "text", "insert_text", "weak")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("product_id", "home", "prefix").agg(F.count("*").alias("entries"), F.array_join(lines, "|").alias("texts"), F.max("score").alias("best")).drop("home")


@query(f"""{SEGMENTS_SQL}, u AS (SELECT * FROM words WHERE user_id IS NOT NULL),
k AS (SELECT user_id, 'opener' AS kind, w[1] AS token FROM u WHERE len(w) > 0 UNION ALL SELECT user_id, 'connector', w[2] || ' ' || w[3] FROM u WHERE len(w) > 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY n DESC, token) AS rank FROM (SELECT user_id, kind, token, count(*) AS n FROM k GROUP BY ALL)),
l AS (SELECT user_id, string_agg(token, ',' ORDER BY rank) FILTER (kind = 'opener') AS opener, string_agg(token, ',' ORDER BY rank) FILTER (kind = 'connector') AS connector FROM r WHERE rank <= 15 GROUP BY 1)
SELECT user_id, count(*) AS segments, avg(len(w)) AS mean_tokens, avg(contains(span_text, '!')::INT) AS exclamation_rate, CASE WHEN avg(len(w)) < 8 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS short_practical,
  any_value(opener) AS opener, any_value(connector) AS connector FROM u LEFT JOIN l USING (user_id) GROUP BY 1""")
def user_style(spark, d):
    return N.user_style(segments(spark, d))


def _user_phrases(spark, d):
    own = segments(spark, d).filter("user_id is not null").withColumn("product_id", F.col("user_id"))
    return N.user_phrases(N.keyphrases(own, stop=STOP))


USER_KEYS_SQL = KEYPHRASES_SQL.replace(
    "words AS (SELECT s.product_id, user_id,", "words AS (SELECT user_id AS product_id, user_id,"
).replace("JOIN reviews r USING (review_id))", "JOIN reviews r USING (review_id) WHERE user_id IS NOT NULL)", 1)


@query(f"{USER_KEYS_SQL} SELECT product_id AS user_id, rank AS place, phrase FROM keyphrases WHERE rank <= 40")
def user_phrases(spark, d):
    return _user_phrases(spark, d)


# Aspects of a product without a fold: keyphrases by their first three letters.
CLUSTERS_SQL = f"""{KEYPHRASES_SQL}, bg AS (SELECT * FROM ({_grams((2, 3))}) WHERE length(phrase) >= 4),
bank AS (SELECT product_id, phrase, count(*) AS n, max_by(field, [review_id, span_index, pos]) AS field, max_by(weak, [review_id, span_index, pos]) AS weak, avg(rating) AS rating_avg,
  least(1.0::DOUBLE, 0.3::DOUBLE + count(*) / 20::DOUBLE) AS quality FROM bg WHERE length(phrase) <= 120 AND NOT regexp_matches(phrase, '(?i){L.SPECIFIC}') GROUP BY 1, 2 HAVING count(*) >= 2),
ca AS (SELECT product_id, left(phrase, 3) AS label, sum(n) AS weight, list(phrase ORDER BY n DESC, phrase) AS keywords FROM keyphrases GROUP BY 1, 2),
aspects AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY weight DESC, label) AS ord FROM ca) WHERE ord <= 20),
hit AS (SELECT b.product_id, ord, phrase, quality, weak FROM bank b JOIN aspects a ON a.product_id = b.product_id AND len(list_filter(a.keywords[1:20], lambda k: contains(phrase, k))) > 0),
hr AS (SELECT *, row_number() OVER (PARTITION BY product_id, ord ORDER BY quality DESC, phrase) AS r, row_number() OVER (PARTITION BY product_id, ord, weak ORDER BY quality DESC, phrase) AS m FROM hit),
hl AS (SELECT product_id, ord, list(phrase ORDER BY quality DESC, phrase) FILTER (r <= 10) AS representative, list(phrase ORDER BY quality DESC, phrase) FILTER (weak = 'positive' AND m <= 10) AS positive,
  list(phrase ORDER BY quality DESC, phrase) FILTER (weak = 'negative' AND m <= 10) AS negative FROM hr GROUP BY 1, 2),
discovered AS (SELECT a.product_id, a.ord, 'aspect-' || a.ord AS aspect_id, label, keywords, coalesce(representative, []) AS representative, coalesce(positive, []) AS positive, coalesce(negative, []) AS negative
  FROM aspects a LEFT JOIN hl ON a.product_id = hl.product_id AND a.ord = hl.ord)"""


def _aspects(segs):
    keys = N.keyphrases(segs, stop=STOP)
    clusters = keys.select("product_id", F.col("phrase").alias("label"), F.left("phrase", F.lit(3)).alias("name"))
    return keys, N.discover_aspects(keys, clusters, N.phrase_bank(segs))


@query(f"""{CLUSTERS_SQL} SELECT product_id, ord, aspect_id, label, array_to_string(keywords, '|') AS keywords, array_to_string(representative, '|') AS representative,
  array_to_string(positive, '|') AS positive, array_to_string(negative, '|') AS negative FROM discovered""")
def discovered_aspects(spark, d):
    rows = _aspects(segments(spark, d))[1]
    return rows.withColumns({c: F.array_join(c, "|") for c in ("keywords", "representative", "positive", "negative")})


PROFILE_SQL = f"""{CLUSTERS_SQL},
u AS (SELECT product_id, phrase, n, field, weak, rating_avg, quality FROM bank UNION ALL SELECT product_id, phrase, 1, field, weak, NULL, score FROM keyphrases WHERE rank <= 120
  UNION ALL SELECT product_id, unnest(representative[1:10]), 1, 'comment', 'neutral', NULL, 0.55::DOUBLE FROM discovered),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, phrase ORDER BY quality DESC, n DESC) AS k FROM u WHERE NOT regexp_matches(phrase, '(?i){L.SPECIFIC}')) WHERE k = 1),
kw AS (SELECT product_id, key, max_by(aspect_id, [ord, pos]) AS aspect_id FROM (SELECT product_id, ord, aspect_id, lower(unnest(keywords)) AS key, generate_subscripts(keywords, 1) AS pos FROM discovered) GROUP BY 1, 2),
profile AS (SELECT b.product_id, phrase, n, quality, aspect_id FROM best b LEFT JOIN kw ON kw.product_id = b.product_id AND kw.key = lower(phrase))"""


@query(f"{PROFILE_SQL} SELECT * FROM profile")
def profile_phrases(spark, d):
    segs = segments(spark, d)
    keys, aspects = _aspects(segs)
    return N.whole_bank(N.phrase_bank(segs), keys, aspects).select("product_id", "phrase", "n", "quality", "aspect_id")


@query(f"""{PROFILE_SQL} SELECT product_id, any_value(r.reviews_count) AS reviews_count, any_value(s.segments) AS segments_count, count(*) AS phrases, count(aspect_id) AS with_aspect FROM profile
  JOIN (SELECT product_id, count(*) AS reviews_count FROM reviews GROUP BY 1) r USING (product_id) JOIN (SELECT product_id, count(*) AS segments FROM words GROUP BY 1) s USING (product_id) GROUP BY 1""")
def product_profiles(spark, d):
    segs, rows = segments(spark, d), reviews(spark, d)
    keys, aspects = _aspects(segs)
    return N.profile_counts(rows, segs, N.whole_bank(N.phrase_bank(segs), keys, aspects))


SUGGEST_TAIL = """request_id, rank, text, insert_text, mode, source, round(score, 9) AS score"""
_SAFE = f"""length(c.shown) <= 80 AND NOT regexp_matches(c.shown, '(?i){L.UNSAFE}') AND NOT regexp_matches(c.shown, '{L.DATE}') AND NOT (trim(lower(c.shown)) <> '' AND contains(lower(before), trim(lower(c.shown))))
  AND NOT (len(list_filter({list(L.DURATION)}, lambda w: contains(trim(lower(c.shown)), w))) > 0 AND len(list_filter({list(L.DURATION_TYPED)}, lambda w: contains(lower(before), w))) = 0)"""
_SHIFT = """CASE WHEN field = 'plus' AND weak = 'positive' THEN 0.25 WHEN field = 'plus' AND weak = 'negative' THEN -0.2 WHEN field = 'minus' AND weak = 'negative' THEN 0.25
  WHEN field = 'minus' AND weak = 'positive' THEN -0.2 WHEN field = 'comment' AND rating >= 4 AND weak = 'positive' THEN 0.1 WHEN field = 'comment' AND rating <= 2 AND weak = 'negative' THEN 0.1 ELSE 0.0 END::DOUBLE"""
_BY_PREFIX = """asked AS (SELECT request_id, product_id, field, rating, before, current_token, left(current_token, unnest(range(2, least(40, length(current_token)) + 1))) AS prefix FROM states WHERE length(current_token) >= 2),
pj AS (SELECT * FROM (SELECT a.*, i.phrase, i.insert_text, i.quality, i.weak, i.rank, max(length(a.prefix)) OVER (PARTITION BY request_id) AS longest FROM asked a JOIN index_of i ON a.product_id = i.product_id AND a.prefix = i.prefix)
  WHERE length(prefix) = longest AND rank <= 15),
by_prefix AS (SELECT request_id, field, rating, before, 'prefix' AS source, phrase AS text, CASE WHEN starts_with(phrase, current_token) THEN phrase ELSE insert_text END AS insert_text,
  CASE WHEN starts_with(phrase, current_token) OR starts_with(insert_text, current_token) THEN 'replace_current_token' ELSE 'append' END AS mode, weak, quality AS prefix, 0.0::DOUBLE AS ngram, 0.0::DOUBLE AS mood, quality AS frequency, 0.5::DOUBLE AS quality, 0 AS place FROM pj)"""
_BY_NGRAM = """ctx AS (SELECT request_id, product_id, field, rating, before, k, array_to_string(last_tokens[len(last_tokens) - k + 1 : len(last_tokens)], ' ') AS context
  FROM (SELECT *, unnest(range(1, least(4, len(last_tokens)) + 1)) AS k FROM states WHERE len(last_tokens) > 0)),
nj AS (SELECT * FROM (SELECT x.*, c.next, c.n, c.score AS cscore, c.weak, c.rank, max(x.k) OVER (PARTITION BY request_id) AS longest FROM ctx x JOIN conts c ON x.product_id = c.product_id AND x.context = c.context) WHERE k = longest AND rank <= 12),
by_ngram AS (SELECT request_id, field, rating, before, 'ngram' AS source, next AS text, next AS insert_text, 'append' AS mode, weak, 0.0::DOUBLE AS prefix, cscore AS ngram, 0.5::DOUBLE AS mood, n / 20::DOUBLE AS frequency, 0.5::DOUBLE AS quality, 1 AS place FROM nj)"""


@query(f"{BANK_SQL}, {PREFIXES_SQL}, {REQUESTS_SQL.removeprefix(WITH_REVIEWS + ', ')}, {_BY_PREFIX} SELECT request_id, text, insert_text, mode, prefix FROM by_prefix")
def suggest_prefix(spark, d):
    states = S.requests(requests(spark, d))
    return S.by_prefix(states, N.prefix_index(N.phrase_bank(segments(spark, d)), asked=S.asked_prefixes(states))).select("request_id", "text", "insert_text", "mode", "prefix")


@query(f"{CONTINUATIONS_SQL}, {REQUESTS_SQL.removeprefix(WITH_REVIEWS + ', ')}, {_BY_NGRAM} SELECT request_id, text, ngram, frequency, mood FROM by_ngram")
def suggest_ngram(spark, d):
    states = S.requests(requests(spark, d))
    return S.by_ngram(states, N.continuations(segments(spark, d), asked=S.asked_contexts(states))).select("request_id", "text", "ngram", "frequency", "mood")


@query(f"""{BANK_SQL}, {PREFIXES_SQL}, {CONTINUATIONS_SQL.removeprefix(SEGMENTS_SQL + ', ')}, {REQUESTS_SQL.removeprefix(WITH_REVIEWS + ', ')}, {_BY_PREFIX}, {_BY_NGRAM},
u AS (SELECT * FROM by_prefix UNION ALL SELECT * FROM by_ngram), few AS (SELECT request_id FROM u GROUP BY 1 HAVING count(*) >= 3),
al AS (SELECT * FROM u UNION ALL SELECT request_id, field, rating, before, 'generic', starter, starter, 'append', 'neutral', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.4::DOUBLE, 2
  FROM (SELECT *, unnest({list(L.GENERIC_STARTERS)}) AS starter FROM states) s WHERE request_id NOT IN (SELECT request_id FROM few)),
c AS (SELECT *, coalesce(nullif(insert_text, ''), text) AS shown FROM al),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, trim(lower(shown)) ORDER BY place, frequency DESC, text) AS n FROM c WHERE trim(lower(shown)) <> '') WHERE n = 1),
scored AS (SELECT *, 0.25::DOUBLE * prefix + 0.25::DOUBLE * ngram + 0.10::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, mood + {_SHIFT})) + 0.10::DOUBLE * least(1.0::DOUBLE, frequency) + 0.05::DOUBLE * quality AS score FROM one c WHERE {_SAFE})
SELECT {SUGGEST_TAIL} FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, place, text, insert_text) AS rank FROM scored) WHERE rank <= 3""")
def suggest_basic(spark, d):
    segs, states = segments(spark, d), S.requests(requests(spark, d))
    prefixes = N.prefix_index(N.phrase_bank(segs), asked=S.asked_prefixes(states))
    rows = S.suggest(requests(spark, d), prefixes, N.continuations(segs, asked=S.asked_contexts(states)))
    return rows.withColumn("score", F.round("score", 9))


@query()
def suggest_ranked(spark, d):
    segs, states = segments(spark, d), S.requests(requests(spark, d))
    keys, aspects = _aspects(segs)
    phrases = folds.distinct_phrases(N.whole_bank(N.phrase_bank(segs), keys, aspects))
    contexts = S.asked_contexts(states)
    return S.suggest(
        requests(spark, d), N.prefix_index(phrases, asked=S.asked_prefixes(states)), N.continuations(segs, asked=contexts), _user_phrases(spark, d), aspects,
        N.continuations(segs.withColumn("lemmas", N.lemmas(F.col("tokens"))), 2, column="lemmas", asked=contexts),
    )


@query()
def suggest_aspect(spark, d):
    return S.by_aspect(S.requests(requests(spark, d)), _aspects(segments(spark, d))[1]).select("request_id", "text", "aspect")


@query()
def suggest_style(spark, d):
    return S.by_style(S.requests(requests(spark, d)), _user_phrases(spark, d)).select("request_id", "text", "style")


@query(f"""{SPANS_SQL}, words AS (SELECT product_id, review_id, span_index, list_filter(regexp_extract_all(normalized, '[\\p{{L}}\\p{{N}}_]+'), lambda x: x NOT IN {STOP}) AS w FROM all_spans),
g AS (SELECT product_id, unnest(g) AS phrase FROM ({GRAMS.format(n=1)}))
SELECT * FROM (SELECT product_id, phrase, count(*) AS n, row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, phrase) AS rank FROM g GROUP BY 1, 2) WHERE rank <= 50""")
def unigram_top(spark, d):
    return N.frequent_ngrams(A.review_pieces(reviews(spark, d)), "product_id", "span_text", 1, 50, STOP)


PHRASES = ("the then", "ing", "en on", "es", "that")


@query(f"""{WITH_REVIEWS}, p AS (SELECT unnest({list(PHRASES)}) AS phrase)
SELECT product_id, phrase, count(*) AS reviews FROM reviews r, p WHERE regexp_matches(lower(comment), '(^|[^\\p{{L}}\\p{{N}}_])' || phrase || '($|[^\\p{{L}}\\p{{N}}_])') GROUP BY 1, 2""")
def phrase_reviews(spark, d):
    rows = reviews(spark, d)
    phrases = rows.select("product_id").distinct().select("product_id", F.explode(F.array(*[F.lit(p) for p in PHRASES])).alias("phrase"))
    return M.phrase_reviews(phrases, rows, "comment")


SUGGEST_SQL = SQL["suggest_basic"]


def _stored(spark, d):
    """Profiles of most products; some are missing, some stale."""
    store = P.Profiles(spark, new_folder(spark))
    segs, prints = kept(segments(spark, d)), kept(C.fingerprint(reviews(spark, d), "product_id"))
    had = prints.filter("product_id % 5 > 0").withColumn("source_hash", F.when(F.col("product_id") % 5 == 1, "older").otherwise(F.col("source_hash")))
    store.build(segs, had, N.phrase_bank(segs), batch=("worker", 1))
    return store, store.prepare(requests(spark, d), prints)


@query(f"""{REQUESTS_SQL} SELECT request_id, product_id, CASE product_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'stale' ELSE 'ready' END AS profile, product_id % 5 < 2 AS fallback_used FROM requests""")
def prepared_contexts(spark, d):
    return _stored(spark, d)[1][0].select("request_id", "product_id", "profile", "fallback_used")


@query(f"""{REQUESTS_SQL} SELECT DISTINCT product_id, CASE product_id % 5 WHEN 0 THEN 'prepare_missing' ELSE 'prepare_stale' END AS reason FROM requests WHERE product_id % 5 < 2""")
def repair_jobs(spark, d):
    return _stored(spark, d)[1][1].select("product_id", "reason")


@query(SUGGEST_SQL.replace("u AS (SELECT * FROM by_prefix UNION ALL SELECT * FROM by_ngram)", "u AS (SELECT * FROM (SELECT * FROM by_prefix UNION ALL SELECT * FROM by_ngram) WHERE request_id IN (SELECT request_id FROM states WHERE product_id % 5 > 0))"))
def stored_suggestions(spark, d):
    """Suggestions from stored profiles: nothing of them is built for a request, and products without one get generic starters."""
    store, (contexts, _) = _stored(spark, d)
    return store.suggest(contexts).withColumn("score", F.round("score", 9))
