"""The registered queries over the review tables, each beside the DuckDB text it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import aspects as A
from ..operators import catalogue as C
from ..operators import evaluation as E
from ..operators import folds
from ..operators import ngrams as N
from ..operators import summaries as M
from ..sources.adapter import REVIEWS_SQL, reviews, table
from ..sources.stored import kept
from ..streaming import jobs as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Words of the test corpora that stand in for a lexicon.
POSITIVE, NEGATIVE = ("thea", "ment", "ation"), ("worthless", "stupid", "inge", "ment")
PARAMS = A.Params(positive=POSITIVE, negative=NEGATIVE)
STOP = ("the", "of", "and", "de", "la", "der")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _hits(markers) -> str:
    return " + ".join(f"CAST(contains(normalized, '{m}') AS INT)" for m in markers)


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WITH_REVIEWS = f"WITH {REVIEWS_SQL}"
SECTIONS_SQL = f"""{WITH_REVIEWS}, sections AS (
  SELECT review_id, product_id, section_pos, section, {STRIP.format("text")} AS text FROM (
    SELECT review_id, product_id, 0 AS section_pos, 'title' AS section, title AS text FROM reviews
    UNION ALL SELECT review_id, product_id, 1, 'plus', plus FROM reviews
    UNION ALL SELECT review_id, product_id, 2, 'minus', minus FROM reviews
    UNION ALL SELECT review_id, product_id, 3, 'comment', comment FROM reviews) WHERE text <> '')"""
# positions are kept by compacting empty sections, so the order is the same
SPANS_SQL = f"""{SECTIONS_SQL}, pieces AS (
  SELECT review_id, product_id, section, section_pos, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos
  FROM (SELECT *, regexp_split_to_array(text, '[.!?;\\n]+') AS parts FROM sections)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY section_pos, pos) - 1 AS span_index
  FROM (SELECT review_id, product_id, section, section_pos, pos, {STRIP.format("piece")} AS span_text FROM pieces) WHERE length(span_text) >= 3),
all_spans AS (SELECT review_id, product_id, section, span_index, span_text, lower(span_text) AS normalized FROM numbered),
spans AS (SELECT * FROM all_spans WHERE span_index < 30)"""
GRAMS = """SELECT product_id, review_id, span_index, list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' ')) AS g FROM words"""
MENTIONS_SQL = f"""{SPANS_SQL},
words AS (SELECT product_id, review_id, span_index, regexp_extract_all(normalized, '[\\p{{L}}\\p{{N}}_]+') AS w FROM spans),
grams AS (SELECT product_id, unnest(g) AS candidate FROM ({GRAMS.format(n=1)} UNION ALL {GRAMS.format(n=2)} UNION ALL {GRAMS.format(n=3)})),
counted AS (SELECT product_id, candidate, count(*) AS n FROM grams GROUP BY ALL),
boosted AS (SELECT product_id, candidate, n + CASE WHEN NOT contains(candidate, ' ') AND
  row_number() OVER (PARTITION BY product_id, contains(candidate, ' ') ORDER BY n DESC, candidate) <= 50 THEN 1 ELSE 0 END AS n FROM counted),
cands AS (SELECT product_id, candidate, n FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, candidate) AS k FROM boosted) WHERE k <= 120 AND length(candidate) >= 3),
held AS (SELECT s.*, c.candidate AS aspect, row_number() OVER (PARTITION BY s.review_id, s.span_index ORDER BY length(c.candidate) DESC, c.candidate) AS k
  FROM spans s JOIN cands c ON s.product_id = c.product_id AND contains(s.normalized, c.candidate)),
moods AS (SELECT *, {_hits(POSITIVE)} AS p, {_hits(NEGATIVE)} AS q FROM held WHERE k <= 3),
mentions AS (SELECT product_id, review_id, section, span_index, span_text, aspect,
  CASE WHEN p > 0 AND q > 0 THEN 'mixed' WHEN p > 0 THEN 'positive' WHEN q > 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN p > 0 AND q > 0 THEN 0.0::DOUBLE WHEN p > 0 THEN least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * p)
    WHEN q > 0 THEN greatest(-1.0::DOUBLE, -0.5::DOUBLE - 0.1::DOUBLE * q) ELSE 0.0::DOUBLE END AS score, CASE WHEN p > 0 OR q > 0 THEN 0.75::DOUBLE ELSE 0.55::DOUBLE END AS confidence FROM moods)"""
STATS_SQL = f"""{MENTIONS_SQL},
totals AS (SELECT product_id, count(*) AS m FROM reviews GROUP BY 1),
counts AS (SELECT product_id, aspect AS name, count(*) AS total, count(*) FILTER (sentiment = 'positive') AS positive,
  count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral,
  count(*) FILTER (sentiment = 'mixed') AS mixed, count(DISTINCT review_id) AS review_count FROM mentions GROUP BY 1, 2),
parts AS (SELECT c.*, total / m::DOUBLE AS prevalence, CASE WHEN positive + negative = 0 THEN 0.0::DOUBLE
  ELSE 1.0::DOUBLE - abs(positive - negative) / (positive + negative)::DOUBLE END AS balance,
  least(1.0::DOUBLE, 0.2::DOUBLE + 1 * 0.12::DOUBLE) AS informativeness, least(1.0::DOUBLE, review_count / m::DOUBLE) AS diversity
  FROM counts c JOIN totals USING (product_id)),
scored AS (SELECT *, prevalence <= 0.08::DOUBLE AS rare, 0.35::DOUBLE * prevalence + 0.2::DOUBLE * balance + 0.2::DOUBLE * informativeness + 0.2::DOUBLE * diversity
  + CASE WHEN prevalence <= 0.08::DOUBLE THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM parts)"""
PLAN_SQL = f"""{STATS_SQL},
planned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY importance DESC, name) AS rank,
  CASE WHEN positive > negative THEN 'positive' WHEN negative > positive THEN 'negative'
    WHEN neutral >= greatest(positive, negative) THEN 'neutral' ELSE 'balanced' END AS target FROM scored) WHERE rank <= 8)"""
EVIDENCE_SQL = f"""{PLAN_SQL},
best AS (SELECT * FROM (SELECT m.*, p.name, row_number() OVER (PARTITION BY m.product_id, p.name, review_id
  ORDER BY (sentiment = target AND target IN ('positive', 'negative')) DESC, span_index, aspect) AS k
  FROM mentions m JOIN planned p ON m.product_id = p.product_id AND m.aspect = p.name) WHERE k = 1),
evidence AS (SELECT * FROM (SELECT product_id, name, row_number() OVER (PARTITION BY product_id, name ORDER BY review_id, span_index, aspect) AS rank,
  review_id, section, span_text, sentiment FROM best) WHERE rank <= 3)"""


def _spans(spark, d):
    return A.review_pieces(reviews(spark, d), most=PARAMS.max_spans_per_review)


def _mentions(spark, d):
    spanned = _spans(spark, d)
    return A.canonical(A.mentions(spanned, A.candidates(spanned, PARAMS), PARAMS))


def _found(spark, d):
    """Mentions for a query that reads them more than once."""
    return kept(_mentions(spark, d))


def _scored(spark, d, found=None):
    totals = reviews(spark, d).groupBy("product_id").agg(F.count("*").alias("reviews_count"))
    return A.stats(_mentions(spark, d) if found is None else found, totals, PARAMS)


def _planned(spark, d, found=None):
    return A.plan(_scored(spark, d, found), PARAMS)


def _evidence(spark, d, found=None):
    found = _found(spark, d) if found is None else found
    return A.evidence(found, _planned(spark, d, found), PARAMS)


@query(f"{WITH_REVIEWS} SELECT review_id, product_id, rating, epoch(review_date)::BIGINT AS at FROM reviews WHERE rating >= 3 AND rating <= 5 AND review_date >= TIMESTAMP '2024-01-03'")
def reviews_filtered(spark, d):
    rows = C.filter_reviews(reviews(spark, d), rating_min=3, rating_max=5, date_from="2024-01-03")
    return rows.select("review_id", "product_id", "rating", F.unix_seconds("review_date").alias("at"))


@query(f"{WITH_REVIEWS} SELECT product_id, count(*) AS reviews_count, avg(rating) AS rating_avg, epoch(min(review_date))::BIGINT AS date_min, epoch(max(review_date))::BIGINT AS date_max FROM reviews GROUP BY 1")
def review_stats(spark, d):
    rows = C.review_stats(reviews(spark, d), "product_id")
    return rows.withColumns({c: F.unix_seconds(c) for c in ("date_min", "date_max")})


@query(f"{WITH_REVIEWS} SELECT p.p_partkey AS product_id, p.p_name AS name, count(r.review_id) AS reviews_count FROM part p LEFT JOIN reviews r ON p.p_partkey = r.product_id GROUP BY 1, 2")
def products_with_counts(spark, d):
    products = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    return C.products_with_counts(products, reviews(spark, d))


@query(f"{WITH_REVIEWS} SELECT DISTINCT product_id, source FROM reviews")
def sources_distinct(spark, d):
    return reviews(spark, d).select("product_id", "source").distinct()


@query(f"{WITH_REVIEWS} SELECT product_id, rank, review_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY review_date DESC NULLS LAST, review_id) AS rank FROM reviews) WHERE rank <= 3")
def latest_per_key(spark, d):
    return C.latest_per_key(reviews(spark, d), ["product_id"], "review_date", "review_id", 3).select("product_id", "rank", "review_id")


@query(f"{WITH_REVIEWS} SELECT source, count(*) AS n FROM reviews GROUP BY 1")
def set_overview(spark, d):
    return C.overview(reviews(spark, d), "source")


@query(f"{WITH_REVIEWS} SELECT review_id, product_id FROM reviews ORDER BY review_date DESC NULLS LAST, review_id LIMIT 40 OFFSET 20")
def paged_reviews(spark, d):
    return C.list_reviews(reviews(spark, d), 40, 20).select("review_id", "product_id")


@query(f"{WITH_REVIEWS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, review_id) AS place, review_id FROM reviews WHERE user_id IS NOT NULL")
def user_history(spark, d):
    from pyspark.sql import Window

    rows = C.oldest_per_key(reviews(spark, d), "user_id")
    return rows.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "review_id")).alias("place"), "review_id")


@query(f"{SECTIONS_SQL} SELECT review_id, section, text FROM sections")
def sections_long(spark, d):
    return A.sections(reviews(spark, d)).select("review_id", "section", "text")


@query(f"{SECTIONS_SQL} SELECT review_id, string_agg('[' || upper(section) || '] ' || text, chr(10) ORDER BY section_pos) AS canonical_text FROM sections GROUP BY 1")
def canonical_text(spark, d):
    return A.canonical_text(A.sections(reviews(spark, d)))


@query(f"{SPANS_SQL} SELECT review_id, section, span_index, span_text FROM spans")
def spans_capped(spark, d):
    return _spans(spark, d).select("review_id", "section", "span_index", "span_text")


@query(f"{WITH_REVIEWS} SELECT review_id, regexp_replace(regexp_replace(regexp_replace(lower(comment), '[^a-zA-Zа-яёА-ЯЁ\\s.,!?]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM reviews")
def preprocess_text(spark, d):
    return reviews(spark, d).select("review_id", X.preprocess(F.col("comment")).alias("clean"))


@query(f"""{WITH_REVIEWS} SELECT review_id, unnest(list_filter(list_transform(string_split(regexp_replace(comment, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
  lambda x: {STRIP.format("x")}), lambda x: length(x) > 3)) AS claim FROM reviews""")
def claims_split(spark, d):
    return reviews(spark, d).select("review_id", F.explode(X.claims(F.col("comment"))).alias("claim"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages")
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_html(F.col("html")).alias("text"))


@query(f"""{WITH_REVIEWS} SELECT review_id, CASE WHEN section = 'plus' THEN 'positive' WHEN section = 'minus' THEN 'negative' WHEN section = 'comment' AND rating >= 4 THEN 'positive'
  WHEN section = 'comment' AND rating <= 2 THEN 'negative' WHEN section = 'comment' AND abs(rating - 3) < 0.25 THEN 'mixed' ELSE 'neutral' END AS weak, section
  FROM reviews, (VALUES ('title'), ('plus'), ('minus'), ('comment')) AS s(section)""")
def weak_sentiment(spark, d):
    rows = reviews(spark, d).select("review_id", "rating", F.explode(F.array(*map(F.lit, ("title", "plus", "minus", "comment")))).alias("section"))
    return rows.select("review_id", X.weak_sentiment(F.col("section"), F.col("rating")).alias("weak"), "section")


FULL_TEXT_SQL = "concat_ws(chr(10), nullif(title, ''), nullif(comment, ''), 'Плюсы: ' || nullif(plus, ''), 'Минусы: ' || nullif(minus, ''))"
USEFUL_SQL = f"""{WITH_REVIEWS}, judged AS (SELECT review_id, product_id, t,
  CAST(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) >= 10 AS INT)
  + CAST(len(list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda x: {STRIP.format("x")}), lambda x: x <> '')) >= 2 AS INT)
  + CAST(len(list_filter({list(L.DETAIL)}, lambda w: contains(lower(t), w))) > 0 AS INT)
  + CAST(length(t) - length(replace(t, ',', '')) >= 2 AS INT) + CAST(regexp_matches(t, '[0-9]') AS INT) >= 3 AS useful FROM (SELECT *, {FULL_TEXT_SQL} AS t FROM reviews) WHERE t <> ''),
useful AS (SELECT * FROM (SELECT *, bool_or(useful) OVER (PARTITION BY product_id) AS any_useful FROM judged) WHERE useful OR NOT any_useful)"""


@query(f"{USEFUL_SQL} SELECT review_id, product_id, useful, md5(t) AS text FROM useful")
def useful_reviews(spark, d):
    return M.useful_reviews(reviews(spark, d)).select("review_id", "product_id", "useful", F.md5("full_text").alias("text"))


@query(f"""{SPANS_SQL}, words AS (SELECT product_id, review_id, span_index, list_filter(regexp_extract_all(normalized, '[\\p{{L}}\\p{{N}}_]+'), lambda x: x NOT IN {STOP}) AS w FROM all_spans),
g AS (SELECT product_id, unnest(g) AS phrase, 2 AS size FROM ({GRAMS.format(n=2)}) UNION ALL SELECT product_id, unnest(g), 3 FROM ({GRAMS.format(n=3)}))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, size ORDER BY n DESC, phrase) AS rank
  FROM (SELECT product_id, phrase, size, count(*) AS n FROM g GROUP BY 1, 2, 3)) WHERE rank <= 40""")
def bigram_trigram_top(spark, d):
    return N.bigrams_and_trigrams(A.review_pieces(reviews(spark, d)), "product_id", "span_text", 80, STOP)


@query(f"{MENTIONS_SQL} SELECT product_id, candidate, n FROM cands")
def candidate_freq(spark, d):
    return A.candidates(_spans(spark, d), PARAMS)


@query(f"{MENTIONS_SQL} SELECT * FROM mentions")
def mentions(spark, d):
    return _mentions(spark, d).drop("name")


@query(f"{STATS_SQL} SELECT product_id, name, total, positive, negative, neutral, mixed, review_count FROM scored")
def aspect_stats(spark, d):
    return _scored(spark, d).select("product_id", "name", "total", "positive", "negative", "neutral", "mixed", "review_count")


@query(f"{STATS_SQL} SELECT product_id, name, prevalence, balance, diversity, importance, rare FROM scored")
def aspect_scores(spark, d):
    return _scored(spark, d).select("product_id", "name", "prevalence", "balance", "diversity", "importance", "rare")


@query(f"{PLAN_SQL} SELECT product_id, rank, name, target FROM planned")
def content_plan(spark, d):
    return _planned(spark, d).select("product_id", "rank", "name", "target")


@query(f"{PLAN_SQL} SELECT s.product_id, aspects, selected, rare_selected, round(mean, 9) AS mean_importance, aspects - selected AS dropped FROM (SELECT product_id, count(*) AS aspects FROM scored GROUP BY 1) s JOIN (SELECT product_id, count(*) AS selected, count(*) FILTER (rare) AS rare_selected, avg(importance) AS mean FROM planned GROUP BY 1) p USING (product_id)")
def plan_diagnostics(spark, d):
    scored = _scored(spark, d, _found(spark, d))
    return A.plan_diagnostics(scored, A.plan(scored, PARAMS)).withColumn("mean_importance", F.round("mean_importance", 9))


@query(f"{EVIDENCE_SQL} SELECT * FROM evidence")
def evidence_top(spark, d):
    return _evidence(spark, d)


GROUNDED_SQL = f"""{EVIDENCE_SQL}, per AS (SELECT product_id, name, bool_and(sentiment = 'positive') AS ap, bool_and(sentiment = 'negative') AS an, count(*) AS count,
  string_agg(span_text, '; ' ORDER BY rank) FILTER (rank <= 2) AS s FROM evidence GROUP BY 1, 2),
sentences AS (SELECT product_id, p.rank AS plan_rank, name, CASE WHEN ap THEN 'pros' WHEN an THEN 'cons' ELSE 'neutral' END AS bucket, name || ': ' || s AS sentence,
  target AS sentiment, count, least(1.0::DOUBLE, count / (sum(count) OVER (PARTITION BY product_id))::DOUBLE) AS share FROM planned p JOIN per USING (product_id, name)),
by_bucket AS (SELECT product_id, bucket, string_agg(sentence, ' | ' ORDER BY plan_rank) AS line, string_agg(sentence, chr(10) ORDER BY plan_rank) AS lines FROM sentences GROUP BY 1, 2),
texts AS (SELECT product_id, concat_ws(chr(10), 'Сильные стороны: ' || max(line) FILTER (bucket = 'pros'), 'Слабые стороны: ' || max(line) FILTER (bucket = 'cons'),
  'Смешанные наблюдения: ' || max(line) FILTER (bucket = 'neutral')) AS text_overall, max(lines) FILTER (bucket = 'pros') AS text_pros,
  max(lines) FILTER (bucket = 'cons') AS text_cons, max(lines) FILTER (bucket = 'neutral') AS text_neutral FROM by_bucket GROUP BY 1)"""


@query(f"{GROUNDED_SQL} SELECT * FROM sentences")
def grounded_text(spark, d):
    return _grounded(spark, d)


def _grounded(spark, d, found=None):
    found = _found(spark, d) if found is None else found
    return A.grounded(_planned(spark, d, found), _evidence(spark, d, found))


@query(f"{GROUNDED_SQL} SELECT * FROM texts")
def summary_texts(spark, d):
    return A.summary_text(_grounded(spark, d))


@query(f"""{GROUNDED_SQL}, v AS (SELECT p.product_id, p.name, e.name IS NULL AS lost, NOT contains(lower(concat_ws(' ', text_overall, text_pros, text_cons, text_neutral)), lower(p.name)) AS unsaid,
  coalesce(text_overall, text_pros, text_cons) IS NULL AS blank FROM planned p LEFT JOIN (SELECT DISTINCT product_id, name FROM evidence) e ON p.product_id = e.product_id AND p.name = e.name
  LEFT JOIN texts t ON t.product_id = p.product_id WHERE p.name <> 'the')
SELECT product_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (lost), '') AS missing, coalesce(string_agg(name, ',' ORDER BY name) FILTER (unsaid), '') AS unmentioned,
  bool_or(blank) AS empty_text, NOT bool_or(lost) AND NOT bool_or(blank) AS passed FROM v GROUP BY 1""")
def verify_plan(spark, d):
    found = _found(spark, d)
    planned, proof = _planned(spark, d, found).filter("name <> 'the'"), _evidence(spark, d, found)
    rows = A.verify(planned, proof, A.summary_text(_grounded(spark, d, found)))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("missing", "unmentioned")})


@query(f"{MENTIONS_SQL} SELECT section, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'mixed') AS mixed FROM mentions GROUP BY 1")
def section_sentiment_pivot(spark, d):
    return A.section_sentiment(_mentions(spark, d))


@query(f"{MENTIONS_SQL} SELECT review_id, span_index, aspect FROM mentions WHERE (contains(lower(aspect), 'the') OR contains(lower(span_text), 'the')) AND section IN ('title', 'plus') AND sentiment IN ('positive', 'neutral')")
def mention_search(spark, d):
    return A.search_mentions(_mentions(spark, d), "The", ("title", "plus"), ("positive", "neutral")).select("review_id", "span_index", "aspect")


LEDGER_SQL = f"""{STATS_SQL}, ledger AS (SELECT product_id, name, total AS n, total / (sum(total) OVER (PARTITION BY product_id))::DOUBLE AS salience,
  CASE WHEN (positive = top)::INT + (negative = top)::INT + (neutral = top)::INT + (mixed = top)::INT > 1 THEN 'mixed' WHEN positive = top THEN 'positive'
    WHEN negative = top THEN 'negative' WHEN neutral = top THEN 'neutral' ELSE 'mixed' END AS expected, total <= 2 AND review_count <= 2 AS rare
  FROM (SELECT *, greatest(positive, negative, neutral, mixed) AS top FROM counts))"""


@query(f"{LEDGER_SQL} SELECT * FROM ledger")
def ledger_salience(spark, d):
    return E.ledger(_mentions(spark, d)).select("product_id", "name", "n", "salience", "expected", "rare")


@query(f"""{MENTIONS_SQL}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, aspect, review_id, {STRIP.format("lower(span_text)")} ORDER BY span_index) AS k FROM mentions) WHERE k = 1)
SELECT * FROM (SELECT product_id, aspect AS name, row_number() OVER (PARTITION BY product_id, aspect ORDER BY review_id, span_index) AS rank, review_id, span_text, section, sentiment, confidence FROM once) WHERE rank <= 5""")
def ledger_evidence(spark, d):
    return E.ledger_evidence(_mentions(spark, d))


def _segments(spark, d):
    return N.segments(A.review_pieces(reviews(spark, d), "user_id", "rating"))


@query()
def label_clusters(spark, d):
    labels = _mentions(spark, d).select("product_id", F.col("aspect").alias("label")).distinct()
    return folds.label_clusters(labels)


@query()
def semantic_clusters(spark, d):
    rows = table(spark, d, "embeddings").filter("vec_id is not null and embedding is not null")
    rows = rows.select((F.col("vec_id") % 20).alias("key"), "vec_id", "embedding")
    return folds.semantic_clusters(rows, "key", "vec_id", "embedding", 1.1)


_SIZED = lambda c: f"strlen(coalesce({c}, ''))::VARCHAR || ':' || coalesce({c}, '')"
_STAMP = lambda c: f"coalesce(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '')"
HASH_SQL = f"""{WITH_REVIEWS}, h AS (SELECT product_id, review_id, sha256(concat_ws(',', coalesce(printf('%.4f', rating), ''), {_STAMP("review_date")}, {_STAMP("created_at")},
  {", ".join(_SIZED(c) for c in ("title", "comment", "plus", "minus"))})) AS h FROM reviews),
prints AS (SELECT product_id, sha256(product_id::VARCHAR || ':' || string_agg(review_id::VARCHAR || ':' || h, ',' ORDER BY review_id, h)) AS source_hash FROM h GROUP BY 1)"""


@query(f"{HASH_SQL} SELECT * FROM prints")
def source_hash(spark, d):
    return C.fingerprint(reviews(spark, d), "product_id")


@query(f"{HASH_SQL} SELECT product_id, source_hash, CASE WHEN product_id % 3 = 0 THEN 'missing' WHEN product_id % 3 = 1 THEN 'stale' ELSE 'ready' END AS state FROM prints")
def profile_staleness(spark, d):
    prints = C.fingerprint(reviews(spark, d), "product_id")
    stored = prints.filter("product_id % 3 > 0").select("product_id", F.when(F.col("product_id") % 3 == 1, "old").otherwise(F.col("source_hash")).alias("source_hash"), F.lit("ready").alias("status"))
    return J.staleness(prints, stored)


@query(f"{WITH_REVIEWS} SELECT DISTINCT 'product' AS job_type, product_id, NULL::BIGINT AS user_id, true AS force FROM reviews UNION ALL SELECT DISTINCT 'user', NULL, user_id, true FROM reviews WHERE user_id IS NOT NULL")
def invalidation_jobs(spark, d):
    return J.invalidations(reviews(spark, d))


@query("""WITH RECURSIVE j AS (SELECT 'product:' || (user_id % 7)::VARCHAR AS k, user_id % 7 AS p, ts FROM events WHERE event_id % 50 > 0),
w(k, t) AS (SELECT k, min(ts) FROM j GROUP BY k UNION ALL SELECT w.k, min(j.ts) FROM w JOIN j ON j.k = w.k AND j.ts >= w.t + INTERVAL 10 MINUTE GROUP BY w.k)
SELECT k AS job_key, epoch_us(t) AS at, false AS force FROM w UNION ALL SELECT 'product:' || (user_id % 7)::VARCHAR, epoch_us(ts), true FROM events WHERE event_id % 50 = 0""")
def job_dedup(spark, d):
    jobs = table(spark, d, "events").select(
        F.lit("product").alias("job_type"), (F.col("user_id") % 7).alias("product_id"), F.lit(None).cast("long").alias("user_id"),
        (F.col("event_id") % 50 == 0).alias("force"), F.lit(0).alias("attempt"), F.col("ts").cast("timestamp").alias("enqueued_at"),
    )
    return J.deduplicated(jobs).select("job_key", F.unix_micros("enqueued_at").alias("at"), "force")


@query("""SELECT CASE event_type WHEN 'view' THEN 'shown' WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'dismissed' WHEN 'signup' THEN 'prepared' END AS event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error', 'signup') GROUP BY 1""")
def suggestion_events(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("view", "shown", "click", "accepted", "error", "dismissed", "signup", "prepared")])
    events = table(spark, d, "events").select(F.coalesce(F.element_at(names, F.col("event_type")), "event_type").alias("event_type"))
    return J.valid_events(events).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""{WITH_REVIEWS}, b AS (SELECT product_id, review_id, md5(review_id || ':0') AS dice,
  CASE WHEN rating IS NULL THEN 'none' WHEN rating <= 2 THEN 'low' WHEN rating < 4 THEN 'middle' ELSE 'high' END AS band FROM reviews),
c AS (SELECT *, row_number() OVER (PARTITION BY product_id, band ORDER BY dice, review_id) AS k,
  greatest(1, floor(10 * count(*) OVER (PARTITION BY product_id, band) / (count(*) OVER (PARTITION BY product_id))::DOUBLE + 0.5))::BIGINT AS quota FROM b)
SELECT product_id, review_id, band, quota FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY (k > quota)::INT, k, dice, review_id) AS n FROM c) WHERE n <= 10""")
def stratified_sample(spark, d):
    return folds.stratified(reviews(spark, d), 10).select("product_id", "review_id", "band", "quota")


@query(f"""{WITH_REVIEWS}, k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY length(comment) DESC, review_id) AS k FROM reviews)
SELECT product_id, review_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY md5(review_id || ':0'), review_id) AS m FROM k WHERE k <= 20) WHERE m <= 10""")
def representative_reviews(spark, d):
    return folds.representative(reviews(spark, d), 10, 20).select("product_id", "review_id")


@query(f"""{WITH_REVIEWS}, k AS (SELECT *, row_number() OVER (PARTITION BY product_id, nullif(plus, '') IS NULL ORDER BY review_id) AS p, row_number() OVER (PARTITION BY product_id, nullif(minus, '') IS NULL ORDER BY review_id) AS m FROM reviews)
SELECT product_id, count(*) AS reviews_count, avg(rating) AS rating_avg, string_agg(plus, '; ' ORDER BY review_id) FILTER (plus <> '' AND p <= 3) AS text_pros,
  string_agg(minus, '; ' ORDER BY review_id) FILTER (minus <> '' AND m <= 3) AS text_cons FROM k GROUP BY 1""")
def stub_summary(spark, d):
    return M.stub(reviews(spark, d))


@query(f"""{WITH_REVIEWS}, k AS (SELECT *, row_number() OVER (PARTITION BY product_id, nullif(plus, '') IS NULL ORDER BY review_id) AS p, row_number() OVER (PARTITION BY product_id, nullif(minus, '') IS NULL ORDER BY review_id) AS m FROM reviews),
t AS (SELECT product_id, count(*) AS n, string_agg(plus, '; ' ORDER BY review_id) FILTER (plus <> '' AND p <= 3) AS pros, string_agg(minus, '; ' ORDER BY review_id) FILTER (minus <> '' AND m <= 3) AS cons FROM k GROUP BY 1)
SELECT product_id, replace('{L.STUB["overall"]}', '%d', n::VARCHAR) AS text_overall, replace('{L.STUB["neutral"]}', '%d', n::VARCHAR) AS text_neutral,
  CASE WHEN pros IS NULL THEN '{L.STUB["no_pros"]}' ELSE replace('{L.STUB["pros"]}', '%s', pros) END AS text_pros, CASE WHEN cons IS NULL THEN '{L.STUB["no_cons"]}' ELSE replace('{L.STUB["cons"]}', '%s', cons) END AS text_cons,
  '{", ".join(f"{p}:{m}:{n}" for p, m, n, _ in L.STUB_PHRASES)}' AS key_phrases FROM t""")
def stub_texts(spark, d):
    rows, whole = reviews(spark, d), M.summarize("stub_texts", reviews(spark, d), overall=True).select("product_id", "text_overall")
    shown = F.transform("key_phrases", lambda x: F.concat_ws(":", x["phrase"], x["sentiment"], x["count"].cast("string")))
    return M.summarize("stub_texts", rows).join(whole, "product_id").select("product_id", "text_overall", "text_neutral", "text_pros", "text_cons", F.array_join(shown, ", ").alias("key_phrases"))


@query("""SELECT event_id, CASE WHEN event_id % 9 < 3 THEN NULL ELSE user_id % 7 END AS product_id, CASE WHEN event_id % 9 >= 3 THEN event_id % 4 END::INTEGER AS attempt, CASE WHEN event_id % 9 >= 3 THEN epoch_us(ts) END AS at,
  CASE event_id % 9 WHEN 0 THEN 'empty payload' WHEN 1 THEN 'expected JSON object' WHEN 2 THEN 'expected JSON object' END AS problem FROM events""")
def job_messages(spark, d):
    """Jobs to messages and back, as text and as bytes; some messages are missing, broken or no object."""
    jobs = table(spark, d, "events").select(
        "event_id", F.lit("product").alias("job_type"), (F.col("user_id") % 7).alias("product_id"), F.lit(None).cast("long").alias("user_id"),
        F.lit(False).alias("force"), (F.col("event_id") % 4).cast("int").alias("attempt"), F.col("ts").cast("timestamp").alias("enqueued_at"),
    )
    kind = F.col("event_id") % 9
    sent = J.encoded(jobs).withColumn("payload", F.when(kind == 1, "[1, 2]").when(kind == 2, '{"job_type": "pro').when(kind > 2, F.col("payload")))
    both = J.decoded(sent.filter("event_id % 2 = 0")).unionByName(J.decoded(sent.filter("event_id % 2 = 1").withColumn("payload", F.col("payload").cast("binary"))))
    return both.select("event_id", "product_id", "attempt", F.unix_micros("enqueued_at").alias("at"), "problem")
