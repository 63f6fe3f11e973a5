"""Queries over vectors and models: topics, keyphrases of three sources, embedding metrics, the evaluation run, tables that persist."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.vectors import embedded, hashed_trigrams
from ..operators import evaluation as E
from ..operators import keywords as K
from ..operators import ngrams as N
from ..operators import runs as R
from ..operators import topics as T
from ..sources.adapter import reviews, table
from ..sources.stored import kept, new_folder
from ..sources.versions import Versions
from .judging import BAD, EXTERNAL_SQL, GENERIC, GOOD, METRICS_SQL, REFERENCE_SQL, external
from .profiles import KEYPHRASES_SQL, SEGMENTS_SQL, _filtered, segments
from .queries import MENTIONS_SQL, STOP, STRIP, WITH_REVIEWS, _mentions, query

MODEL = hashed_trigrams()
WORDS = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"


def vectors_sql(name: str, source: str) -> str:
    """The stand-in's vectors of the texts ``t`` of a source, as (t, v)."""
    return f"""{name}_g AS (SELECT t, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g
  FROM (SELECT t, '^' || unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+')) || '$' AS p FROM (SELECT DISTINCT t FROM ({source}) WHERE t IS NOT NULL))),
{name}_s AS (SELECT t, CAST(('0x' || md5(g)[1:4]) AS BIGINT) % 64 AS k, sum(CASE WHEN md5(g)[5] < '8' THEN 1 ELSE -1 END) AS n FROM {name}_g GROUP BY 1, 2),
{name} AS (SELECT t, list_transform(range(64), lambda i: coalesce(m[i], 0)::DOUBLE) AS v FROM (SELECT t, map_from_entries(list((k, n))) AS m FROM {name}_s GROUP BY 1))"""


_DOT = "list_inner_product({0}, {1})"
_COS = lambda a, b: f"coalesce({_DOT.format(a, b)} / ((sqrt({_DOT.format(a, a)}) + 1e-9) * (sqrt({_DOT.format(b, b)}) + 1e-9)), 0.0::DOUBLE)"

RAW_SQL = f"""{SEGMENTS_SQL}, num AS (SELECT product_id, span_text, row_number() OVER (PARTITION BY product_id ORDER BY review_id, span_index) - 1 AS sentence FROM words),
raw AS (SELECT product_id, sentence, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS place FROM (SELECT *, regexp_extract_all(span_text, '{WORDS}') AS r FROM num)),
term AS (SELECT *, lower(raw) AS word, length(lower(raw)) < 3 OR lower(raw) IN {STOP} AS stop, regexp_matches(raw, '[0-9]') AS odd,
  (length(raw) > 1 AND upper(raw) = raw AND lower(raw) <> raw) AS shout FROM raw),
near AS (SELECT *, lag(word) OVER p AS before, lead(word) OVER p AS after, (place > 0 AND NOT shout AND upper(left(raw, 1)) = left(raw, 1) AND lower(left(raw, 1)) <> left(raw, 1)) AS name
  FROM term WINDOW p AS (PARTITION BY product_id, sentence ORDER BY place)),
per AS (SELECT product_id, word, count(*) AS tf, any_value(stop) AS stop, greatest(sum(shout::INT), sum(name::INT)) AS cased,
  count(DISTINCT before) / greatest(count(before), 1)::DOUBLE AS lft, count(DISTINCT after) / greatest(count(after), 1)::DOUBLE AS rgt FROM near GROUP BY 1, 2),
spread AS (SELECT product_id, word, median(sentence)::DOUBLE AS middle, count(*) AS sentences FROM (SELECT DISTINCT product_id, word, sentence FROM near) GROUP BY 1, 2),
alls AS (SELECT product_id, max(sentence) + 1 AS all_sentences FROM near GROUP BY 1),
feat AS (SELECT *, max(tf) OVER o AS top, avg(tf) FILTER (NOT stop) OVER o AS mean, stddev_pop(tf) FILTER (NOT stop) OVER o AS dev FROM per JOIN spread USING (product_id, word) JOIN alls USING (product_id) WINDOW o AS (PARTITION BY product_id)),
parts AS (SELECT *, cased / (1 + ln(tf)) AS c, ln(ln(3 + middle)) AS p, tf / (mean + dev) AS f, (0.5 + lft * tf / top) + (0.5 + rgt * tf / top) AS v, sentences / all_sentences::DOUBLE AS w FROM feat),
terms AS (SELECT product_id, word, tf, stop, p * v / (c + f / v + w / v) AS score FROM parts)"""
STATISTICAL_SQL = f"""{RAW_SQL}, runs AS (SELECT product_id, list_transform(range(k), lambda i: w[i + 1]) AS run FROM (
    SELECT product_id, k, [struct_pack(word := word, stop := stop, odd := odd), lead(struct_pack(word := word, stop := stop, odd := odd), 1) OVER p, lead(struct_pack(word := word, stop := stop, odd := odd), 2) OVER p] AS w
    FROM near, (VALUES (1), (2), (3)) ks(k) WINDOW p AS (PARTITION BY product_id, sentence, k ORDER BY place)) WHERE w[k] IS NOT NULL),
cand AS (SELECT product_id, list_transform(run, lambda x: x.word) AS ws, count(*) AS n FROM runs
  WHERE NOT run[1].stop AND NOT run[-1].stop AND len(list_filter(run, lambda x: x.odd)) = 0 GROUP BY 1, 2),
lk AS (SELECT product_id, word AS a, after AS b, count(*) AS both_n FROM near WHERE after IS NOT NULL GROUP BY 1, 2, 3),
cw AS (SELECT product_id, ws, n, ws[i] AS word, CASE WHEN i > 1 THEN ws[i - 1] END AS prev, ws[i + 1] AS next FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM cand)),
vals AS (SELECT cw.product_id, ws, n, CASE WHEN t.stop THEN 1 + (1 - i.both_n / q.tf::DOUBLE * (x.both_n / t.tf::DOUBLE)) ELSE t.score END AS times, CASE WHEN t.stop THEN -(1 - i.both_n / q.tf::DOUBLE * (x.both_n / t.tf::DOUBLE)) ELSE t.score END AS plus
  FROM cw JOIN terms t ON t.product_id = cw.product_id AND t.word = cw.word LEFT JOIN lk i ON i.product_id = cw.product_id AND i.a = cw.prev AND i.b = cw.word
  LEFT JOIN lk x ON x.product_id = cw.product_id AND x.a = cw.word AND x.b = cw.next LEFT JOIN terms q ON q.product_id = cw.product_id AND q.word = cw.prev),
tot AS (SELECT product_id, ws, n, product(times) AS times, sum(plus) AS plus FROM vals GROUP BY 1, 2, 3),
stat AS (SELECT product_id, phrase, n, raw_score, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - raw_score)) AS score
  FROM (SELECT product_id, array_to_string(ws, ' ') AS phrase, n, times / (n * (CASE WHEN plus = -1 THEN 1e-6 ELSE 1 + plus END)) AS raw_score FROM tot) WHERE {_filtered("phrase")}),
best_stat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY round(raw_score, 9), phrase) AS r FROM stat) WHERE r <= 80)"""
NEAR_SQL = f"""first_of AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY review_id, span_index) AS k FROM words) WHERE k <= 200),
np AS (SELECT DISTINCT product_id, review_id, span_index, span_text, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS phrase FROM first_of, (VALUES (1), (2), (3)) ns(n) WHERE len(w) >= n),
{vectors_sql("nv", "SELECT phrase AS t FROM np UNION SELECT span_text FROM first_of")},
nc AS (SELECT product_id, review_id, span_index, phrase, {_COS("a.v", "b.v")} AS score FROM np LEFT JOIN nv a ON a.t = phrase LEFT JOIN nv b ON b.t = span_text),
nearest AS (SELECT product_id, review_id, span_index, phrase, score FROM (SELECT *, row_number() OVER (PARTITION BY product_id, review_id, span_index ORDER BY round(score, 9) DESC, phrase) AS r FROM nc) WHERE r <= 3 AND {_filtered("phrase")})"""

WHOLE_NEAR_SQL = NEAR_SQL.replace(") WHERE k <= 200)", "))")


@query(f"{RAW_SQL} SELECT product_id, word, tf, stop, round(score, 9) AS score FROM terms")
def term_scores(spark, d):
    return K.term_scores(segments(spark, d), STOP).withColumn("score", F.round("score", 9))


@query(f"{STATISTICAL_SQL} SELECT product_id, phrase, n, round(raw_score, 9) AS raw_score, round(score, 9) AS score FROM stat")
def statistical_keyphrases(spark, d):
    found = K.statistical_keyphrases(segments(spark, d), STOP)
    return found.withColumns({c: F.round(c, 9) for c in ("raw_score", "score")})


@query()
def best_keyphrases(spark, d):
    """The statistical source whole: near-equal phrases go by a greedy fold, which SQL can't say."""
    return K.best_keyphrases(K.statistical_keyphrases(segments(spark, d), STOP))


@query(f"{SEGMENTS_SQL}, {NEAR_SQL} SELECT product_id, review_id, span_index, phrase, round(score, 9) AS score FROM nearest")
def near_keyphrases(spark, d):
    found = K.near_keyphrases(segments(spark, d), MODEL)
    return found.select("product_id", "seq.review_id", "seq.span_index", "phrase", F.round("score", 9).alias("score"))


@query(f"""{KEYPHRASES_SQL}, {STATISTICAL_SQL[len(SEGMENTS_SQL) + 2 :]}, {WHOLE_NEAR_SQL},
u AS (SELECT product_id, phrase, score, 0 AS o FROM best_stat UNION ALL SELECT product_id, phrase, score, 1 FROM keyphrases UNION ALL SELECT product_id, phrase, score, 2 FROM nearest)
SELECT product_id, phrase, round(score, 9) AS score, o AS source_ord FROM (SELECT *, row_number() OVER (PARTITION BY product_id, phrase ORDER BY o, score DESC) AS n FROM u) WHERE n = 1""")
def keyphrase_union(spark, d):
    """Statistical, counted and nearest keyphrases of all segments of a product; the first source of a text wins."""
    segs = kept(segments(spark, d))
    ranked = K.statistical_keyphrases(segs, STOP)
    best = F.row_number().over(K.Window.partitionBy("product_id").orderBy(F.round("raw_score", 9), "phrase"))
    first = ranked.withColumn("_r", best).filter("_r <= 80")
    names = ("product_id", "phrase", "score")
    # vectors are much work for few bytes: segments are dealt out by number, not by the size of their files
    dealt = segs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "product_id", "seq")
    near = K.near_keyphrases(dealt, MODEL, segments=None).groupBy("product_id", "phrase").agg(F.max("score").alias("score"))
    union = N.keyphrase_union([first.select(*names), N.keyphrases(segs, stop=STOP).select(*names), near])
    return union.select("product_id", "phrase", F.round("score", 9).alias("score"), "source_ord")


def _phrase_vectors(spark, d):
    keys = kept(N.keyphrases(segments(spark, d), stop=STOP).select("product_id", "phrase", "rank", "weak"))
    return embedded(keys, "phrase", MODEL)


@query()
def topics(spark, d):
    """Topics of each product's best keyphrases, by density of the stand-in's vectors."""
    return T.topics(_phrase_vectors(spark, d))


@query()
def topic_words(spark, d):
    return T.class_words(T.density_clusters(_phrase_vectors(spark, d).filter("rank <= 300"), "product_id", "phrase", "vector"), "product_id", "phrase")


@query()
def density_topics(spark, d):
    """Density clusters of all vectors, by blocks of 300 ids (a profile's size)."""
    rows = table(spark, d, "embeddings").filter("vec_id is not null").select(F.floor(F.col("vec_id") / 300).alias("block"), "vec_id", "embedding")
    return T.density_clusters(rows, "block", "vec_id", "embedding")


def _pairs(spark, d):
    found = _mentions(spark, d)
    return E.with_flat(external(spark, d)).select("conv_id", "turn", "product_id", "flat").join(E.pseudo_reference(E.ledger_evidence(found)), "product_id")


@query(f"""{METRICS_SQL}, {REFERENCE_SQL[REFERENCE_SQL.index("rf AS") :]},
{vectors_sql("rv", "SELECT flat AS t FROM external UNION SELECT reference FROM rf")}
SELECT conv_id, turn, product_id, CASE WHEN trim(flat) <> '' AND trim(reference) <> '' THEN round({_COS("a.v", "b.v")}, 9) END AS embedding_cosine_reference
FROM external JOIN rf USING (product_id) LEFT JOIN rv a ON a.t = flat LEFT JOIN rv b ON b.t = reference""")
def reference_cosine(spark, d):
    found = E.reference_cosine(_pairs(spark, d), MODEL)
    return found.select("conv_id", "turn", "product_id", F.round("embedding_cosine_reference", 9).alias("embedding_cosine_reference"))


_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


@query(f"""{METRICS_SQL}, {REFERENCE_SQL[REFERENCE_SQL.index("rf AS") :]},
ct AS (SELECT conv_id, turn, product_id, tok, count(*) AS n FROM (SELECT conv_id, turn, product_id, unnest({_TOKENS.format("flat")}) AS tok FROM external) GROUP BY ALL),
rt AS (SELECT product_id, tok, count(*) AS n FROM (SELECT product_id, unnest({_TOKENS.format("reference")}) AS tok FROM rf) GROUP BY ALL),
{vectors_sql("tv", "SELECT tok AS t FROM ct UNION SELECT tok FROM rt")},
pr AS (SELECT c.product_id, c.tok AS a, r.tok AS b, {_COS("x.v", "y.v")} AS s FROM (SELECT DISTINCT product_id, tok FROM ct) c JOIN rt r USING (product_id) JOIN tv x ON x.t = c.tok JOIN tv y ON y.t = r.tok),
pa AS (SELECT product_id, a, max(s) AS s FROM pr GROUP BY 1, 2),
p AS (SELECT conv_id, turn, sum(n * s) / sum(n) AS p FROM ct JOIN pa ON pa.product_id = ct.product_id AND a = tok GROUP BY 1, 2),
rb AS (SELECT conv_id, turn, ct.product_id, b, max(s) AS s FROM ct JOIN pr ON pr.product_id = ct.product_id AND a = tok GROUP BY 1, 2, 3, 4),
r AS (SELECT conv_id, turn, sum(n * s) / sum(n) AS r FROM rb JOIN rt ON rt.product_id = rb.product_id AND tok = b GROUP BY 1, 2)
SELECT conv_id, turn, product_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p IS NOT NULL THEN 0 END, 6) AS f1
FROM external JOIN rf USING (product_id) LEFT JOIN p USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn)""")
def token_alignment(spark, d):
    found = E.token_alignment(_pairs(spark, d), MODEL)
    return found.select("conv_id", "turn", "product_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""{METRICS_SQL}, {vectors_sql("sv", "SELECT flat AS t FROM external UNION SELECT name FROM ledger")},
nm AS (SELECT e.conv_id, e.turn, e.product_id, l.name, l.salience, contains(lower(flat), lower(l.name)) AS named, flat, {_COS("a.v", "b.v")} AS near FROM external e JOIN ledger l USING (product_id) LEFT JOIN sv a ON a.t = l.name LEFT JOIN sv b ON b.t = flat),
cv AS (SELECT *, named OR (flat <> '' AND near >= 0.3) AS covered, CASE WHEN NOT named AND flat <> '' THEN near END AS asked FROM nm),
sc AS (SELECT conv_id, turn, avg(covered::INT) AS c, sum(CASE WHEN covered THEN salience ELSE 0 END) / sum(salience) AS w, avg(asked) AS nearest FROM cv GROUP BY 1, 2)
SELECT conv_id, turn, product_id, round(coalesce(c, 1.0), 6) AS coverage, round(coalesce(w, 1.0), 6) AS coverage_weighted, round(nearest, 6) AS nearest FROM external LEFT JOIN sc USING (conv_id, turn)""")
def semantic_coverage(spark, d):
    """At 0.3, where the stand-in's cosines lie; a trained model's threshold is 0.72."""
    found = E.semantic_coverage(E.ledger(_mentions(spark, d)), external(spark, d), MODEL, 0.3)
    return found.select("conv_id", "turn", "product_id", *[F.round(c, 6).alias(c) for c in ("coverage", "coverage_weighted", "nearest")])


# A run over all products: ours lists the ledger's names, fails for every tenth product; theirs is a product's first assistant turn.
RUN_SQL = METRICS_SQL.replace(
    EXTERNAL_SQL,
    f"""external AS (SELECT product_id AS conv_id, sys AS turn, product_id, 0 AS kind, coalesce({STRIP.format("text")}, '') AS flat, text FROM (
  SELECT product_id, 0 AS sys, string_agg(name, '. ' ORDER BY name) AS text FROM ledger WHERE product_id % 10 <> 7 GROUP BY 1
  UNION ALL SELECT conv_id % 50, 1, min_by(text, [conv_id, turn]) FROM conversations WHERE role = 'assistant' GROUP BY 1) WHERE product_id IN (SELECT product_id FROM reviews))""",
) + """, ids AS (SELECT DISTINCT product_id FROM reviews),
failed AS (SELECT product_id, CASE WHEN product_id % 10 = 7 THEN 'RuntimeError: cannot summarize' ELSE 'no summary' END AS error FROM ids WHERE product_id NOT IN (SELECT product_id FROM external WHERE turn = 0)),
judged AS (SELECT product_id, CASE WHEN turn = 0 THEN 'ours' ELSE 'external' END AS system, length(flat) AS n FROM external),
rubric AS (SELECT product_id, system, n % 7 > 1 AS ok, n, CASE n % 7 WHEN 0 THEN 'ValueError: no answer' WHEN 1 THEN 'no scores in the answer' END AS error FROM judged)"""
NAMES = ("coverage", "coverage_weighted", "sentiment_consistency", "evidence_support", "unsupported_rate", "specificity", "aspect_balance", "non_redundancy", "overall")
LONG_SQL = " UNION ALL ".join(f"SELECT product_id, CASE WHEN turn = 0 THEN 'ours' ELSE 'external' END AS system, '{n}' AS metric, round({n}::DOUBLE, 6) AS value, NULL AS error FROM metrics" for n in NAMES)


def _summarizer(text: str) -> str:
    if text.startswith("7|"):
        raise RuntimeError("cannot summarize")
    return text.split("|", 1)[1]


def _judge(prompt: str) -> str:
    """A judge by rule: what it says follows from the lengths of the texts."""
    if "\nB:\n" in prompt:
        a, b = prompt.rsplit("\nA:\n", 1)[1].rsplit("\nB:\n", 1)
        return json.dumps({"winner": "tie" if len(a) == len(b) else "A" if len(a) > len(b) else "B"})
    n = len(prompt.rsplit("\nCandidate:\n", 1)[1])
    if n % 7 == 0:
        raise ValueError("no answer")
    if n % 7 == 1:
        return "nothing to say"
    return "```json\n" + json.dumps({"faithfulness_score": n % 13, "coverage_score": n % 5 - 1, "overall_preference": n % 11 / 2, "rationale": f"{n}", "missing_aspects": []}) + "\n```"


def _run(spark, d):
    found = kept(_mentions(spark, d))
    of = lambda ids: found.join(ids.select("product_id"), "product_id", "left_semi")

    def ours(ids):
        named = E.ledger(of(ids)).groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ". ").alias("names"))
        rows = named.withColumn("prompt", F.concat_ws("|", (F.col("product_id") % 10).cast("string"), "names"))
        none = F.lit(None).cast("string")
        rows = R.asked(rows, "prompt", _summarizer)
        return rows.select("product_id", F.col("answer").alias("text_overall"), none.alias("text_pros"), none.alias("text_cons"), none.alias("text_neutral"), "error")

    turns = table(spark, d, "conversations").filter("role = 'assistant'").withColumn("product_id", F.col("conv_id") % 50)
    none = F.lit(None).cast("string")
    theirs = turns.groupBy("product_id").agg(F.min_by("text", F.struct("conv_id", "turn")).alias("text_overall"))
    theirs = theirs.withColumns({c: none for c in ("text_pros", "text_cons", "text_neutral")})
    return R.evaluation_run(spark, new_folder(spark), reviews(spark, d).select("product_id").distinct(), of, ours, theirs, _judge, good=GOOD, bad=BAD, generic=GENERIC)


@query(f"{RUN_SQL}, long AS ({LONG_SQL}) SELECT * FROM long UNION ALL SELECT product_id, 'ours', NULL, NULL, error FROM failed")
def evaluation_run(spark, d):
    return _run(spark, d)["results"].select("product_id", "system", "metric", F.round("value", 6).alias("value"), "error")


@query(f"""{RUN_SQL} SELECT product_id, system, error, CASE WHEN ok THEN n % 13::DOUBLE END AS faithfulness_score, CASE WHEN ok THEN greatest(n % 5 - 1, 0)::DOUBLE END AS coverage_score,
  CASE WHEN ok THEN n % 11 / 2::DOUBLE END AS overall_preference, CASE WHEN ok THEN n::VARCHAR END AS rationale FROM (SELECT * REPLACE (least(n % 13, 10) AS n13) FROM (SELECT *, n % 13 AS n13 FROM rubric))""".replace("n % 13::DOUBLE", "n13::DOUBLE"))
def rubric_scores(spark, d):
    found = _run(spark, d)["rubric"]
    return found.select("product_id", "system", "error", "faithfulness_score", "coverage_score", "overall_preference", "rationale")


@query(f"""{RUN_SQL}, sides AS (SELECT product_id, max(n) FILTER (system = 'ours') AS a, max(n) FILTER (system = 'external') AS b FROM judged GROUP BY 1),
won AS (SELECT product_id, CASE WHEN a = b THEN 'tie' WHEN a > b THEN 'ours' ELSE 'external' END AS winner FROM sides WHERE a IS NOT NULL AND b > 0),
each_of AS (SELECT product_id, count(*) AS n FROM external GROUP BY 1)
SELECT product_id, (coalesce(each_of.n, 0) + (failed.error IS NOT NULL)::INT)::BIGINT AS systems, ({len(NAMES)} * coalesce(each_of.n, 0))::BIGINT AS metrics, failed.error, r.n % 11 / 2::DOUBLE AS preference, winner
FROM ids LEFT JOIN each_of USING (product_id) LEFT JOIN failed USING (product_id) LEFT JOIN (SELECT * FROM rubric WHERE system = 'ours' AND ok) r USING (product_id) LEFT JOIN won USING (product_id)""")
def run_tree(spark, d):
    """The tree of a run, its levels counted."""
    ours = F.get(F.filter("systems", lambda x: x["system"] == "ours"), 0)
    return _run(spark, d)["tree"].select(
        "product_id", F.size("systems").cast("long").alias("systems"), F.aggregate("systems", F.lit(0), lambda s, x: s + F.size(x["metrics"])).cast("long").alias("metrics"),
        ours["error"].alias("error"), ours["preference"].alias("preference"), "winner",
    )


REVIEW = "review_id long, product_id long, rating double, source string"


@query(f"""{WITH_REVIEWS} SELECT review_id, product_id, CASE WHEN review_id % 3 = 0 THEN 0.5 ELSE rating END::DOUBLE AS rating, CASE WHEN review_id % 5 = 0 THEN 'moved' ELSE source END AS source FROM reviews WHERE review_id % 7 <> 0
UNION ALL SELECT -1 - product_id, product_id, NULL, 'new' FROM (SELECT DISTINCT product_id FROM reviews)""")
def versioned_reviews(spark, d):
    """All reviews stored, then rated anew, moved, deleted and added to by keyed writes, each a version; read back from the files."""
    rows = reviews(spark, d).select("review_id", "product_id", "rating", "source")
    stored = Versions(spark, new_folder(spark), "review_id", REVIEW)
    stored.insert(rows)
    fresh = rows.select("product_id").distinct().select((-1 - F.col("product_id")).alias("review_id"), "product_id", F.lit(None).cast("double").alias("rating"), F.lit("new").alias("source"))
    stored.upsert(rows.filter("review_id % 3 = 0").withColumn("rating", F.lit(0.5)).unionByName(fresh))
    stored.update(rows.filter("review_id % 5 = 0").select("review_id", F.lit("moved").alias("source")), ["source"])
    stored.delete(rows.filter("review_id % 7 = 0"))
    return stored.read()


@query(f"{MENTIONS_SQL} SELECT product_id, review_id, span_index, aspect, sentiment FROM mentions")
def stored_mentions(spark, d):
    """Mentions as an artifact: appended to their table in two batches, one of them tried twice, and read back."""
    names = ("product_id", "review_id", "span_index", "aspect", "sentiment")
    rows = kept(_mentions(spark, d).select(*names))
    kinds = dict(rows.dtypes)
    stored = Versions(spark, new_folder(spark), "product_id", ", ".join(f"{n} {kinds[n]}" for n in names))
    for n, part in enumerate((rows.filter("product_id % 2 = 0"), rows.filter("product_id % 2 = 1"), rows.filter("product_id % 2 = 1"))):
        stored.append(part, batch=("mentions", min(n, 1)))
    return stored.read()
