"""Registered queries over ledgers, summary metrics, judges and what is stored of a summary."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aspects as A
from ..operators import catalogue as C
from ..operators import evaluation as E
from ..operators import folds
from ..operators import summaries as M
from ..sources.adapter import table
from ..sources.stored import kept
from .queries import EVIDENCE_SQL, GROUNDED_SQL, LEDGER_SQL, MENTIONS_SQL, STRIP, _evidence, _found, _grounded, _mentions, _planned, _scored, query

GOOD, BAD, GENERIC = ("the", "con"), ("ment", "stupid"), ("the", "that", "und", "que")
_TUPLE = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def external(spark, d):
    """Summaries under test: each assistant turn, as an overall text, pros or cons by turns.

    Turns are few bytes and much work, so they are dealt out to tasks by number, not by the size of their file.
    """
    turns = table(spark, d, "conversations").filter("role = 'assistant'")
    kind = (F.col("conv_id") + F.col("turn")) % 3
    part = lambda i: F.when(kind == i, F.col("text"))
    rows = turns.select("conv_id", "turn", (F.col("conv_id") % 50).alias("product_id"), part(0).alias("text_overall"), part(1).alias("text_pros"), part(2).alias("text_cons"))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn", "product_id")


EXTERNAL_SQL = f"""external AS (SELECT conv_id, turn, conv_id % 50 AS product_id, (conv_id + turn) % 3 AS kind, coalesce({STRIP.format("text")}, '') AS flat, text FROM conversations WHERE role = 'assistant')"""
CLAIMS = (
    "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: " + STRIP.format("x") + "), lambda x: length(x) > 3)"
)
EVIDENCE_OF = f"""once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, aspect, review_id, {STRIP.format("lower(span_text)")} ORDER BY span_index) AS k FROM mentions) WHERE k = 1),
proof AS (SELECT * FROM (SELECT product_id, aspect AS name, row_number() OVER (PARTITION BY product_id, aspect ORDER BY review_id, span_index) AS rank, review_id, span_text FROM once) WHERE rank <= 5)"""
METRICS_SQL = f"""{LEDGER_SQL}, {EVIDENCE_OF}, {EXTERNAL_SQL},
pairs AS (SELECT e.conv_id, e.turn, l.name, salience, expected, contains(lower(flat), lower(l.name)) AS hit, kind, lower(text) AS low, lower(flat) AS lowflat FROM external e JOIN ledger l USING (product_id)),
got AS (SELECT *, len(list_filter({_TUPLE(GOOD)}, lambda w: contains(low, w))) > 0 AS good, len(list_filter({_TUPLE(BAD)}, lambda w: contains(low, w))) > 0 AS bad FROM pairs),
pol AS (SELECT *, CASE WHEN kind = 1 AND hit THEN 'positive' WHEN kind = 2 AND hit THEN 'negative' WHEN kind = 0 AND hit AND good AND NOT bad THEN 'positive' WHEN kind = 0 AND hit AND bad AND NOT good THEN 'negative' END AS seen FROM got),
bal AS (SELECT conv_id, turn, salience / sum(salience) OVER o AS p, h / sum(h) OVER o AS q FROM (SELECT *, 2 * (length(lowflat) - length(replace(lowflat, lower(name), ''))) / length(name)::DOUBLE + 0.001::DOUBLE AS h FROM pairs) WINDOW o AS (PARTITION BY conv_id, turn)),
js AS (SELECT conv_id, turn, greatest(0.0, 1 - sqrt(greatest(0.0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)))) AS balance FROM bal GROUP BY 1, 2),
per AS (SELECT conv_id, turn, avg(hit::INT) AS coverage, sum(CASE WHEN hit THEN salience ELSE 0 END) / sum(salience) AS weighted,
  avg(CASE WHEN seen = expected THEN 1.0 WHEN seen IN ('positive', 'negative') AND expected IN ('positive', 'negative') THEN 0.0 ELSE 0.5 END) FILTER (hit AND seen IS NOT NULL) AS consistency FROM pol GROUP BY 1, 2),
cl AS (SELECT conv_id, turn, product_id, unnest(c) AS claim, generate_subscripts(c, 1) AS i FROM (SELECT *, {CLAIMS.format("lower(flat)")} AS c FROM external)),
ev AS (SELECT DISTINCT product_id, lower(span_text) AS t FROM proof),
sup AS (SELECT conv_id, turn, i, coalesce(bool_or(len(list_filter(regexp_split_to_array(claim, '\\s+'), lambda w: length(w) > 3 AND contains(t, w))) >= 2), false) AS ok FROM cl LEFT JOIN ev USING (product_id) GROUP BY 1, 2, 3),
sr AS (SELECT conv_id, turn, avg(ok::INT) AS support FROM sup GROUP BY 1, 2),
wd AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(flat), '\\s+'), lambda w: length(w) > 2) AS w FROM external),
sp AS (SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE 0.6::DOUBLE * (len(list_filter(w, lambda x: x NOT IN {GENERIC})) / len(w)::DOUBLE) + 0.4::DOUBLE * coalesce(coverage, 0.5) END AS specificity
  FROM wd LEFT JOIN per USING (conv_id, turn)),
nr AS (SELECT conv_id, turn, CASE WHEN len(c) <= 1 THEN 1.0::DOUBLE ELSE len(list_distinct(c)) / len(c)::DOUBLE END AS distinct_share FROM (SELECT *, {CLAIMS.format("lower(replace(flat, chr(10), ' '))")} AS c FROM external)),
metrics AS (SELECT e.product_id, conv_id, turn, coalesce(coverage, 1.0) AS coverage, coalesce(weighted, 1.0) AS coverage_weighted, coalesce(consistency, 1.0) AS sentiment_consistency, coalesce(support, 1.0) AS evidence_support,
  1 - coalesce(support, 1.0) AS unsupported_rate, specificity, CASE WHEN flat = '' THEN 1.0 ELSE coalesce(balance, 1.0) END AS aspect_balance, distinct_share AS non_redundancy,
  0.30 * coalesce(weighted, 1.0) + 0.20 * coalesce(consistency, 1.0) + 0.25 * coalesce(support, 1.0) + 0.15 * specificity + 0.10 * distinct_share AS overall
  FROM external e LEFT JOIN per USING (conv_id, turn) LEFT JOIN sr USING (conv_id, turn) LEFT JOIN sp USING (conv_id, turn) LEFT JOIN js USING (conv_id, turn) LEFT JOIN nr USING (conv_id, turn))"""


def _rounded(rows):
    return rows.withColumns({c: F.round(c, 6) for c, kind in rows.dtypes if kind == "double"})


def _select(*names: str) -> str:
    return f"{METRICS_SQL} SELECT conv_id, turn, product_id, {', '.join(f'round({n}::DOUBLE, 6) AS {n}' for n in names)} FROM metrics"


def _ledger(spark, d):
    return E.ledger(_mentions(spark, d))


@query(_select("coverage", "coverage_weighted"))
def coverage(spark, d):
    return _rounded(E.coverage(_ledger(spark, d), external(spark, d)))


@query(_select("sentiment_consistency"))
def sentiment_consistency(spark, d):
    return _rounded(E.sentiment_consistency(_ledger(spark, d), external(spark, d), GOOD, BAD))


@query(_select("evidence_support", "unsupported_rate"))
def evidence_support(spark, d):
    return _rounded(E.evidence_support(external(spark, d), E.ledger_evidence(_mentions(spark, d))))


@query(_select("specificity"))
def specificity(spark, d):
    return _rounded(E.specificity(_ledger(spark, d), external(spark, d), GENERIC))


@query(_select("aspect_balance"))
def balance_js(spark, d):
    return _rounded(E.aspect_balance(_ledger(spark, d), external(spark, d)))


@query(_select("non_redundancy"))
def non_redundancy(spark, d):
    return _rounded(E.non_redundancy(external(spark, d)))


def _metrics(spark, d):
    found = _found(spark, d)
    ledgers, texts = kept(E.ledger(found)), external(spark, d)
    return E.all_metrics(ledgers, texts, E.ledger_evidence(found), GOOD, BAD, GENERIC)


@query(_select("coverage", "coverage_weighted", "sentiment_consistency", "evidence_support", "unsupported_rate", "specificity", "aspect_balance", "non_redundancy", "overall"))
def overall_score(spark, d):
    return _rounded(_metrics(spark, d))


_LONG = f"""{METRICS_SQL}, long AS (UNPIVOT (SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS system, product_id, coverage::DOUBLE AS coverage, overall::DOUBLE AS overall,
  specificity::DOUBLE AS specificity FROM metrics) ON coverage, overall, specificity INTO NAME metric VALUE value)"""


def _long(spark, d):
    system = F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")
    rows = _metrics(spark, d).select("product_id", system.alias("system"), "coverage", "overall", "specificity")
    return E.long_form(rows, F.col("system"))  # both systems from one reading


@query(f"{_LONG} SELECT system, metric, round(avg(value), 6) AS mean FROM long GROUP BY 1, 2")
def system_means(spark, d):
    return _rounded(E.system_means(_long(spark, d)))


@query(f"{_LONG} SELECT metric, round(avg(value) FILTER (system = 'even'), 6) AS even, round(avg(value) FILTER (system = 'odd'), 6) AS odd FROM long GROUP BY 1")
def metric_chart(spark, d):
    return _rounded(E.metric_chart(_long(spark, d)))


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN NULL WHEN 1 THEN 1.5 WHEN 2 THEN NULL WHEN 3 THEN 2.0 ELSE -1e3 END::DOUBLE AS value FROM conversations WHERE turn % 5 IN (1, 3, 4)""")
def numeric_metrics(spark, d):
    values = F.array(F.lit(None).cast("string"), F.lit("1.5"), F.lit("true"), F.lit("2"), F.lit("-1e3"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.get(values, (F.col("turn") % 5).cast("int")).alias("value"))
    return E.numeric(rows, "value")


@query(f"""{GROUNDED_SQL}, p AS (SELECT t.product_id, lower(concat_ws(chr(10), text_overall, text_neutral, text_pros, text_cons)) AS low, list(DISTINCT lower(name)) AS names FROM texts t JOIN planned USING (product_id) GROUP BY ALL),
c AS (SELECT *, {CLAIMS.format("low")} AS claims FROM p)
SELECT product_id, len(list_filter(names, lambda n: contains(low, n))) / greatest(len(names), 1)::DOUBLE AS plan_reflected,
  len(list_filter(claims, lambda c: len(list_filter(names, lambda n: contains(c, n))) > 0)) / greatest(len(claims), 1)::DOUBLE AS claims_planned FROM c""")
def glass_box(spark, d):
    found = _found(spark, d)
    return E.glass_box(_planned(spark, d, found), A.summary_text(_grounded(spark, d, found)))


@query(f"""{LEDGER_SQL}, {EVIDENCE_OF}, pr AS (SELECT product_id, name, string_agg(span_text, ' | ' ORDER BY rank) AS proof FROM proof WHERE rank <= 2 GROUP BY 1, 2)
SELECT product_id, name, printf('- %s (expected %s, salience %.3f): %s', name, expected, salience, coalesce(proof, '')) AS line FROM ledger LEFT JOIN pr USING (product_id, name)""")
def judge_lines(spark, d):
    found = _found(spark, d)
    return E.judge_lines(E.ledger(found), E.ledger_evidence(found))


REFERENCE_SQL = f"""{EVIDENCE_OF}, rf AS (SELECT product_id, string_agg(span_text, chr(10) ORDER BY n) AS reference FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY name, rank) AS n FROM proof) WHERE n <= 50 GROUP BY 1)"""


@query(f"{MENTIONS_SQL}, {REFERENCE_SQL} SELECT * FROM rf")
def pseudo_reference(spark, d):
    return E.pseudo_reference(E.ledger_evidence(_mentions(spark, d)))


@query()
def rouge_l(spark, d):
    """Each assistant turn against its product's reference."""
    # a product's reference is cut into words once, not once a turn
    references = kept(E.pseudo_reference(E.ledger_evidence(_mentions(spark, d))).select("product_id", X.tokens(F.col("reference")).alias("b")))
    pairs = E.with_flat(external(spark, d)).join(references, "product_id").select("conv_id", "turn", X.tokens(F.col("flat")).alias("a"), "b")
    return folds.rouge_l(pairs, "a", "b").drop("a", "b")


@query("""WITH v AS (SELECT conv_id, (['A', 'b', 'tie', NULL, '?', ' A '])[conv_id % 6 + 1] AS first, (['B', 'A', NULL, 'TIE'])[conv_id % 4 + 1] AS second FROM (SELECT DISTINCT conv_id FROM conversations)),
s AS (SELECT conv_id, CASE upper(trim(first)) WHEN 'TIE' THEN 'tie' WHEN 'A' THEN 'ours' WHEN 'B' THEN 'external' END AS f, CASE upper(trim(second)) WHEN 'TIE' THEN 'tie' WHEN 'B' THEN 'ours' WHEN 'A' THEN 'external' END AS g FROM v)
SELECT conv_id, f AS first_winner, g AS second_winner, CASE WHEN f IS NULL AND g IS NULL THEN NULL WHEN coalesce((f = 'ours')::INT, 0) + coalesce((g = 'ours')::INT, 0) > coalesce((f = 'external')::INT, 0) + coalesce((g = 'external')::INT, 0) THEN 'ours'
  WHEN coalesce((f = 'ours')::INT, 0) + coalesce((g = 'ours')::INT, 0) < coalesce((f = 'external')::INT, 0) + coalesce((g = 'external')::INT, 0) THEN 'external' ELSE 'tie' END AS winner FROM s""")
def pairwise_winner(spark, d):
    rows = table(spark, d, "conversations").select("conv_id").distinct()
    pick = lambda words, n: F.get(F.array(*[F.lit(w).cast("string") for w in words]), (F.col("conv_id") % n).cast("int"))
    votes = rows.select("conv_id", pick(("A", "b", "tie", None, "?", " A "), 6).alias("first"), pick(("B", "A", None, "TIE"), 4).alias("second"))
    return E.pairwise_winner(votes).drop("first", "second")


@query(f"""{LEDGER_SQL}, w AS (SELECT product_id, name, CASE WHEN product_id % 5 = 0 THEN 0.0::DOUBLE ELSE n::DOUBLE END AS weight FROM ledger)
SELECT product_id, name, round(CASE WHEN sum(weight) OVER o > 0 THEN weight / sum(weight) OVER o ELSE 1.0 / count(*) OVER o END, 9) AS weight FROM w WINDOW o AS (PARTITION BY product_id)""")
def normalized_weights(spark, d):
    rows = _ledger(spark, d).select("product_id", "name", F.when(F.col("product_id") % 5 == 0, 0.0).otherwise(F.col("n").cast("double")).alias("weight"))
    return E.normalized_weights(rows, "weight", "product_id").withColumn("weight", F.round("weight", 9))


@query(f"{LEDGER_SQL}, {EXTERNAL_SQL} SELECT conv_id, turn, product_id, count(name) FILTER (contains(lower(flat), lower(name))) AS named FROM external LEFT JOIN ledger USING (product_id) GROUP BY 1, 2, 3")
def aspects_named(spark, d):
    rows = E.judged(_ledger(spark, d), external(spark, d))
    return rows.select("conv_id", "turn", "product_id", F.size(F.filter("ledger", lambda x: E._inside(F.col("low"), x))).cast("long").alias("named"))


# Vectors of claims: embeddings stand in, twenty to a summary.
@query("""WITH RECURSIVE v AS (SELECT vec_id, vec_id // 20 AS s, vec_id % 20 AS i, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
near AS (SELECT a.s, a.i AS a, b.i AS b FROM v a JOIN v b ON a.s = b.s AND b.i < a.i WHERE list_inner_product(a.e, b.e) / ((sqrt(list_inner_product(a.e, a.e)) + 1e-9) * (sqrt(list_inner_product(b.e, b.e)) + 1e-9)) >= 0.2),
f(s, i, kept) AS (SELECT s, -1, []::BIGINT[] FROM (SELECT DISTINCT s FROM v) UNION ALL
  SELECT f.s, f.i + 1, CASE WHEN EXISTS (SELECT 1 FROM near n WHERE n.s = f.s AND n.a = f.i + 1 AND list_contains(f.kept, n.b)) OR NOT EXISTS (SELECT 1 FROM v WHERE v.s = f.s AND v.i = f.i + 1) THEN f.kept ELSE list_append(f.kept, f.i + 1) END FROM f WHERE f.i < 19)
SELECT f.s AS summary, CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE len(kept) / n::DOUBLE END AS non_redundancy FROM f JOIN (SELECT s, count(*) AS n FROM v GROUP BY 1) c ON c.s = f.s WHERE f.i = 19""")
def claim_clusters(spark, d):
    rows = table(spark, d, "embeddings").filter("embedding is not null").select(F.expr("vec_id div 20").alias("summary"), (F.col("vec_id") % 20).alias("i"), "embedding")
    return E.non_redundancy_by_vectors(rows, ["summary"], "i", "embedding", 0.2)


@query("""WITH v AS (SELECT vec_id, label AS p, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
b AS (SELECT a.vec_id, a.p, max(list_inner_product(a.e, b.e) / ((sqrt(list_inner_product(a.e, a.e)) + 1e-9) * (sqrt(list_inner_product(b.e, b.e)) + 1e-9))) AS best FROM v a LEFT JOIN v b ON a.p = b.p AND b.vec_id % 7 = 0 WHERE a.vec_id % 7 <> 0 GROUP BY 1, 2)
SELECT p AS product_id, round(avg(coalesce(best >= 0.3, false)::INT), 9) AS evidence_support FROM b GROUP BY 1""")
def claim_vectors_supported(spark, d):
    rows = table(spark, d, "embeddings").filter("embedding is not null").withColumn("product_id", F.col("label"))
    found = E.supported_by_vectors(rows.filter("vec_id % 7 <> 0"), rows.filter("vec_id % 7 = 0"), ["product_id"], "embedding", 0.3)
    return found.withColumn("evidence_support", F.round("evidence_support", 9))


# ---- what is stored of a summary

KEY_SENTIMENT_SQL = """CASE WHEN p.target IN ('positive', 'negative') THEN p.target WHEN p.target IS NOT NULL THEN 'neutral' WHEN s.mixed > 0 AND s.mixed >= s.positive AND s.mixed >= s.negative THEN 'neutral'
  WHEN s.positive > s.negative THEN 'positive' WHEN s.negative > s.positive THEN 'negative' ELSE 'neutral' END"""
PHRASES_SQL = f"""{GROUNDED_SQL}, kp AS (SELECT s.product_id, s.name, {KEY_SENTIMENT_SQL} AS sentiment, s.total AS count,
  least(1.0, round(s.prevalence, 3)) AS share, row_number() OVER (PARTITION BY s.product_id ORDER BY s.importance DESC, s.name) AS rank
  FROM scored s LEFT JOIN planned p ON p.product_id = s.product_id AND p.name = s.name)"""


@query(f"{PHRASES_SQL} SELECT product_id, rank, name AS phrase, sentiment, count, share FROM kp WHERE rank <= 25")
def key_phrases(spark, d):
    found = _found(spark, d)
    return A.key_phrases(_scored(spark, d, found), _planned(spark, d, found))


@query(f"""{PHRASES_SQL} SELECT product_id, sentiment AS bucket, count(*) AS n, string_agg(name, ',' ORDER BY count DESC, name) AS phrases FROM kp WHERE rank <= 25 GROUP BY 1, 2""")
def key_phrase_buckets(spark, d):
    found = _found(spark, d)
    rows = A.bucketed(A.key_phrases(_scored(spark, d, found), _planned(spark, d, found)))
    return rows.withColumn("phrases", F.array_join("phrases", ","))


@query(f"""{EVIDENCE_SQL}, e AS (SELECT *, round(1.0::DOUBLE - (rank - 1) / (count(*) OVER (PARTITION BY product_id, name))::DOUBLE, 3) AS score FROM evidence),
l AS (SELECT product_id, name, count(*) AS n, string_agg(span_text || '@' || section || '@' || sentiment || '@' || printf('%.3f', score), '|' ORDER BY rank) AS evidence FROM e GROUP BY 1, 2)
SELECT p.product_id, p.rank, p.name, round(p.importance, 3) AS importance, round(p.prevalence, 3) AS prevalence, p.total, p.positive, p.negative, p.neutral, p.target, p.rare AS must_include, coalesce(l.evidence, '') AS evidence
FROM planned p LEFT JOIN l ON l.product_id = p.product_id AND l.name = p.name""")
def generation_input(spark, d):
    found = _found(spark, d)
    rows = A.generation_input(_planned(spark, d, found), _scored(spark, d, found), _evidence(spark, d, found))
    line = lambda e: F.concat_ws("@", e["text"], e["section"], e["sentiment"], F.format_string("%.3f", e["score"]))
    return rows.select(
        "product_id", "rank", "name", F.round("importance", 3).alias("importance"), F.round("prevalence", 3).alias("prevalence"), "total", "positive", "negative", "neutral", "target",
        "must_include", F.array_join(F.transform("evidence", line), "|").alias("evidence"),
    )


@query(f"""{EVIDENCE_SQL}, e AS (SELECT product_id, name, len(list(span_text)) AS n FROM evidence GROUP BY 1, 2), p AS (SELECT product_id, rank, name, target, n, sum((target = 'positive')::INT) OVER (PARTITION BY product_id) AS pos FROM planned JOIN e USING (product_id, name))
SELECT product_id, count(*) AS aspects, sum(n)::BIGINT AS evidence, string_agg(name, ',' ORDER BY rank) AS names FROM p WHERE target = 'positive' OR pos = 0 GROUP BY 1""")
def prompts_positive(spark, d):
    found = _found(spark, d)
    rows = M.prompt_of(_planned(spark, d, found), _evidence(spark, d, found), only="positive")
    kind = "array<struct<place:int,name:string,target:string,evidence:array<string>>>"
    items = F.from_json("prompt", kind)
    return rows.select(
        "product_id", F.size(items).cast("long").alias("aspects"), F.aggregate(items, F.lit(0), lambda s, x: s + F.size(x["evidence"])).cast("long").alias("evidence"),
        F.array_join(F.transform(items, lambda x: x["name"]), ",").alias("names"),
    )


@query(f"""{GROUNDED_SQL} SELECT product_id, 'P:' || length(coalesce(text_pros, '')) AS positive, 'N:' || length(coalesce(text_cons, '')) AS negative, CASE WHEN product_id % 5 = 0 THEN coalesce(text_neutral, '') ELSE 'G:' || length(coalesce(text_neutral, '')) END AS general,
  product_id % 5 = 0 AS partial FROM texts WHERE product_id % 7 <> 0 UNION ALL SELECT product_id, coalesce(text_pros, ''), coalesce(text_cons, ''), coalesce(text_neutral, ''), true FROM texts WHERE product_id % 7 = 0""")
def generated_sections(spark, d):
    """A stand-in model that counts characters and fails for some products and sections."""

    def model(prompt: str) -> str:
        product, kind, text = prompt.split("\t", 2)
        if int(product) % 7 == 0 or (kind == "G" and int(product) % 5 == 0):
            raise RuntimeError("no answer")
        return f'{{"text": "{kind}:{len(text)}"}}'

    return M.generate(A.summary_text(_grounded(spark, d)), model)


@query(f"""{GROUNDED_SQL} SELECT product_id, CASE WHEN product_id % 3 = 0 THEN true WHEN product_id % 3 = 1 THEN false ELSE true END AS passed, CASE WHEN product_id % 3 = 1 THEN 'shorter' END AS revised, product_id % 3 = 2 AS assumed FROM texts""")
def verified_texts(spark, d):
    def model(prompt: str) -> str:
        product = int(prompt.split("\t", 1)[0])
        if product % 3 == 2:
            raise RuntimeError("no answer")
        return '{"passed": true}' if product % 3 == 0 else '{"passed": false, "revised": "shorter"}'

    return M.verify_texts(A.summary_text(_grounded(spark, d)), model).select("product_id", "passed", "revised", "assumed")


@query(f"""{EVIDENCE_SQL}, cl AS (SELECT product_id, name, product_id || '/' || name AS cluster_id FROM scored WHERE length(name) % 2 = 0)
SELECT product_id, cluster_id, rank, review_id, span_text AS evidence_text, sentiment AS supports FROM evidence JOIN cl USING (product_id, name)""")
def stored_evidence(spark, d):
    found = _found(spark, d)
    clusters = _scored(spark, d, found).filter(F.length("name") % 2 == 0).select("product_id", "name", F.concat_ws("/", F.col("product_id").cast("string"), "name").alias("cluster_id"))
    return A.stored(_evidence(spark, d, found), clusters)


@query(f"""{EVIDENCE_SQL}, cl AS (SELECT product_id || '/' || name AS cluster_id, name FROM scored WHERE length(name) % 2 = 0)
SELECT e.product_id, e.rank, coalesce(cl.name, e.product_id || '/' || e.name) AS cluster_name FROM evidence e LEFT JOIN cl ON cl.cluster_id = e.product_id || '/' || e.name""")
def evidence_names(spark, d):
    found, key = _found(spark, d), F.concat_ws("/", F.col("product_id").cast("string"), "name")
    clusters = _scored(spark, d, found).filter(F.length("name") % 2 == 0).select(key.alias("cluster_id"), F.col("name").alias("cluster_name"))
    rows = _evidence(spark, d, found).select("product_id", "rank", key.alias("cluster_id"))
    return C.named(rows, clusters, "cluster_id", "cluster_name", F.col("cluster_id")).drop("cluster_id")


@query(f"{EVIDENCE_SQL} SELECT product_id, name, rank FROM evidence WHERE name IN ('the', 'then', 'tion') AND sentiment IN ('positive', 'mixed')")
def evidence_filtered(spark, d):
    return C.filter_evidence(_evidence(spark, d), ("the", "then", "tion"), ("positive", "mixed")).select("product_id", "name", "rank")


@query(f"""{EVIDENCE_SQL} SELECT product_id, name FROM planned WHERE length(name) % 3 = 0""")
def planned_without_evidence(spark, d):
    found = _found(spark, d)
    proof = _evidence(spark, d, found).filter(F.length("name") % 3 > 0)
    return _planned(spark, d, found).join(proof.select("product_id", "name").distinct(), ["product_id", "name"], "left_anti").select("product_id", "name")


@query(f"""{MENTIONS_SQL}, cl AS (SELECT *, left(aspect, 3) AS name FROM mentions), c AS (SELECT product_id, name, count(*) AS total, count(DISTINCT aspect) AS aliases, string_agg(DISTINCT aspect, ',' ORDER BY aspect) AS alias_list FROM cl GROUP BY 1, 2)
SELECT * FROM c""")
def clustered_mentions(spark, d):
    found = _found(spark, d).drop("name")
    labels = found.select("product_id", F.col("aspect").alias("label"), F.left("aspect", F.lit(3)).alias("name")).distinct()
    rows = A.canonical(found, labels).groupBy("product_id", "name")
    return rows.agg(F.count("*").alias("total"), F.countDistinct("aspect").alias("aliases"), F.array_join(F.array_sort(F.collect_set("aspect")), ",").alias("alias_list"))


@query(f"{LEDGER_SQL} SELECT product_id, any_value(m.n) AS mentions, any_value(m.c) AS candidates, any_value(m.r) AS reviews, count(*) AS clusters, count(*) FILTER (s.rare) AS rare_clusters FROM scored s JOIN (SELECT product_id, count(*) AS n, count(DISTINCT aspect) AS c, count(DISTINCT review_id) AS r FROM mentions GROUP BY 1) m USING (product_id) GROUP BY 1")
def dashboard_counts(spark, d):
    found = _found(spark, d)
    return C.dashboard_counts(found, _scored(spark, d, found))


@query(f"""{MENTIONS_SQL}, h AS (SELECT product_id, aspect, section, count(*) AS n FROM mentions GROUP BY ALL) SELECT product_id, aspect AS name, string_agg(section || ':' || n, ',' ORDER BY section) AS sections FROM h GROUP BY 1, 2""")
def section_histogram(spark, d):
    rows = A.section_histogram(_mentions(spark, d))
    pairs = F.array_sort(F.transform(F.map_entries("sections"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return rows.select("product_id", "name", F.array_join(pairs, ",").alias("sections"))


@query(f"{PHRASES_SQL} SELECT product_id, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY count DESC, name) AS k FROM kp) WHERE k <= 15")
def largest_clusters(spark, d):
    order = Window.partitionBy("product_id").orderBy(F.desc("total"), "name")
    by_score = Window.partitionBy("product_id").orderBy(F.desc("importance"), "name")
    rows = _scored(spark, d).withColumn("rank", F.row_number().over(by_score)).withColumn("k", F.row_number().over(order))
    return rows.filter("k <= 15").select("product_id", "name", "rank")
