"""Registered queries over keyed reads and writes, benchmark catalogues, caches and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import evaluation as E
from ..operators import summaries as M
from ..sources import benchmark as B
from ..sources.adapter import reviews, table
from ..sources.stored import kept, new_folder
from ..sources.versions import Versions
from ..streaming import jobs as J
from .judging import EXTERNAL_SQL, external
from .queries import HASH_SQL, LEDGER_SQL, STATS_SQL, WITH_REVIEWS, _evidence, _mentions, _scored, query
from .queries import EVIDENCE_SQL


def products(spark, d):
    part = table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("platform"), F.col("p_name").alias("title"), F.col("p_type").alias("set_name"))


PRODUCTS_SQL = "products AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS platform, p_name AS title, p_type AS set_name FROM part)"


@query(f"{WITH_REVIEWS} SELECT review_id, product_id, rating FROM reviews WHERE review_id = 7")
def row_by_id(spark, d):
    return C.get(reviews(spark, d), "review_id", 7).select("review_id", "product_id", "rating")


@query(f"{WITH_REVIEWS} SELECT review_id, product_id, rating FROM reviews WHERE review_id IN (8, -1)")
def optional_rows(spark, d):
    rows = reviews(spark, d)
    return C.get_optional(rows, "review_id", 8).unionByName(C.get_optional(rows, "review_id", -1)).select("review_id", "product_id", "rating")


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_name = 'NATION_7'")
def row_by_name(spark, d):
    found = C.get_by_name(table(spark, d, "nation"), "n_name", "NATION_7")
    return spark.createDataFrame([(found.n_nationkey, found.n_regionkey)] if found else [], "n_nationkey long, n_regionkey long")


@query(f"{WITH_REVIEWS} SELECT review_id FROM reviews ORDER BY created_at DESC, review_id LIMIT 30 OFFSET 15")
def newest_page(spark, d):
    return C.newest(reviews(spark, d), 30, 15, key="review_id").select("review_id")


@query(f"{WITH_REVIEWS} SELECT review_id, rating FROM reviews WHERE rating <= 4")
def bounds_relaxed(spark, d):
    return C.filter_reviews(reviews(spark, d), **C.interface_bounds(0, 4)).select("review_id", "rating")


@query(f"""{WITH_REVIEWS}, {PRODUCTS_SQL}, c AS (SELECT p.product_id, p.name, count(r.review_id) AS reviews_count FROM products p LEFT JOIN reviews r USING (product_id) GROUP BY 1, 2)
SELECT * FROM (SELECT * FROM c ORDER BY product_id LIMIT 60 OFFSET 5) WHERE reviews_count >= 3 AND contains(lower(name), 'a')""")
def product_page(spark, d):
    rows = C.products_with_counts(products(spark, d).select("product_id", "name"), reviews(spark, d))
    return C.product_page(rows, 60, 5, 3, "A", "reviews_desc")


@query(f"{WITH_REVIEWS} SELECT review_id FROM (SELECT review_id, row_number() OVER (ORDER BY review_id) AS n, count(*) OVER () AS m FROM reviews) WHERE n > (m - 1) // 30 * 30")
def last_page(spark, d):
    return C.page_of(reviews(spark, d), ["review_id"], 10_000_000, 30).select("review_id")


@query(f"""{WITH_REVIEWS}, {PRODUCTS_SQL} SELECT (SELECT count(*) FROM reviews) AS reviews, (SELECT count(*) FROM products) AS products, (SELECT count(DISTINCT user_id) FROM reviews) AS users""")
def scalar_counts(spark, d):
    rows = reviews(spark, d)
    return C.counts(reviews=rows, products=products(spark, d), users=rows.filter("user_id is not null").select("user_id").distinct())


@query(f"""{STATS_SQL}, s AS (SELECT product_id AS summary_id, name, importance FROM scored) SELECT name, importance FROM s WHERE summary_id = 3 ORDER BY importance DESC, name LIMIT 40""")
def artifact_clusters(spark, d):
    rows = _scored(spark, d).withColumnRenamed("product_id", "summary_id")
    return C.artifacts(rows, 3, "clusters", 40).select("name", "importance")


@query(f"""{EVIDENCE_SQL} SELECT name, rank, review_id FROM (SELECT *, product_id || '/' || name || '/' || rank AS id FROM evidence WHERE product_id = 3) ORDER BY rank, review_id, id LIMIT 10""")
def artifact_evidence(spark, d):
    key = F.concat_ws("/", F.col("product_id").cast("string"), "name", F.col("rank").cast("string"))
    rows = _evidence(spark, d).select(F.col("product_id").alias("summary_id"), "name", "rank", "review_id", F.col("review_id").alias("created_at"), key.alias("id"))
    return C.artifacts(rows, 3, "evidence", 10).select("name", "rank", "review_id")


@query(f"""{STATS_SQL} SELECT review_id, span_index, aspect FROM mentions WHERE product_id = 3 ORDER BY review_id, review_id || '/' || (1000 + span_index) || '/' || aspect LIMIT 25""")
def artifact_mentions(spark, d):
    key = F.concat_ws("/", F.col("review_id").cast("string"), (1000 + F.col("span_index")).cast("string"), "aspect")
    rows = _mentions(spark, d).select(F.col("product_id").alias("summary_id"), "review_id", "span_index", "aspect", F.col("review_id").alias("created_at"), key.alias("id"))
    return C.artifacts(rows, 3, "mentions", 25).select("review_id", "span_index", "aspect")


DEEP_SQL = f"""{WITH_REVIEWS}, {PRODUCTS_SQL}, {EXTERNAL_SQL}, r AS (SELECT product_id, count(*) AS reviews, string_agg(review_id, ',' ORDER BY review_id) AS review_ids FROM reviews GROUP BY 1),
e AS (SELECT product_id, count(*) AS externals, string_agg(conv_id || ':' || turn, ',' ORDER BY conv_id, turn) AS external_ids FROM external GROUP BY 1)"""


@query(f"""{DEEP_SQL} SELECT product_id, platform, title, coalesce(reviews, 0) AS reviews, coalesce(review_ids, '') AS review_ids, coalesce(externals, 0) AS externals, coalesce(external_ids, '') AS external_ids
FROM products LEFT JOIN r USING (product_id) LEFT JOIN e USING (product_id) WHERE set_name = (SELECT min(p_type) FROM part)""")
def products_deep(spark, d):
    rows = products(spark, d)
    first = rows.agg(F.min("set_name")).first()[0]
    children = {
        "reviews": (reviews(spark, d).select("product_id", "review_id", "comment"), ["review_id"]),
        "external": (external(spark, d), ["conv_id", "turn"]),
    }
    deep = C.products_deep(rows, children, by_set=first)
    ids = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return deep.select(
        "product_id", "platform", "title", F.when(F.col("reviews").isNull(), 0).otherwise(size("reviews")).cast("long").alias("reviews"), ids("reviews", lambda x: x["review_id"].cast("string")).alias("review_ids"),
        F.when(F.col("external").isNull(), 0).otherwise(size("external")).cast("long").alias("externals"), ids("external", lambda x: F.concat_ws(":", x["conv_id"].cast("string"), x["turn"].cast("string"))).alias("external_ids"),
    )


@query(f"WITH {PRODUCTS_SQL} SELECT product_id, platform, title FROM products WHERE set_name = (SELECT max(p_type) FROM part)")
def products_of_set(spark, d):
    rows = products(spark, d)
    return C.products_of_set(rows, rows.agg(F.max("set_name")).first()[0]).select("product_id", "platform", "title")


TREE_SQL = """l AS (SELECT conv_id AS ledger_id, conv_id % 20 AS product_id, conv_id * 7 % 13 AS created_at FROM conversations GROUP BY conv_id),
i AS (SELECT conv_id AS ledger_id, turn AS item, role FROM conversations)"""


@query(f"""WITH {TREE_SQL}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY created_at DESC, ledger_id DESC) AS k FROM l) WHERE k = 1)
SELECT product_id, ledger_id, created_at, string_agg(item || ':' || role, ',' ORDER BY item, role) AS items FROM n JOIN i USING (ledger_id) GROUP BY 1, 2, 3""")
def latest_ledger_tree(spark, d):
    talk = table(spark, d, "conversations")
    ledgers = talk.select(F.col("conv_id").alias("ledger_id"), (F.col("conv_id") % 20).alias("product_id"), (F.col("conv_id") * 7 % 13).alias("created_at")).distinct()
    rows = E.latest_trees(ledgers, talk.select(F.col("conv_id").alias("ledger_id"), F.col("turn").alias("item"), "role"))
    line = lambda x: F.concat_ws(":", x["item"].cast("string"), x["role"])
    return rows.select("product_id", "ledger_id", "created_at", F.array_join(F.transform("items", line), ",").alias("items"))


@query(f"""WITH {TREE_SQL} SELECT ledger_id AS run_id, created_at FROM l WHERE product_id = 3 ORDER BY created_at DESC, ledger_id LIMIT 4""")
def runs_of_set(spark, d):
    talk = table(spark, d, "conversations")
    runs = talk.select(F.col("conv_id").alias("run_id"), (F.col("conv_id") % 20).alias("set_id"), (F.col("conv_id") * 7 % 13).alias("created_at")).distinct()
    return C.newest(runs.filter("set_id = 3"), 4, 0, key="run_id").select("run_id", "created_at")


@query(f"{WITH_REVIEWS}, x AS (SELECT review_id, rating, source FROM reviews WHERE review_id % 3 > 0), y AS (SELECT review_id, 9.0::DOUBLE AS rating, 'new' AS source FROM reviews WHERE review_id % 3 < 2) SELECT * FROM y UNION ALL SELECT * FROM x WHERE review_id % 3 = 2")
def upserted_rows(spark, d):
    rows = reviews(spark, d).select("review_id", "rating", "source")
    fresh = rows.filter("review_id % 3 < 2").withColumns({"rating": F.lit(9.0), "source": F.lit("new")})
    return C.upsert(rows.filter("review_id % 3 > 0"), fresh, "review_id")


PROFILE_ROWS = "product_id, source_hash, status, last_error"


@query(f"""{HASH_SQL} SELECT product_id, 'new' AS source_hash, 'ready' AS status, NULL::VARCHAR AS last_error FROM prints WHERE product_id % 3 < 2 UNION ALL
SELECT product_id, 'old', 'failed', 'why' FROM prints WHERE product_id % 3 = 2""")
def profile_upsert(spark, d):
    ids = reviews(spark, d).select("product_id").distinct()
    old = ids.filter("product_id % 3 > 0").withColumns({"source_hash": F.lit("old"), "status": F.lit("failed"), "last_error": F.lit("why")})
    return C.upsert_ready(old, ids.filter("product_id % 3 < 2").withColumn("source_hash", F.lit("new")))


@query("SELECT p_partkey AS product_id, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_name END AS name, CASE WHEN p_partkey % 8 = 0 THEN 'other' ELSE p_brand END AS platform FROM part")
def patched_rows(spark, d):
    rows = products(spark, d).select("product_id", "name", "platform")
    fresh = rows.filter("product_id % 4 = 0").select("product_id", F.lit("new").alias("name"), F.when(F.col("product_id") % 8 == 0, "other").alias("platform"))
    return C.patch(rows, fresh, "product_id")


@query(f"{WITH_REVIEWS}, {PRODUCTS_SQL} SELECT 'products' AS kind, count(*) AS n FROM products WHERE product_id % 3 > 0 UNION ALL SELECT 'reviews', count(*) FROM reviews WHERE product_id % 3 > 0")
def deleted_cascade(spark, d):
    rows = products(spark, d)
    parents, children = C.delete_cascade(rows, {"reviews": reviews(spark, d)}, rows.filter("product_id % 3 = 0"), "product_id")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(parents, "products").unionByName(count(children["reviews"], "reviews"))


@query(f"{WITH_REVIEWS} SELECT review_id, CASE WHEN user_id % 5 > 0 THEN user_id END AS user_id FROM reviews")
def users_deleted(spark, d):
    rows = reviews(spark, d).select("review_id", "user_id")
    return C.set_null(rows, rows.filter("user_id % 5 = 0").select("user_id"), "user_id")


@query(f"{HASH_SQL} SELECT product_id, CASE WHEN product_id % 3 < 2 THEN 'stale' ELSE 'ready' END AS status, CASE WHEN product_id % 3 > 0 THEN source_hash END AS source_hash FROM prints")
def status_marked(spark, d):
    prints = C.fingerprint(reviews(spark, d), "product_id").withColumn("status", F.lit("ready"))
    return C.mark_status(prints.filter("product_id % 3 > 0"), prints.filter("product_id % 3 < 2"), "stale").select("product_id", "status", "source_hash")


@query(f"""{WITH_REVIEWS}, {PRODUCTS_SQL}, x AS (SELECT product_id, name, 'main' AS origin FROM products WHERE product_id % 3 > 0),
y AS (SELECT product_id, left(repeat(name, 20), 255) AS name, 'fresh' AS origin FROM products WHERE product_id % 3 < 2)
SELECT 'product' AS kind, product_id, md5(name) AS text, origin FROM (SELECT * FROM y UNION ALL SELECT * FROM x WHERE product_id % 3 = 2)
UNION ALL SELECT 'review', review_id, md5(CASE WHEN product_id % 3 < 2 THEN left(repeat(source, 30), 50) ELSE source END), CASE WHEN product_id % 3 < 2 THEN 'fresh' ELSE 'main' END FROM reviews WHERE product_id % 3 = 2 OR review_id % 2 = 0""")
def synced_tables(spark, d):
    rows = products(spark, d).select("product_id", "name")
    posts = reviews(spark, d).select("review_id", "product_id", "source")
    fresh = rows.filter("product_id % 3 < 2").select("product_id", F.repeat("name", 20).alias("name"), F.lit("fresh").alias("origin"))
    fresh_posts = posts.filter("product_id % 3 < 2 AND review_id % 2 = 0").select("review_id", "product_id", F.repeat("source", 30).alias("source"), F.lit("fresh").alias("origin"))
    main = lambda df: df.filter("product_id % 3 > 0").withColumn("origin", F.lit("main"))
    # products of a third that is fresh alone keep no old review; those of a third that is main alone keep all
    merged, stored = C.synced(main(rows), main(posts), fresh, fresh_posts)
    shown = lambda df, kind, key, text: df.select(F.lit(kind).alias("kind"), F.col(key).alias("product_id"), F.md5(text).alias("text"), "origin")
    return shown(merged, "product", "product_id", "name").unionByName(shown(stored, "review", "review_id", "source"))


@query(f"{WITH_REVIEWS}, {PRODUCTS_SQL} SELECT 'products' AS kind, product_id, 1 AS n, 'new' AS origin FROM products WHERE product_id % 2 = 0 UNION ALL SELECT 'products', product_id, 1, 'old' FROM products WHERE product_id % 2 = 1 UNION ALL SELECT 'reviews', product_id, count(*), CASE WHEN product_id % 2 = 0 THEN 'new' ELSE 'old' END FROM reviews WHERE product_id IN (SELECT product_id FROM products) OR product_id % 2 = 1 GROUP BY 2, 4")
def bundle_inserted(spark, d):
    rows, posts = products(spark, d).select("product_id"), reviews(spark, d).select("product_id", "review_id")
    old = {"products": rows.withColumn("origin", F.lit("old")), "reviews": posts.withColumn("origin", F.lit("old"))}
    even = rows.filter("product_id % 2 = 0")
    bundle = {"products": even.withColumn("origin", F.lit("new")), "reviews": posts.join(even, "product_id", "left_semi").withColumn("origin", F.lit("new"))}
    once = C.insert_bundle(old, bundle)
    twice = C.insert_bundle(once, bundle)
    count = lambda kind: twice[kind].groupBy("product_id", "origin").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "product_id", "n", "origin")
    return count("products").unionByName(count("reviews"))


@query(f"""{LEDGER_SQL} SELECT 'L' || product_id || '/' || name AS aspect_id, 'L' || product_id AS ledger_id, n FROM ledger""")
def ledger_tree(spark, d):
    found = _mentions(spark, d)
    ledger = E.ledger(found).select(F.concat(F.lit("L"), F.col("product_id").cast("string")).alias("ledger_id"), "name", "n")
    proof = E.ledger_evidence(found).select(F.concat(F.lit("L"), F.col("product_id").cast("string")).alias("ledger_id"), "name", "rank")
    tree = C.ledger_tree(ledger.select("ledger_id").distinct(), ledger, proof)
    kept = tree["evidence"].select("aspect_id").distinct()  # every aspect of a ledger has evidence
    return tree["aspects"].join(kept, "aspect_id", "left_semi").select("aspect_id", "ledger_id", "n")


@query("""WITH p AS (SELECT event_id, user_id, ts AS put_at, event_id AS payload FROM events WHERE event_type = 'view'), a AS (SELECT event_id AS ask_id, user_id, ts AS asked_at FROM events WHERE event_type = 'click')
SELECT ask_id, user_id, payload FROM (SELECT a.ask_id, a.user_id, p.payload, row_number() OVER (PARTITION BY a.ask_id ORDER BY put_at DESC) AS k FROM a JOIN p ON a.user_id = p.user_id AND put_at <= asked_at AND epoch_us(asked_at) - epoch_us(put_at) < 1800 * 1000000) WHERE k = 1""")
def context_cache(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    puts = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("put_at"), F.col("event_id").alias("payload"))
    asks = events.filter("event_type = 'click'").select(F.col("event_id").alias("ask_id"), "user_id", F.col("ts").alias("asked_at"))
    return C.cached(puts, asks, "user_id").select("ask_id", "user_id", "payload")


def _items(spark, d):
    """Benchmark items made from reviews: a product each, with its reviews and an external summary for some."""
    review = F.struct(
        F.col("review_id").cast("string").alias("id"), F.col("review_id").cast("string").alias("review_external_id"), "rating", "title", "plus", "minus", "comment",
        F.when(F.col("review_id") % 4 == 0, "").otherwise(F.date_format("review_date", "yyyy-MM-dd'T'HH:mm:ss")).alias("review_date"), F.lit(None).cast("string").alias("source_url"),
    )
    rows = reviews(spark, d).groupBy("product_id").agg(F.array_sort(F.collect_list(review)).alias("reviews"))
    summary = F.when(F.col("product_id") % 2 == 0, F.struct(F.concat(F.lit("sum "), F.col("product_id").cast("string")).alias("summary_text"), *[F.lit(None).cast("string").alias(c) for c in ("pros_text", "cons_text", "highlights", "raw_block")]))
    named = {c: F.lit(None).cast("string") for c in ("product_external_id", "product_url", "category", "notes")}
    return rows.select(
        F.concat(F.lit("P"), F.col("product_id").cast("string")).alias("id"), F.lit("set").alias("benchmark_set_name"), F.lit("pl").alias("platform_name"), named["product_external_id"].alias("product_external_id"),
        F.concat(F.lit("title "), F.col("product_id").cast("string")).alias("product_title"), named["product_url"].alias("product_url"), F.lit("2024-02-03T04:05:06Z").alias("snapshot_timestamp"),
        named["category"].alias("category"), named["notes"].alias("notes"), "reviews", summary.alias("external_summary"),
    )


def _parsed(spark, d, wrapped: bool):
    lines = B.lines(_items(spark, d))
    text = F.concat(F.lit('{"items": ['), "value", F.lit("]}")) if wrapped else F.concat(F.lit("["), "value", F.lit("]"))
    return B.parse_catalogue(lines.select(text.alias("value")))


@query(f"{WITH_REVIEWS} SELECT 'P' || product_id AS product_id, review_id::VARCHAR AS id, rating, md5(concat_ws('|', coalesce(title, '-'), coalesce(plus, '-'), coalesce(minus, '-'), comment)) AS text, CASE WHEN review_id % 4 > 0 THEN epoch(review_date)::BIGINT END AS seconds FROM reviews")
def catalogue_reviews(spark, d):
    text = F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in ("title", "plus", "minus")], "comment"))
    return B.review_rows(_parsed(spark, d, False)).select("product_id", "id", "rating", text.alias("text"), F.unix_seconds("review_date").alias("seconds"))


@query(f"{WITH_REVIEWS} SELECT DISTINCT 'P' || product_id AS id, 'title ' || product_id AS product_title, 1706933106 AS seconds FROM reviews")
def catalogue_products(spark, d):
    rows = B.product_rows(_parsed(spark, d, True))
    return rows.select("id", "product_title", F.unix_seconds("snapshot_timestamp").alias("seconds"))


@query(f"{WITH_REVIEWS} SELECT DISTINCT 'P' || product_id AS product_id, 'sum ' || product_id AS summary_text FROM reviews WHERE product_id % 2 = 0")
def catalogue_externals(spark, d):
    return B.external_rows(_parsed(spark, d, True)).select("product_id", "summary_text")


@query("SELECT 'X1' AS id, 'one' AS product_title, 2 AS reviews UNION ALL SELECT 'X2', 'two', 0")
def catalogue_inline(spark, d):
    text = (
        '[{"id": "X1", "product_title": "one", "snapshot_timestamp": "2024-01-01T00:00:00", "reviews": [{"id": "a"}, {"id": "b"}]},'
        ' {"id": "X2", "product_title": "two", "snapshot_timestamp": "2024-01-01T00:00:00Z", "reviews": []}]'
    )
    return B.parse_text(spark, text).select("id", "product_title", F.size("reviews").alias("reviews"))


@query(f"""{WITH_REVIEWS}, s AS (SELECT product_id, 'mean' AS metric, 'ours' AS system, avg(rating) AS value FROM reviews GROUP BY 1 UNION ALL SELECT product_id, 'count', 'ours', count(*)::DOUBLE FROM reviews GROUP BY 1)
SELECT product_id, system, max(value) FILTER (metric = 'count') AS count, max(value) FILTER (metric = 'mean') AS mean FROM s GROUP BY 1, 2""")
def report_table(spark, d):
    rows = reviews(spark, d).groupBy("product_id").agg(F.avg("rating").alias("mean"), F.count("*").cast("double").alias("count"))
    return B.wide(E.long_form(rows, "ours"))


@query("SELECT * FROM (VALUES ('aspect_evidence', 8), ('llm', 1), ('aspect', 2), ('stub', 0), ('external', 0)) AS t(system, functions)")
def functional_comparison(spark, d):
    return E.functional_comparison(B.functional_table(spark))


@query(f"{WITH_REVIEWS}, {PRODUCTS_SQL} SELECT review_id, coalesce(CASE WHEN p.product_id % 2 = 0 THEN p.name END, '—') AS name FROM reviews r LEFT JOIN products p USING (product_id)")
def summary_products(spark, d):
    names = products(spark, d).filter("product_id % 2 = 0").select("product_id", "name")
    return C.named(reviews(spark, d).select("review_id", "product_id"), names, "product_id", "name", F.lit("—")).select("review_id", "name")


@query("SELECT p_partkey AS product_id, CASE WHEN count(*) OVER (PARTITION BY p_brand) > 1 THEN printf('%s #%d', p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) ELSE p_brand END AS label FROM part")
def disambiguated_labels(spark, d):
    rows = products(spark, d).select("product_id", F.col("platform").alias("name"))
    return C.disambiguated(rows, "name", "product_id").select("product_id", "label")


@query(f"""{HASH_SQL}, j AS (SELECT product_id, source_hash, product_id % 4 AS k FROM prints) SELECT product_id, source_hash FROM j WHERE k <> 1""")
def pending_jobs(spark, d):
    prints = C.fingerprint(reviews(spark, d), "product_id")
    kind = F.col("product_id") % 4  # 0 unknown, 1 ready, 2 another hash, 3 failed
    stored = prints.filter(kind > 0).select("product_id", F.when(kind == 2, "old").otherwise(F.col("source_hash")).alias("source_hash"), F.when(kind == 3, "failed").otherwise("ready").alias("status"))
    return J.pending(prints.select("product_id"), prints, stored).select("product_id", "source_hash")


@query(f"""{HASH_SQL} SELECT 'built' AS kind, product_id, 0 AS attempt FROM prints WHERE product_id % 5 > 0 UNION ALL SELECT CASE WHEN product_id % 2 = 0 THEN 'dead' ELSE 'retry' END, product_id, CASE WHEN product_id % 2 = 0 THEN 3 ELSE 1 END FROM prints WHERE product_id % 5 = 0""")
def rebuilt_profiles(spark, d):
    """One batch of the worker, tried twice: plans of some products fail as they run and go back, or to the dead letters; all land in keyed tables."""
    kinds = "kind string, product_id long, attempt int"
    tables = {kind: Versions(spark, new_folder(spark), "product_id", kinds) for kind in ("built", "retry", "dead")}

    def build(jobs):
        broken = F.when(F.col("product_id") % 5 == 0, F.raise_error(F.lit("cannot build")).cast("long")).otherwise(F.col("product_id"))
        return jobs.withColumn("product_id", broken)

    def keep(kind: str):
        def store(rows, number: int) -> None:
            tables[kind].replace(rows, rows.select(F.lit(kind).alias("kind"), "product_id", F.col("attempt").cast("int").alias("attempt")), batch=("worker", number))

        return store

    ids = reviews(spark, d).select("product_id").distinct()
    attempt = F.when((F.col("product_id") % 5 == 0) & (F.col("product_id") % 2 == 0), 2).otherwise(0)
    jobs = kept(ids.select(F.lit("product").alias("job_type"), "product_id", F.lit(False).alias("force"), attempt.alias("attempt")))
    for _ in range(2):  # the second time nothing is stored again
        J.rebuild_batch(build, keep("built"), keep("retry"), keep("dead"))(jobs, 0)
    built, again, dead = (t.read() for t in tables.values())
    return built.unionByName(again).unionByName(dead)


@query(f"{WITH_REVIEWS} SELECT review_id FROM reviews r WHERE EXISTS (SELECT 1 FROM reviews q WHERE q.product_id = r.product_id) AND comment <> ''")
def text_present(spark, d):
    return M.with_text(reviews(spark, d)).select("review_id")
