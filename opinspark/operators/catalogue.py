"""Catalogue operators: keyed reads, filters, paging, statistics, and keyed writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class NotFoundError(LookupError):
    """No row has the key asked for."""


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; raises if there is none."""
    found = df.filter(F.col(key) == value)
    if found.isEmpty():
        raise NotFoundError(f"{key}={value}")
    return found


def get_optional(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value).limit(1)


def get_by_name(df: DataFrame, column: str, name: str):
    """The one row of that name, or None; raises if there are more."""
    rows = df.filter(F.col(column) == name).limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"more than one row has {column}={name}")
    return rows[0] if rows else None


def newest(df: DataFrame, limit: int = 100, offset: int = 0, created: str = "created_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(created), F.asc(key)).offset(offset).limit(limit)


def filter_reviews(
    reviews: DataFrame, product_id=None, source=None, rating_min=None, rating_max=None, date_from=None, date_to=None
) -> DataFrame:
    """Conjunction of the bounds given; a null rating or date passes no bound."""
    out = reviews
    if product_id is not None:
        out = out.filter(F.col("product_id") == product_id)
    if source:
        out = out.filter(F.col("source") == source)
    for column, low, high in (("rating", rating_min, rating_max), ("review_date", date_from, date_to)):
        if low is not None:
            out = out.filter(F.col(column) >= F.lit(low))
        if high is not None:
            out = out.filter(F.col(column) <= F.lit(high))
    return out


def list_reviews(reviews: DataFrame, limit: int = 1000, offset: int = 0, **bounds) -> DataFrame:
    return filter_reviews(reviews, **bounds).orderBy(F.desc_nulls_last("review_date"), "review_id").offset(offset).limit(limit)


def interface_bounds(rating_min: float, rating_max: float) -> dict:
    """Slider values to bounds: the ends of the scale don't filter."""
    return {"rating_min": rating_min if rating_min > 0 else None, "rating_max": rating_max if rating_max < 5 else None}


def oldest_per_key(reviews: DataFrame, key: str, most: int = 50_000) -> DataFrame:
    """What a profile is built from: a key's oldest rows, at most ``most``."""
    order = Window.partitionBy(key).orderBy("created_at", "review_id")
    return reviews.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def latest_per_key(df: DataFrame, keys: Sequence[str], when: str, tie: str, n: int = 1) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(when), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def review_stats(reviews: DataFrame, *by: str) -> DataFrame:
    return reviews.groupBy(*by).agg(
        F.count("*").alias("reviews_count"),
        F.avg("rating").alias("rating_avg"),
        F.min("review_date").alias("date_min"),
        F.max("review_date").alias("date_max"),
    )


def products_with_counts(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every product with the number of its reviews, 0 without any."""
    counts = reviews.groupBy("product_id").agg(F.count("*").alias("reviews_count"))
    return products.join(counts, "product_id", "left").withColumn("reviews_count", F.coalesce("reviews_count", F.lit(0)))


def product_page(products: DataFrame, limit: int, offset: int, min_reviews: int = 0, name: str = "", order: str = "name") -> DataFrame:
    """Filters and sorts within a page, not before paging."""
    page = products.orderBy("product_id").offset(offset).limit(limit)
    page = page.filter((F.col("reviews_count") >= min_reviews) & F.contains(F.lower("name"), F.lit(name.lower())))
    keys = {
        "name": [F.asc("name")],
        "name_desc": [F.desc("name")],
        "reviews": [F.asc("reviews_count")],
        "reviews_desc": [F.desc("reviews_count")],
    }
    return page.orderBy(*keys[order], "product_id")


def sources(reviews: DataFrame, product_id) -> DataFrame:
    return reviews.filter(F.col("product_id") == product_id).select("source").distinct()


def overview(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(by)


def page_of(df: DataFrame, order: Sequence[str], page: int, size: int) -> DataFrame:
    """A page, counted from 1 and kept within the pages there are."""
    pages = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(page, 1), pages) - 1) * size).limit(size)


def with_children(parent: DataFrame, child: DataFrame, key: str, name: str, order: Sequence[str]) -> DataFrame:
    """Parent rows with a sorted array of their child rows: children are gathered first, so nothing multiplies."""
    rest = [c for c in child.columns if c != key and c not in order]
    gathered = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    return parent.join(gathered, key, "left")


def disambiguated(df: DataFrame, name: str, key: str) -> DataFrame:
    """Labels: a name that stands more than once gets a number."""
    same = Window.partitionBy(name)
    label = F.when(F.count("*").over(same) > 1, F.format_string("%s #%d", name, F.row_number().over(same.orderBy(key)))).otherwise(F.col(name))
    return df.withColumn("label", label)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def patch(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Update in place; nulls of ``new`` leave the old value."""
    changed = new.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    joined = existing.join(changed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in joined.columns else c for c in existing.columns])


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def delete_cascade(parents: DataFrame, children: dict[str, DataFrame], keys: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    return delete(parents, keys, key), {name: delete(child, keys, key) for name, child in children.items()}


def set_null(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """What stays of child rows when their parent goes: the key turns null."""
    gone = keys.select(F.col(key).alias("_gone")).distinct()
    return df.join(gone, F.col(key) == F.col("_gone"), "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def sync(main: DataFrame, fresh: DataFrame, key: str = "product_id") -> DataFrame:
    """A product's rows are replaced as a whole; texts are cut to what their columns hold."""
    fresh = fresh.withColumn("source", F.left("source", F.lit(50))) if "source" in fresh.columns else fresh
    return main.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def mark_status(profiles: DataFrame, keys: DataFrame, status: str, key: str = "product_id") -> DataFrame:
    """Flip the status of known keys and add placeholders for unknown ones."""
    wanted = keys.select(key).distinct()
    flipped = profiles.join(wanted, key, "left_semi").withColumn("status", F.lit(status))
    missing = wanted.join(profiles, key, "left_anti").withColumn("status", F.lit(status))
    return profiles.join(wanted, key, "left_anti").unionByName(flipped).unionByName(missing, allowMissingColumns=True)


def fingerprint(reviews: DataFrame, key: str) -> DataFrame:
    """A hash of a key's reviews that doesn't depend on their order; any changed field changes it.

    Texts are hashed with their lengths, so that none can pass for two. Hashes (64 characters a review) are joined in order of the id; a key's
    reviews are those of one profile.
    """
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))
    text = lambda c: F.concat(F.octet_length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    parts = [text(c) for c in ("title", "comment", "plus", "minus")]
    one = F.sha2(F.concat_ws(",", F.coalesce(F.format_number("rating", 4), F.lit("")), stamp("review_date"), stamp("created_at"), *parts), 256)
    rows = reviews.filter(F.col(key).isNotNull()).select(key, "review_id", one.alias("h"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("review_id", "h"))), lambda x: F.concat(x["review_id"].cast("string"), F.lit(":"), x["h"]))
    joined = F.concat_ws(":", F.col(key).cast("string"), F.array_join(F.col("hashes"), ","))
    return rows.groupBy(key).agg(lines.alias("hashes")).select(key, F.sha2(joined, 256).alias("source_hash"))


def artifacts(rows: DataFrame, summary, kind: str, limit: int = 1000) -> DataFrame:
    """What is stored of a summary, in its kind's order: mentions by time, clusters by falling importance, evidence by rank and time."""
    orders = {"mentions": ["created_at", "id"], "clusters": [F.desc("importance"), "name"], "evidence": ["rank", "created_at", "id"]}
    return rows.filter(F.col("summary_id") == summary).orderBy(*orders[kind]).limit(limit)


def products_deep(products: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], by_set: str | None = None, limit: int | None = None) -> DataFrame:
    """Products with an array of each kind of child rows (name -> rows, order), each gathered first so that nothing multiplies.

    With ``by_set``, those of one benchmark set; in order of platform and title.
    """
    out = products.filter(F.col("set_name") == by_set) if by_set is not None else products
    out = out.orderBy("platform", "title", "product_id")
    out = out.limit(limit) if limit is not None else out
    for name, (rows, order) in children.items():
        out = with_children(out, rows, "product_id", name, order)
    return out


def products_of_set(products: DataFrame, by_set: str) -> DataFrame:
    return products.filter(F.col("set_name") == by_set).orderBy("platform", "title", "product_id")


def insert_bundle(existing: dict[str, DataFrame], bundle: dict[str, DataFrame], key: str = "product_id") -> dict[str, DataFrame]:
    """A benchmark bundle (products first, then their children) replaces what is there of its products; repeated bundles change nothing."""
    first = next(iter(bundle.values())).select(key).distinct()
    return {name: existing[name].join(first, key, "left_anti").unionByName(rows) for name, rows in bundle.items()}


def upsert_ready(profiles: DataFrame, fresh: DataFrame, key: str = "product_id") -> DataFrame:
    """Built profiles replace those of their keys, as ready and without an error."""
    ready = fresh.withColumn("status", F.lit("ready")).withColumn("last_error", F.lit(None).cast("string"))
    return profiles.join(ready.select(key), key, "left_anti").unionByName(ready.select(*profiles.columns))


def synced(products: DataFrame, reviews: DataFrame, fresh_products: DataFrame, fresh_reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Benchmark products and reviews to the main tables: products merge by id, their reviews are replaced as a whole (old ones go even
    where no new ones come).

    Names are cut to 255 characters, sources to 50, descriptions to 10,000.
    """
    cut = {"name": 255, "source": 50, "description": 10_000}

    def short(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.left(c, F.lit(n)) for c, n in cut.items() if c in df.columns})

    merged = upsert(products, short(fresh_products).select(*products.columns), "product_id")
    kept = reviews.join(fresh_products.select("product_id").distinct(), "product_id", "left_anti")
    return merged, kept.select(*reviews.columns).unionByName(short(fresh_reviews).select(*reviews.columns))


def ledger_tree(ledgers: DataFrame, aspects: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """Three levels to store, with keys made from their parents': ledgers, aspects of a ledger, evidence of an aspect.

    Children of unknown parents fail.
    """
    aspect_id = F.concat_ws("/", "ledger_id", "name")
    known = aspects.join(ledgers.select("ledger_id", F.lit(True).alias("_known")), "ledger_id", "left")
    missing = F.when(F.col("_known").isNull(), F.raise_error(F.lit("an aspect of an unknown ledger"))).otherwise(aspect_id)
    stored = known.withColumn("aspect_id", missing).drop("_known")
    proof = evidence.withColumn("aspect_id", aspect_id).join(stored.select("aspect_id", F.lit(True).alias("_known")), "aspect_id", "left")
    own = F.when(F.col("_known").isNull(), F.raise_error(F.lit("evidence of an unknown aspect"))).otherwise(F.concat_ws("/", "aspect_id", F.col("rank").cast("string")))
    return {"ledgers": ledgers, "aspects": stored, "evidence": proof.withColumn("evidence_id", own).drop("_known")}


def cached(contexts: DataFrame, asked: DataFrame, key: str = "context_id", seconds: int = 1800) -> DataFrame:
    """A context cache: what was last put for a key, if that is less than ``seconds`` ago; else nothing comes back.

    ``contexts`` (key, put_at, ...) and ``asked`` (key, asked_at, ...): only puts within the time to live meet an ask.
    """
    inside = (F.col("put_at") <= F.col("asked_at")) & (F.unix_micros("asked_at") - F.unix_micros("put_at") < seconds * 1_000_000)
    rows = asked.withColumnRenamed(key, "_key").join(contexts, (F.col("_key") == F.col(key)) & inside)
    newest = Window.partitionBy("ask_id").orderBy(F.desc("put_at"))
    return rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1).drop("_n", "_key")


def clipped(label: Column, most: int = 48) -> Column:
    """Long labels end in an ellipsis."""
    return F.when(F.length(label) > most, F.concat(F.left(label, F.lit(most)), F.lit("…"))).otherwise(label)


def counted_label(name: Column, n: Column) -> Column:
    return F.format_string("%s (%d отз.)", name, n)


def named(rows: DataFrame, names: DataFrame, on: str, name: str, default: Column) -> DataFrame:
    """A name looked up by key, or the default."""
    return rows.join(names.select(on, F.col(name).alias("_name")), on, "left").withColumn(name, F.coalesce("_name", default)).drop("_name")


def filter_evidence(evidence: DataFrame, aspects: Sequence[str] = (), polarities: Sequence[str] = ()) -> DataFrame:
    out = evidence.filter(F.col("name").isin(*aspects)) if aspects else evidence
    return out.filter(F.col("sentiment").isin(*polarities)) if polarities else out


def dashboard_counts(mentions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Headline numbers of a product."""
    own = mentions.groupBy("product_id").agg(
        F.count("*").alias("mentions"), F.countDistinct("aspect").alias("candidates"), F.countDistinct("review_id").alias("reviews")
    )
    rest = clusters.groupBy("product_id").agg(F.count("*").alias("clusters"), F.count_if("rare").alias("rare_clusters"))
    return own.join(rest, "product_id", "left")


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table; the tables are counted side by side."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
