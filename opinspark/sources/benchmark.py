"""Benchmark catalogues: nested JSON in, one product tree a line out, reports as JSON and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "struct<id:string,review_external_id:string,rating:double,title:string,plus:string,minus:string,comment:string,review_date:string,source_url:string>"
EXTERNAL = "struct<summary_text:string,pros_text:string,cons_text:string,highlights:string,raw_block:string>"
ITEM = (
    "struct<id:string,benchmark_set_name:string,platform_name:string,product_external_id:string,product_title:string,product_url:string,"
    f"snapshot_timestamp:string,category:string,notes:string,reviews:array<{REVIEW}>,external_summary:{EXTERNAL}>"
)


def lenient_time(c):
    """Null, empty and malformed are null; a time without a zone is UTC."""
    text = F.trim(c)
    zoned = F.rlike(text, F.lit(r"(Z|[+-]\d{2}:?\d{2})$")) & F.contains(text, F.lit(":"))
    whole = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(text, F.lit("T00:00:00Z"))).when(zoned, text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(F.nullif(whole, F.lit("Z")))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Files whose root is an array of items or an object with ``items``; told apart file by file."""
    files = spark.read.option("wholetext", True).text(path)
    return parse_catalogue(files)


def parse_catalogue(files: DataFrame) -> DataFrame:
    """``value`` (a whole file) -> one row an item. A missing snapshot time fails, as does text that isn't JSON."""
    bare = F.from_json("value", f"array<{ITEM}>", {"mode": "FAILFAST"})
    wrapped = F.from_json("value", f"struct<items:array<{ITEM}>>", {"mode": "FAILFAST"})["items"]
    items = F.when(F.startswith(F.ltrim("value"), F.lit("[")), bare).otherwise(wrapped)
    rows = files.select(F.explode(items).alias("i")).select("i.*")
    when = F.when(F.col("snapshot_timestamp").isNull(), F.raise_error(F.lit("snapshot_timestamp is missing"))).otherwise(F.to_timestamp("snapshot_timestamp"))
    return rows.withColumn("id", F.coalesce("id", F.uuid() if hasattr(F, "uuid") else F.expr("uuid()"))).withColumn("snapshot_timestamp", when)


def parse_text(spark: SparkSession, raw: str) -> DataFrame:
    return parse_catalogue(spark.createDataFrame([(raw,)], "value string"))


def read_yaml(spark: SparkSession, text: str) -> DataFrame:
    """YAML through JSON; needs a YAML library."""
    import json

    import yaml

    return parse_text(spark, json.dumps(yaml.safe_load(text), default=str))


def product_rows(items: DataFrame) -> DataFrame:
    return items.drop("reviews", "external_summary")


def review_rows(items: DataFrame) -> DataFrame:
    rows = items.select(F.col("id").alias("product_id"), F.explode("reviews").alias("r")).select("product_id", "r.*")
    return rows.withColumn("review_date", lenient_time(F.col("review_date")))


def external_rows(items: DataFrame) -> DataFrame:
    return items.filter("external_summary is not null").select(F.col("id").alias("product_id"), "external_summary.*", "snapshot_timestamp")


def lines(items: DataFrame) -> DataFrame:
    """One product tree a row, as JSON with its nulls."""
    return items.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def export_jsonl(items: DataFrame, path: str) -> None:
    lines(items).write.mode("overwrite").text(path)


SYSTEMS = ("system", "extracts_aspects", "cites_evidence", "plans_content", "verifies", "rare_aspects", "configurable", "open_methods", "metrics")
# What the summarization methods of this engine do, by the columns above; external summaries are known by their text alone.
FUNCTIONS = (
    ("aspect_evidence", "yes", "yes", "yes", "yes", "yes", "yes", "yes", "yes"),
    ("llm", "no", "no", "no", "no", "no", "yes", "no", "no"),
    ("aspect", "yes", "no", "no", "no", "no", "yes", "no", "no"),
    ("stub", "no", "no", "no", "no", "no", "no", "no", "no"),
    ("external", "no", "no", "no", "no", "no", "no", "no", "no"),
)


def functional_table(spark: SparkSession, rows: tuple = FUNCTIONS) -> DataFrame:
    """The static comparison of systems."""
    return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in SYSTEMS))


def wide(metrics: DataFrame) -> DataFrame:
    """Metrics (product_id, system, metric, value) with one column a metric, in order."""
    names = sorted(r.metric for r in metrics.select("metric").distinct().collect())  # a fixed set of metrics
    return metrics.groupBy("product_id", "system").pivot("metric", names).agg(F.first("value"))


def write_report(metrics: DataFrame, path: str, functions: DataFrame | None = None) -> None:
    """Metrics as JSON lines, and as CSV with one column a metric; the functional comparison as CSV beside them."""
    metrics.write.mode("overwrite").json(f"{path}/metrics.json")
    wide(metrics).write.mode("overwrite").option("header", True).csv(f"{path}/metrics.csv")
    if functions is not None:
        functions.write.mode("overwrite").option("header", True).csv(f"{path}/functional.csv")
