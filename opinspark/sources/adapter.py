"""Logical tables of reviews over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, product_id, user_id, source, rating, title, plus, minus, comment, review_date, created_at."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    start = F.lit("2024-01-01").cast("timestamp")
    lines = F.split("text", "\n")
    long = F.size(lines) >= 4
    even = long & (F.col("doc_id") % 2 == 0)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("review_id"),
        (F.col("doc_id") % 50).alias("product_id"),
        F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 37).alias("user_id"),
        "source",
        F.expr("CASE WHEN toxic = 1 THEN 1.0D WHEN quality = 1 THEN 5.0D WHEN quality = 0 THEN 3.0D END").alias("rating"),
        F.when(long, F.get(lines, 0)).alias("title"),
        F.when(even, F.get(lines, 1)).alias("plus"),
        F.when(even, F.get(lines, 2)).alias("minus"),
        F.col("text").alias("comment"),
        F.when(F.col("doc_id") % 10 != 9, start + F.make_dt_interval(hours=F.col("doc_id"))).alias("review_date"),
        (start + F.make_dt_interval(mins=F.col("doc_id"))).alias("created_at"),
    )


REVIEWS_SQL = """reviews AS (
  SELECT d.doc_id AS review_id, d.doc_id % 50 AS product_id,
    CASE WHEN d.doc_id % 11 <> 0 THEN d.doc_id % 37 END AS user_id, d.source,
    CAST(CASE WHEN l.toxic = 1 THEN 1.0 WHEN l.quality = 1 THEN 5.0 WHEN l.quality = 0 THEN 3.0 END AS DOUBLE) AS rating,
    CASE WHEN len(string_split(d.text, chr(10))) >= 4 THEN string_split(d.text, chr(10))[1] END AS title,
    CASE WHEN len(string_split(d.text, chr(10))) >= 4 AND d.doc_id % 2 = 0 THEN string_split(d.text, chr(10))[2] END AS plus,
    CASE WHEN len(string_split(d.text, chr(10))) >= 4 AND d.doc_id % 2 = 0 THEN string_split(d.text, chr(10))[3] END AS minus,
    d.text AS comment,
    CASE WHEN d.doc_id % 10 <> 9 THEN TIMESTAMP '2024-01-01' + to_hours(d.doc_id) END AS review_date,
    TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
