"""The registered queries: each applies one operator to its whole table.

``QUERIES`` maps names to functions of (spark, sf_dir); ``SQL`` has DuckDB text for those
that SQL can express. Digest columns are derived here from the operators' own results. Where a model or a choice of the
method's own fills some columns, a query ``base_<name>`` gives the others, for which there is SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_corpus
from .common import table
from .decontamination import decontaminate
from .licenses import scan_licenses
from .mixing import mix
from .mtree import top_k
from .ngram_join import ngram_jaccard_components
from .packing import pack
from .resampling import resample
from .secrets import KINDS, scan_secrets
from .secrets import train as train_secrets
from .sharding import shard_by_bytes
from .sql import SQL  # noqa: F401
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import grade, train


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file stands; the package is on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return grade(docs, model).select("doc.doc_id", "severity", "p_toxic", "toxic")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.array_max(F.transform("spans", lambda x: x["coverage"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["start"])).alias("last_word"),
        joined(labels("places")).alias("base_labels"),
        joined(F.concat(labels("places"), labels("spans"))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), [1, 2, 3], 3).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, train_secrets(docs))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc.doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "n_links"
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).drop("row")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_licenses(spark, sf_dir).drop("labels", "score")


def base_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing(spark, sf_dir).drop("taken", "copies")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_secrets(spark, sf_dir).drop("spans")


def base_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_ngram_join(spark, sf_dir).drop("n_links")


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk_search,
        op2_toxicity,
        op3_decontamination,
        op4_suffix_dedup,
        op5_substring_dedup,
        op6_licenses,
        op7_sharding,
        op8_mixing,
        op9_secrets,
        op10_ngram_join,
        op11_alignment,
        op12_packing,
        op13_resampling,
        base_licenses,
        base_mixing,
        base_secrets,
        base_ngram_join,
    )
}
