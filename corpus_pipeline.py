"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as Parquet and read again
as the next one's input. All but the last return the columns of documents. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinspark.llm.common import discard, materialize, table
from opinspark.llm.decontamination import clean
from opinspark.llm.mixing import mix, take
from opinspark.llm.ngram_join import ngram_jaccard_components, one_of_each
from opinspark.llm.sharding import sharded
from opinspark.llm.toxicity import grade, train

SHARDS = 24
WEIGHTS = [1, 2, 3]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded toxic go; all others stay, those with null or empty texts too. Repeated rows are judged alike."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return grade(docs, model).filter("not toxic").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one of the smallest id.

    Null and wordless texts all stay; rows of equal id and text are one document; a null id is never the smallest.
    """
    return one_of_each(docs, materialize(ngram_jaccard_components(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null texts hold none, null items have none."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null texts have no words and take none; the null source is one like any other."""
    return take(docs, mix(docs, WEIGHTS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with its shard of near-equal bytes and its place there; equal rows get a place each, a null text counts 8 bytes.

    Columns of the documents named size, shard or slot (in either case) give way to the stage's own.
    """
    own = ("size", "shard", "slot")
    kept = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c.lower() not in own]
    return sharded(docs, SHARDS).select(*kept, *own)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Grades come from a fitted model, which SQL can't express; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole documents table. A stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
