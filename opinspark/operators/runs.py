"""An evaluation run over a set of products: stages that are kept, so that a run that broke off goes on where it stopped.

A stage is a table under the run's folder; one that is there is read, not made again. A product that fails in a stage (its model raised,
its answer can't be read) goes on as a row with its error, and all others go on without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from . import evaluation as E
from .summaries import Model, answer_json

SCORES = ("faithfulness_score", "coverage_score", "sentiment_consistency_score", "specificity_score", "overall_preference")
RUBRIC = ", ".join(f"{s} double" for s in SCORES) + ", rationale string, unsupported_claims array<string>, missing_aspects array<string>"


@dataclass
class Run:
    """A run's folder and which of its stages were made this time."""

    spark: SparkSession
    folder: str
    made: list[str] = field(default_factory=list)

    def has(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def stage(self, name: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        path = f"{self.folder}/{name}"
        if force or not self.has(name):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)


def asked(rows: DataFrame, prompt: str, model: Model, tries: int = 1) -> DataFrame:
    """Adds ``answer`` and ``error``: what the model said, or why it failed the last of its tries."""
    schema = rows.withColumns({"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema

    def ask(text: str | None) -> tuple[str | None, str | None]:
        why = None
        for _ in range(tries):
            try:
                return model(text), None
            except Exception as failed:  # noqa: BLE001  a plug-in's failure is that row's result
                why = f"{type(failed).__name__}: {failed}"[:500]
        return None, why

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [ask(p) for p in batch[prompt]]
            yield batch.assign(answer=[a for a, _ in found], error=[e for _, e in found])

    return rows.mapInPandas(run, schema)


def clamped(score: Column) -> Column:
    """Scores are from 0 to 10; what isn't a number is none."""
    return F.when(score.isNotNull() & ~F.isnan(score), F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)))


def rubric_scores(texts: DataFrame, lines: DataFrame, model: Model, tries: int = 1) -> DataFrame:
    """A judge's rubric of each text: five scores from 0 to 10, a rationale, two lists, or an ``error``.

    ``texts`` (product_id, system, flat) meet their product's ``lines`` (product_id, line) as one block, by line. An answer without an object, or with none
    of the scores, is an error.
    """
    block = lines.groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("block"))
    prompt = F.concat_ws("\n", F.lit("Reference:"), F.coalesce("block", F.lit("")), F.lit("Candidate:"), F.coalesce("flat", F.lit("")))
    rows = asked(texts.join(block, "product_id", "left").withColumn("prompt", prompt).drop("block"), "prompt", model, tries)
    said = answer_json(F.col("answer"), RUBRIC)
    scores = {s: clamped(said[s]) for s in SCORES}
    unread = F.coalesce(*scores.values()).isNull()
    error = F.coalesce("error", F.when(unread, F.lit("no scores in the answer")))
    rest = {c: said[c] for c in ("rationale", "unsupported_claims", "missing_aspects")}
    return rows.withColumns(scores | rest | {"error": error}).drop("prompt", "answer")


def pairwise_votes(pairs: DataFrame, lines: DataFrame, model: Model) -> DataFrame:
    """Two rounds of a judge's choice between our text and the other's, sides swapped in the second, and the winner over both."""
    block = lines.groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("block"))
    rows = pairs.join(block, "product_id", "left")
    ask = lambda a, b: F.concat_ws("\n", F.coalesce("block", F.lit("")), F.lit("A:"), F.coalesce(a, F.lit("")), F.lit("B:"), F.coalesce(b, F.lit("")))
    for name, prompt in (("first", ask("ours", "theirs")), ("second", ask("theirs", "ours"))):
        rows = asked(rows.withColumn("_prompt", prompt), "_prompt", model)
        rows = rows.withColumn(name, answer_json(F.col("answer"), "winner string")["winner"]).drop("_prompt", "answer", "error")
    return E.pairwise_winner(rows).select("product_id", "first_winner", "second_winner", "winner")


def evaluation_run(
    spark: SparkSession,
    folder: str,
    products: DataFrame,
    mentions: Callable[[DataFrame], DataFrame],
    summarize: Callable[[DataFrame], DataFrame],
    theirs: DataFrame,
    judge: Model | None = None,
    ledgers: DataFrame | None = None,
    force: bool = False,
    good: tuple = E.GOOD,
    bad: tuple = E.BAD,
    generic: tuple = L.GENERIC_TOKENS,
) -> dict[str, DataFrame]:
    """Runs a set of products (product_id, ...) through all stages and gives their tables.

    ``ledgers`` that are known are reused, those of other products made from ``mentions`` (of the products that need them); ``force`` makes all anew.
    ``summarize`` gives our texts (product_id, text_overall, text_pros, text_cons, text_neutral, error); ``theirs`` has the same columns without error. Products without
    a text of ours get an error row. Results: ``results`` (product_id, system, metric, value, error), ``rubric``, ``votes``, and ``tree``.
    """
    run = Run(spark, folder)
    ids = products.select("product_id").distinct()

    def all_ledgers() -> DataFrame:
        old = ledgers.join(ids, "product_id", "left_semi") if ledgers is not None and not force else None
        need = ids if old is None else ids.join(old.select("product_id").distinct(), "product_id", "left_anti")
        fresh = E.ledger(mentions(need)).withColumn("reused", F.lit(False))
        return fresh if old is None else fresh.unionByName(old.withColumn("reused", F.lit(True)))

    book = run.stage("ledgers", all_ledgers, force)
    proof = run.stage("evidence", lambda: E.ledger_evidence(mentions(ids)), force)
    ours = run.stage("summaries", lambda: ids.join(summarize(ids), "product_id", "left"), force)
    texts = ["text_overall", "text_pros", "text_cons", "text_neutral"]
    missing = F.when(F.coalesce(*texts).isNull(), F.coalesce("error", F.lit("no summary")))
    ours = ours.withColumn("error", F.coalesce("error", missing))
    fine = ours.filter("error is null").select("product_id", *texts, F.lit("ours").alias("system"))
    both = fine.unionByName(theirs.join(ids, "product_id", "left_semi").select("product_id", *texts, F.lit("external").alias("system")))

    def metrics() -> DataFrame:
        found = E.all_metrics(book.drop("reused"), both, proof, good, bad, generic)
        names = [c for c, kind in found.dtypes if kind == "double"]
        return found.unpivot(["product_id", "system"], names, "metric", "value")

    measured = run.stage("metrics", metrics, force)
    none = {"metric": F.lit(None).cast("string"), "value": F.lit(None).cast("double")}
    failed = ours.filter("error is not null").select("product_id", F.lit("ours").alias("system"), "error").withColumns(none)
    results = measured.withColumn("error", F.lit(None).cast("string")).unionByName(failed)
    out = {"ledgers": book, "results": results}
    lines = E.judge_lines(book.drop("reused"), proof)
    flat = E.with_flat(both).select("product_id", "system", "flat")
    if judge is not None:
        out["rubric"] = run.stage("rubric", lambda: rubric_scores(flat, lines, judge), force).drop("flat")
        sides = flat.groupBy("product_id").agg(*[F.max(F.when(F.col("system") == s, F.col("flat"))).alias(c) for s, c in (("ours", "ours"), ("external", "theirs"))])
        out["votes"] = run.stage("votes", lambda: pairwise_votes(sides.filter("ours is not null and theirs <> ''"), lines, judge), force)
    out["tree"] = run_tree(ids, out["results"], out.get("rubric"), out.get("votes"))
    return out


def run_tree(products: DataFrame, results: DataFrame, rubric: DataFrame | None = None, votes: DataFrame | None = None) -> DataFrame:
    """Three levels, a row a product: its systems (with error, overall rubric score), each with its metrics by name, and who won."""
    metric = F.when(F.col("metric").isNotNull(), F.struct("metric", "value"))
    systems = results.groupBy("product_id", "system").agg(F.array_sort(F.collect_list(metric)).alias("metrics"), F.max("error").alias("error"))
    if rubric is None:
        systems = systems.withColumn("preference", F.lit(None).cast("double"))
    else:
        systems = systems.join(rubric.select("product_id", "system", F.col("overall_preference").alias("preference")), ["product_id", "system"], "left")
    gathered = systems.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("system", "error", "preference", "metrics"))).alias("systems"))
    rows = products.join(gathered, "product_id", "left")
    return rows.withColumn("winner", F.lit(None).cast("string")) if votes is None else rows.join(votes.select("product_id", "winner"), "product_id", "left")
