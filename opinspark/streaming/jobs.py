"""Profile jobs as streams: job source, deduplication, incremental rebuilds, dead letters, events, invalidation."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stored import kept
from .state import locked, spaced

JOB = "job_type string, product_id long, user_id long, force boolean, attempt int, enqueued_at timestamp"
WHOLE_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}  # microseconds too
EVENTS = ("prepared", "shown", "accepted", "ignored", "edited", "dismissed")


def encoded(jobs: DataFrame) -> DataFrame:
    """Jobs as messages: one JSON object a row, under ``payload``; null fields are left out. Columns that aren't a job's stay beside it."""
    fields = [c.split()[0] for c in JOB.split(", ")]
    return jobs.select(*[c for c in jobs.columns if c not in fields], F.to_json(F.struct(*[c for c in fields if c in jobs.columns]), WHOLE_TIMES).alias("payload"))


def decoded(messages: DataFrame) -> DataFrame:
    """Messages (``payload`` as text or bytes) as jobs, and ``problem``: why one can't be read (its job's fields are null then)."""
    text = F.col("payload").cast("string")
    whole = F.from_json(text, "map<string,string>")
    problem = F.when(text.isNull(), "empty payload").when(whole.isNull() | ~F.rlike(text, F.lit(r"^\s*\{")), "expected JSON object")
    kept = [c for c in messages.columns if c != "payload"]
    return messages.select(*kept, F.from_json(text, JOB).alias("j"), problem.alias("problem")).select(*kept, "j.*", "problem")


def job_stream(spark: SparkSession, path: str, files_per_batch: int = 5) -> DataFrame:
    """Job messages from JSON files, a few a batch; the checkpoint remembers where it stopped. Messages that can't be read are left out."""
    messages = spark.readStream.schema("payload string").option("maxFilesPerTrigger", files_per_batch).json(path)
    return decoded(messages).filter("problem is null").drop("problem")


def with_key(jobs: DataFrame) -> DataFrame:
    ids = [c for c in ("product_id", "user_id") if c in jobs.columns]
    return jobs.withColumn("job_key", F.concat_ws(":", "job_type", F.coalesce(*ids).cast("string")))


def deduplicated(jobs: DataFrame, seconds: int = 600, late: int = 0) -> DataFrame:
    """One job a key within ``seconds`` of the last one that passed; forced jobs pass by and lock nothing.

    A stream keeps each key's last job in state (see ``state.locked`` for ``late``). On a batch the jobs of a key are walked in order
    of time: a fold over one key's times.
    """
    keyed = with_key(jobs)
    forced = keyed.filter(F.coalesce("force", F.lit(False)))
    rest = keyed.filter(~F.coalesce("force", F.lit(False)))
    if jobs.isStreaming:
        return locked(rest, "job_key", "enqueued_at", seconds, late).select(*keyed.columns).unionByName(forced)
    # a job after a gap of ``seconds`` passes whatever came before, so runs between such gaps can be folded apart, some hundreds at once
    in_order = Window.partitionBy("job_key").orderBy("enqueued_at", "_tie")
    other = [c for c in jobs.columns if c not in ("enqueued_at", "force")]
    at = F.unix_micros("enqueued_at")
    rows = rest.withColumn("_at", at).withColumn("_tie", F.xxhash64(*other))
    rows = rows.withColumn("_gap", F.coalesce(F.col("_at") - F.lag("_at").over(in_order) >= seconds * 1_000_000, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.floor(F.sum("_gap").over(in_order) / 512)).drop("_gap")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_at", "_tie"])
        return group[spaced(group["_at"].tolist(), None, seconds * 1_000_000)[0]]

    kept = rows.groupBy("job_key", "_run").applyInPandas(walk, rows.schema)
    return kept.select(*keyed.columns).unionByName(forced)


def pending(jobs: DataFrame, fingerprints: DataFrame, profiles: DataFrame, key: str = "product_id") -> DataFrame:
    """Jobs whose source changed, or whose profile isn't ready."""
    ready = profiles.filter("status = 'ready'").select(key, "source_hash")
    return jobs.join(fingerprints, key).join(ready, [key, "source_hash"], "left_anti")


def staleness(fingerprints: DataFrame, profiles: DataFrame, key: str = "product_id") -> DataFrame:
    """Where each profile stands: missing, stale or ready."""
    old = profiles.select(key, F.col("source_hash").alias("_old"), "status")
    state = F.when(F.col("_old").isNull(), "missing").when((F.col("_old") != F.col("source_hash")) | (F.col("status") != "ready"), "stale").otherwise("ready")
    return fingerprints.join(old, key, "left").select(key, "source_hash", state.alias("state"))


def invalidations(reviews: DataFrame) -> DataFrame:
    """New reviews -> forced jobs for their products and users."""
    product = reviews.select(F.lit("product").alias("job_type"), F.col("product_id").cast("long"), F.lit(None).cast("long").alias("user_id"))
    user = reviews.filter("user_id is not null").select(F.lit("user").alias("job_type"), F.lit(None).cast("long").alias("product_id"), F.col("user_id").cast("long"))
    return product.unionByName(user).distinct().withColumn("force", F.lit(True))


def rebuild_batch(
    build: Callable[[DataFrame], DataFrame],
    store: Callable[[DataFrame, int], None],
    retry: Callable[[DataFrame, int], None],
    dead: Callable[[DataFrame, int], None],
    most: int = 3,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: build and store profiles; failed jobs go back, forced, or to the dead letters after ``most`` tries.

    A part of a batch whose build fails is halved by a hash of its keys, and so on down to single keys, so that a bad job falls alone however many keys
    a batch has: a bad one costs as many tries as the number of keys has binary digits. What is built is written down before
    it is stored, so that nothing of a failed build is. ``store``, ``retry`` and ``dead`` get a number that is the same when a batch is
    tried again and differs between its parts: a keyed table that remembers it counts each part once.
    """

    def attempt(jobs: DataFrame, number: int) -> str | None:
        try:
            built = kept(build(jobs))
            store(built, number)
        except Exception as why:  # noqa: BLE001  a failed job must not stop the stream
            return str(why)[:500]
        return None

    def run(batch: DataFrame, batch_id: int) -> None:
        keyed = kept(with_key(batch).withColumn("_hash", F.xxhash64("job_key")))
        numbers = count(batch_id << 20)
        parts = [(keyed, 0)]
        while parts:
            jobs, depth = parts.pop()
            why = attempt(jobs.drop("job_key", "_hash"), next(numbers))
            if why is None:
                continue
            bit = F.shiftright("_hash", depth).bitwiseAND(1)
            if depth < 64 and len(jobs.select("job_key").distinct().take(2)) > 1:
                halves = [jobs.filter(bit == b) for b in (0, 1)]
                parts += [(h, depth + 1) for h in halves if h.take(1)]
                continue
            tried = jobs.drop("job_key", "_hash").withColumn("attempt", F.coalesce("attempt", F.lit(0)) + 1).withColumn("force", F.lit(True))
            number = next(numbers)
            retry(tried.filter(F.col("attempt") < most), number)
            dead(tried.filter(F.col("attempt") >= most).withColumn("error", F.lit(why)), number)

    return run


def start_worker(jobs: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    writer = jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def valid_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin(*EVENTS))


def log_events(events: DataFrame, path: str, checkpoint: str | None = None):
    """Append valid events; a stream with a checkpoint, a batch without."""
    valid = valid_events(events)
    if events.isStreaming:
        return valid.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return valid.write.mode("append").parquet(path)
