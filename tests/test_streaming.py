"""Streams give what the batch gives, in any order and cut into any batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from opinspark.operators import catalogue as C
from opinspark.streaming import jobs as J
from opinspark.streaming import state as S

JOB = "job_type string, product_id long, user_id long, force boolean, attempt int, enqueued_at timestamp"


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Each partition of a state has a worker of its own in each batch; one will do for a few keys."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def ran(spark, tmp_path, batches, late):
    """The jobs that pass a stream which gets the batches (lists of (product, second, force, attempt)) one at a time."""
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for n, batch in enumerate(batches):
        lines = [{"job_type": "product", "product_id": p, "force": f, "attempt": a, "enqueued_at": f"2024-01-01T{t // 3600:02}:{t // 60 % 60:02}:{t % 60:02}Z"} for p, t, f, a in batch]
        (src / f"{n:03}.json").write_text("\n".join(json.dumps({"payload": json.dumps(x)}) for x in lines))
        stream = J.deduplicated(J.job_stream(spark, str(src), files_per_batch=1), late=late)
        done = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert done.awaitTermination(120)  # each batch is a run of its own: state comes back from the checkpoint
    return sorted((r.product_id, r.attempt) for r in spark.read.schema(JOB).parquet(out).collect() if r.product_id >= 0)


def batch(spark, rows):
    found = J.deduplicated(spark.createDataFrame([("product", p, None, f, a, t) for p, t, f, a in rows], "job_type string, product_id long, user_id long, force boolean, attempt int, t long").withColumn("enqueued_at", F.timestamp_seconds("t")).drop("t"))
    return sorted((r.product_id, r.attempt) for r in found.collect() if r.product_id >= 0)


def test_due_jobs_of_one_batch_pass(spark, tmp_path):
    rows = [(1, 0, False, 0), (1, 700, False, 1), (1, 1800, False, 2), (1, 1900, False, 3), (2, 5, False, 4), (2, 6, True, 5)]
    assert ran(spark, tmp_path, [rows], 0) == batch(spark, rows) == [(1, 0), (1, 1), (1, 2), (2, 4), (2, 5)]


def test_batches_in_order(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted(((rng.randrange(3), rng.randrange(5000), rng.random() < 0.1, i) for i in range(60)), key=lambda r: r[1])
    cuts = [rows[:20], rows[20:45], rows[45:]]
    for part in cuts:
        rng.shuffle(part)
    assert ran(spark, tmp_path, cuts, 0) == batch(spark, rows)


def test_any_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(5000), rng.random() < 0.1, i) for i in range(60)]
    rng.shuffle(rows)
    end = [(-1, 80_000, False, 0)]  # moves the watermark past all others
    assert ran(spark, tmp_path, [rows[:7], rows[7:40], rows[40:], end], 6000) == batch(spark, rows)


def test_contexts_live_their_time(spark, tmp_path):
    rng = random.Random(4)
    puts = [(f"c{rng.randrange(4)}", None, t, f"p{t}") for t in sorted(rng.sample(range(0, 9000), 12))]
    asks = [(f"c{rng.randrange(5)}", i, t, None) for i, t in enumerate(rng.sample(range(0, 12_000), 60))]
    asks += [(puts[0][0], 900, puts[0][2] + 1800, None)]
    rows = sorted(puts + asks, key=lambda r: r[2])
    schema, src = "context_id string, ask_id long, t long, payload string", str(tmp_path / "src")
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("at", F.timestamp_seconds("t"))
        done = S.contexts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert done.awaitTermination(120)
    got = sorted((r.ask_id, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    all_rows = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("t"))
    put = all_rows.filter("ask_id is null").select("context_id", F.col("at").alias("put_at"), "payload")
    want = C.cached(put, all_rows.filter("ask_id is not null").select("context_id", "ask_id", F.col("at").alias("asked_at")))
    assert got == sorted((r.ask_id, r.payload) for r in want.collect()) and len(got) > 10
