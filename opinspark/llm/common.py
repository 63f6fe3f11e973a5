"""Small helpers the corpus operators share: tables, durable intermediates, prefix sums."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a folder of its own (tests); on a cluster that is an error, since
    each machine would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="opinspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._opinspark_path = path
    atexit.register(_remove, spark, path)
    return out


def discard(df: DataFrame) -> None:
    """Remove a materialized table that no pending plan reads any more."""
    _remove(df.sparkSession, df._opinspark_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone already; leftovers are the cluster's to sweep
        pass


def global_order(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Number the rows of ``df`` by ``order`` and add running sums, without one task seeing all rows.

    Rows are range partitioned and sorted; each partition's totals (one row a
    partition) are summed up first, then added to the running values inside.
    Adds ``row_index`` (from 0) and, for each x of ``sums``, ``x_before``: the sum of x
    over the rows before. ``df`` is read twice (Spark samples range bounds): hand in
    something cheap to read. ``order`` should tell rows apart; equal rows may swap.
    """
    parts = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    )
    totals = parts.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select(
        "_part",
        zero(F.sum("_rows").over(before)).alias("_rows_before"),
        *[zero(F.sum(f"_sum_{c}").over(before)).alias(f"_{c}_before") for c in sums],
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        # one row a partition of the range exchange: far below any broadcast limit
        parts.join(F.broadcast(totals), "_part")
        .withColumn("row_index", F.col("_rows_before") + F.row_number().over(inside) - 1)
        .withColumns({f"{c}_before": F.col(f"_{c}_before") + F.sum(c).over(running) - F.col(c) for c in sums})
        .drop("_part", "_rows_before", *[f"_{c}_before" for c in sums])
    )


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
