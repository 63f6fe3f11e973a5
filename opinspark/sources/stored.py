"""Where queries and runs keep what they have made: folders that all machines see."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without one gets a folder of its own, a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="opinspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession) -> str:
    """A fresh folder there, gone when the driver's process ends."""
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def kept(rows: DataFrame) -> DataFrame:
    """Rows written and read again: made once, however often they are used."""
    path = new_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass
