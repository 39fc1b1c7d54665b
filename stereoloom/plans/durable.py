"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    A local session without one gets a folder of this machine; elsewhere that
    raises, since executors would not see one another's files.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            configured = f"file://{tempfile.gettempdir()}/stereoloom-checkpoints"
        sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_cuts(spark: SparkSession) -> int:
    """Delete the cuts this driver wrote; what was built on them can no longer be read. Returns how many."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
