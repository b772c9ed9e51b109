"""The folder that driver and executors share, and tables cut from their lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a local one in local mode (tests), else an error:
    executors of a cluster do not see the driver's disk."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def dealt(df: DataFrame, keys: list[str], rows: int, share: int = 250_000) -> DataFrame:
    """`df` with equal keys in one task and some `share` of its `rows` a task: adaptive execution would put together as many
    as fit its size on the wire, and a task's memory would grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // share)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
