"""Streaming extensions: file ingest until all is read, and label runs over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Appends all new result files to a table, then stops."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()


def label_windows(events: DataFrame, ts: str, part: str, label: str, k: int, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, part, label, n) with at least k events of a label; late data up to the watermark counts."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, width), part, label).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= k)
