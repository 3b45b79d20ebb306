"""Incremental intake of extraction results.

The batch caches of the engine are append-only folders. Structured Streaming takes up files that have come since the
last run, keeps each (id, label) once, and merges them into a table; its checkpoint makes a stopped run resume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESULTS = "id string, label string, status string, score double, created timestamp"


def incoming(spark: SparkSession, path: str, schema: str = RESULTS, delay: str = "1 day") -> DataFrame:
    """Result rows of new files, the first of each id and label within the watermark."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark("created", delay).dropDuplicatesWithinWatermark(["id", "label"])


def take_up(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has come since the last run to a table, then stop."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def status_counts(rows: DataFrame, window: str = "1 hour") -> DataFrame:
    """(window, status, n): results by the time they were made."""
    return rows.groupBy(F.window("created", window), "status").agg(F.count(F.lit(1)).alias("n"))
