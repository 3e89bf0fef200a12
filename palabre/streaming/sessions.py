"""Extension: the events as a stream. Windows with a watermark, and sessions with a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def counts_by_window(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; events later than the watermark are dropped by contract of the stream."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, late: str = "1 day", gap: str = "6 hours") -> DataFrame:
    """(user_id, start, end, n): sessions that end after a gap without events."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Everything there is now, in one run of micro-batches, to an in-memory table (for tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
