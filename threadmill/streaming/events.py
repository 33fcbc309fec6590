"""Extensions: windows over event time, and resumable runs. The reference data flow has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding windows; on a stream late rows wait ``late``."""
    t = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        t = t.withWatermark(ts, late)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return t.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes") -> DataFrame:
    """(user, start, n): runs of a user's events without a pause of ``gap``."""
    t = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return t.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), "n")


def run_available(spark: SparkSession, source: str, sink: str, checkpoint: str, transform, schema=None) -> None:
    """Processes the Parquet files that arrived since the last run, once each, and ends."""
    schema = schema or spark.read.parquet(source).schema
    stream = transform(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
