"""Streams of events: windowed rates with watermarks, and sweeps that run the batch operators on each micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

POLL = "2 seconds"


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def windowed_rate(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; works on a stream, with a watermark, and on a table alike."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with smaller gaps."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def with_recovery(apply: Callable[[DataFrame], DataFrame], recover: Callable[[], None], every_s: float = 60.0, clock: Callable[[], float] = time.monotonic) -> Callable[[DataFrame], DataFrame]:
    """What sweep() applies to each batch, with a recovery sweep before it, at the first batch and whenever the last one
    is so long ago."""
    last: list[float] = []

    def batch(rows: DataFrame) -> DataFrame:
        if not last or clock() - last[-1] >= every_s:
            last[:] = [clock()]
            recover()
        return apply(rows)

    return batch


def sweep(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Applies a batch operator to each micro-batch and appends the result; the checkpoint keeps it exactly once by batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    made = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (made.trigger(availableNow=True) if once else made.trigger(processingTime=POLL)).start()
