"""Streams of notes and run events: the batch operators on arriving data.

Redelivered notes are dropped within the watermark; late events past it are left out; the state of a thread is its last
step. The same functions serve batch and stream, so both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteweave.operators import notes


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stamped(df: DataFrame, column: str, late: str) -> DataFrame:
    """With a zoned timestamp `at` and its watermark."""
    return df.withColumn("at", F.col(column).cast("timestamp")).withWatermark("at", late)


def fresh_notes(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Notes once each, however often they are sent within the watermark."""
    return stamped(stream, "received_at", late).dropDuplicatesWithinWatermark(["document_id"])


def event_rate(stream: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows with late data."""
    return stamped(stream, "ts", late).groupBy(F.window("at", width, slide), "event_type").agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return stamped(stream, "ts", late).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))


def write_sections(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The sections of each micro-batch by the batch operator. A batch that is run again replaces what it wrote."""

    def save(batch: DataFrame, batch_id: int) -> None:
        notes.sections(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
