"""Resumable ingest and windowed counts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def link_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def new_rows(stream: DataFrame, key: str, time: str | None = None, late: str = "7 days") -> DataFrame:
    """The first row of each key; with a time column, keys are remembered for ``late`` only."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there and ends; a rerun takes up where the last one stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by key and tumbling window; an extension beside the batch operators."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, length), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")
