"""Appending to a chunk table from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_stream(spark: SparkSession, folder: str, pattern: str, schema, target: str, checkpoint: str, size: int, pos: str, value: str) -> DataFrame:
    """Read the files of a folder that are new, deal their items into chunks and append those to a Parquet table.

    The checkpoint makes each file count once, whatever fails; the table is partitioned by nothing and read as a whole.
    """
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    items = source.select(F.floor(F.col(pos) / size).cast("long").alias("chunk_id"), (F.col(pos) % size).alias("pos"), F.col(value).alias("value"))
    items.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(items.schema).parquet(target)


def chunk_sizes_by_window(events: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Items per time window of a stream, closed once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
