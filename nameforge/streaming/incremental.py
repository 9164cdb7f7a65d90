"""Streams: exact duplicates and running counts as records arrive. An addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first record of each key within the watermark; state older than that is dropped.

    A row that arrives more than ``late`` behind the newest one of the batches before is
    lost, even if it is the first of its key. For data that come days or weeks late take
    a ``late`` that covers them, or join late rows as a batch against what is written
    (``curate.resume``).
    """
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, window: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Records per tumbling window and group; late records count until the watermark passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("window_start"), *by, "rows")


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that is there and stops; run again, it goes on where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def read(spark: SparkSession, folder: str, schema, files: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
