"""Frames as they arrive: stateless raster operators on streams of pixel files, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "image_id long, y int, x int, v int"


def read_frames(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A stream of pixel tables (Parquet); a file holds whole images."""
    return spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", files).parquet(path)


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs a batch operator on every micro-batch and appends its result; replays of a batch overwrite its own folder."""

    def run(df: DataFrame, epoch: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and tumbling window, with a watermark on ``ts``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
