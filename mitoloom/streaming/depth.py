"""Structured Streaming forms of the depth aggregates. The reference set of operators has no streams; these go beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_depth(observations: DataFrame, time: str, by: list[str], window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by event-time window and key; state is dropped when the watermark passes a window, so it stays bounded."""
    counted = observations.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def run_once(stream: DataFrame, folder: str, name: str) -> None:
    """Drains what is there now into Parquet under ``folder`` and stops; a rerun goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def run_latest(stream: DataFrame, by: list[str], folder: str, name: str) -> DataFrame:
    """Drains what is there now and returns the latest count of each window and key, also of windows that are still open.

    Each batch writes the counts it has changed into a folder of its own, which a repeated batch overwrites, so a rerun after a
    failure counts nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    written = stream.sparkSession.read.schema(f"{_ddl(stream)}, batch long").parquet(f"{folder}/{name}")
    return written.groupBy("start", *by).agg(F.max_by("n", "batch").alias("n"))


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in frame.dtypes)
