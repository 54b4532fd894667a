"""Incremental ingest: each micro-batch against what is already there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.dedupe import new_rows


def append_new(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Writes first-wins rows whose key is not in the table at `path`, as one availableNow run. A batch that is repeated after a
    failure replaces its own files (one folder per batch number), so it is written once."""

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        old = [f"{path}/batch={i}" for i in range(number)]
        history = spark.read.schema(batch.schema).parquet(*old) if old else batch.limit(0)
        fresh = new_rows(batch, history, key, order)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(fresh, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window, closed by a watermark."""
    from pyspark.sql import functions as F

    return stream.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
