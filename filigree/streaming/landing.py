"""Streams over a landing folder: new image files, their ledger, and windowed event metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, every: int = 100) -> DataFrame:
    """Job tables (Parquet) as they land, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", every).parquet(folder)


def once(jobs: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: state is dropped as the watermark passes."""
    return jobs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def into_ledger(jobs: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Runs each micro-batch and appends its ledger rows, named by batch so that a repeated batch overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return jobs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def windowed(events: DataFrame, time: str, value: str, by: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("window"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), user).agg(F.count(F.lit(1)).alias("n"))
