"""Windowed counts of an event stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch


def window_counts(events: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """(window_start, keys, n) of a stream (or a table); times are those of the session's zone.

    Rows at most ``late`` behind always count.  Spark drops later ones from the
    second batch on after the one that moved the watermark past their window.
    """
    timed = events.select(F.col(at).cast("timestamp").alias("w_at"), *keys).withWatermark("w_at", late)
    counts = timed.groupBy(F.window("w_at", width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *keys, "n")


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all that its source holds now, append to Parquet in the shared folder, and read that."""
    spark: SparkSession = stream.sparkSession
    path = scratch(spark, label)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
