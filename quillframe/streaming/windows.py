"""Windowed evaluation over event streams (an extension: batch and stream share one plan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold_counts(events: DataFrame, ts: str, label: Column, score: Column, window: str = "1 day", late: str = "1 hour", threshold: float = 0.5) -> DataFrame:
    """Confusion counts a tumbling window; late rows beyond the watermark are dropped when `events` is a stream."""
    rows = events.withWatermark(ts, late).select(F.window(ts, window).alias("w"), label.cast("int").alias("y"), (score >= threshold).alias("p"))
    y = F.col("y") == 1
    return rows.groupBy("w").agg(F.count_if(y & F.col("p")).alias("tp"), F.count_if(~y & F.col("p")).alias("fp"), F.count_if(y & ~F.col("p")).alias("fn"), F.count_if(~y & ~F.col("p")).alias("tn"))


def read_events(spark, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_table(df: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete"):
    """Process what is there and stop; the result is an in-memory table, its state lies in the checkpoint."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
