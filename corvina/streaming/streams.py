"""Streaming forms of text cleaning and windowed counts (an extension: bounded sources above have no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions import text as tx


def cleaned(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds text_clean; stateless, so it runs on streams and tables alike."""
    return stream.withColumn("text_clean", tx.clean_text(F.col(text_col)))


def tumbling_counts(stream: DataFrame, time_col: str, by: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, by, n, total: counts and sums of ``value`` by event time; on streams rows later than ``late`` are dropped."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark(time_col, late)
    out = timed.groupBy(F.window(time_col, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; exactly-once into a folder of parquet."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
