"""Bars, sliding heatmaps and sessions over streams of ticks. The same aggregations as in batch, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_watermark(ticks: DataFrame, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """ticks with ts as an instant (watermarks need one; the session's zone should be UTC) and a watermark on it."""
    return ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_bars(ticks: DataFrame, rule: str = "4 hours") -> DataFrame:
    """symbol, ts, open, high, low, close, volume of a stream of ticks (symbol, ts, price, qty). State: one row for each open bin and symbol."""
    out = ticks.groupBy("symbol", F.window("ts", rule).alias("_w")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("qty").alias("volume"))
    return out.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_heatmap(levels: DataFrame, width: str = "60 seconds", slide: str = "10 seconds", digits: int = -1) -> DataFrame:
    """start, bucket, qty over sliding windows of book levels (ts, price, qty)."""
    out = levels.groupBy(F.window("ts", width, slide).alias("_w"), F.bround("price", digits).alias("bucket")).agg(F.sum("qty").alias("qty"))
    return out.select(F.col("_w.start").alias("start"), "bucket", "qty")


def stream_sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """user_id, start, n of sessions of a stream of events."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("_s.start").alias("start"), "n")


def run_available(df: DataFrame, folder: str) -> DataFrame:
    """Runs a streaming aggregation over what its source holds now and gives its rows.

    Every batch's updated rows are written to a Parquet folder of that batch; a repeated batch overwrites its own. The
    result is read from the last batch that wrote each key, so nothing passes through the driver.
    """
    keys = [c for c in ("symbol", "user_id", "ts", "start", "bucket") if c in df.columns]

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/n={number}")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = df.sparkSession.read.parquet(f"{folder}/rows").drop("n")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, *[f"_v.{c}" for c in values])
