"""Queries that run a stream over what its source holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.plans.registry import R, register, sql
from brindle.plans.report import market_context
from brindle.sources.tables import shared_folder
from brindle.sources.views import Market
from brindle.streaming import bars as sb


def _stream(m: Market, table: str) -> DataFrame:
    schema = m.table(table).schema
    return m.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(m.path)


def _folder(m: Market) -> str:
    return f"{shared_folder(m.spark)}/stream-{uuid.uuid4().hex}"


def _ticks(m: Market) -> DataFrame:
    return sb.with_watermark(_stream(m, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("qty")))


def _stream_bars(m: Market) -> DataFrame:
    out = sb.run_available(sb.stream_bars(_ticks(m)), _folder(m))
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


register("stream_resample", sql(f"SELECT symbol, ts, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, {R('close')} AS close, volume FROM bars", "bars"))(_stream_bars)


def _stream_heatmap(m: Market) -> DataFrame:
    levels = _ticks(m).select("ts", "price", "qty")
    out = sb.run_available(sb.stream_heatmap(levels, "4 hours", "2 hours"), _folder(m))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "bucket", F.col("qty").cast("long").alias("qty"))


register(
    "stream_sliding_heatmap",
    "SELECT start, bucket, CAST(count(*) AS BIGINT) AS qty FROM (SELECT unnest([time_bucket(INTERVAL '2 hours', ts), time_bucket(INTERVAL '2 hours', ts) - INTERVAL 2 HOUR]) AS start, round_even(value, -1) AS bucket FROM events) GROUP BY 1, 2",
)(_stream_heatmap)


register("market_context")(lambda m: market_context(m.bars(), digits=-1).select("symbol", "regime", "risk_level", "n_signals", "position"))
