"""Trading signals from the last bars of each symbol, and agreement across timeframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rolling import last_row, series
from brindle.operators import indicators as ind


def _listed(df: DataFrame, rows: list[tuple[Column, str, str, Column]]) -> DataFrame:
    """symbol, signal, direction, confidence of the conditions that hold."""
    arr = F.array(*[F.when(cond, F.struct(F.lit(name).alias("signal"), F.lit(way).alias("direction"), conf.cast("double").alias("confidence"))) for cond, name, way, conf in rows])
    return df.select("symbol", F.explode(F.array_compact(arr)).alias("_s")).select("symbol", "_s.signal", "_s.direction", "_s.confidence")


def library_signals(bars: DataFrame) -> DataFrame:
    """RSI extremes, a cross of SMA 50 and 200 on the last bar (with more than 200 bars), and the price against SMA 50; none for symbols with under 50 bars."""
    w = Window.partitionBy("symbol")
    df = ind.rsi(ind.sma(bars, 50, 200)).withColumns({"_n": F.count(F.lit(1)).over(w), "_p50": F.lag("sma_50").over(series()), "_p200": F.lag("sma_200").over(series())})
    df = last_row(df).filter("_n >= 50")
    c = F.col
    many = c("_n") > 200
    return _listed(
        df,
        [
            (c("rsi_14") < 30, "RSI Oversold", "bullish", 0.7 + (30 - c("rsi_14")) / 100),
            (c("rsi_14") > 70, "RSI Overbought", "bearish", 0.7 + (c("rsi_14") - 70) / 100),
            (many & (c("_p50") < c("_p200")) & (c("sma_50") > c("sma_200")), "Golden Cross", "bullish", F.lit(0.9)),
            (many & (c("_p50") > c("_p200")) & (c("sma_50") < c("sma_200")), "Death Cross", "bearish", F.lit(0.9)),
            (c("close") > c("sma_50"), "Price > SMA 50", "bullish", F.lit(0.6)),
            (~F.coalesce(c("close") > c("sma_50"), F.lit(False)), "Price < SMA 50", "bearish", F.lit(0.6)),
        ],
    )


def basic_signals(bars: DataFrame) -> DataFrame:
    """Trend alignment and RSI extremes with stop and target prices."""
    df = last_row(ind.rsi(ind.sma(bars, 20, 50)))
    c = F.col
    rows = [
        (c("sma_20") > c("sma_50"), "Trend Alignment", "bullish", 0.7, 0.95, 1.10),
        (c("rsi_14") < 30, "RSI Oversold", "bullish", 0.8, 0.98, 1.05),
        (c("rsi_14") > 70, "RSI Overbought", "bearish", 0.6, 1.02, 0.95),
    ]
    arr = F.array(*[F.when(cond, F.struct(F.lit(s).alias("signal"), F.lit(d).alias("direction"), F.lit(k).alias("confidence"), (c("close") * stop).alias("stop_loss"), (c("close") * tp).alias("take_profit"))) for cond, s, d, k, stop, tp in rows])
    return df.select("symbol", F.explode(F.array_compact(arr)).alias("_s")).select("symbol", "_s.*")


def alignment(frames: dict[str, DataFrame]) -> DataFrame:
    """symbol, score (0 to 100), direction, aligned: agreement of the close against SMA 50 over timeframes with 50 bars."""
    parts = []
    for name, bars in frames.items():
        last = last_row(ind.sma(bars, 50)).filter(F.col("sma_50").isNotNull())
        parts.append(last.select("symbol", F.lit(name).alias("timeframe"), F.when(F.col("close") > F.col("sma_50"), 1.0).otherwise(-1.0).alias("vote")))
    votes = parts[0]
    for p in parts[1:]:
        votes = votes.unionByName(p)
    mean = F.avg("vote")
    out = votes.groupBy("symbol").agg((F.abs(mean) * 100).alias("score"), mean.alias("_m"))
    return out.select("symbol", "score", F.when(F.col("_m") > 0.3, "bullish").when(F.col("_m") < -0.3, "bearish").otherwise("neutral").alias("direction"), (F.col("score") == 100).alias("aligned"))


def fractal_alignment(frames: dict[str, DataFrame], n: int = 20) -> DataFrame:
    """symbol, aligned, kind: whether every timeframe's close stands on the same side of its SMA."""
    parts = []
    for name, bars in frames.items():
        last = last_row(ind.sma(bars, n))
        trend = F.when(F.col("close") > F.col(f"sma_{n}"), "Bullish").when(F.col("close") < F.col(f"sma_{n}"), "Bearish").otherwise("Neutral")
        parts.append(last.select("symbol", F.lit(name).alias("timeframe"), trend.alias("trend")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    out = all_.groupBy("symbol").agg(F.bool_and(F.col("trend") == "Bullish").alias("_up"), F.bool_and(F.col("trend") == "Bearish").alias("_down"))
    return out.select("symbol", (F.col("_up") | F.col("_down")).alias("aligned"), F.when(F.col("_up"), "Full Bullish").when(F.col("_down"), "Full Bearish").otherwise("Mixed").alias("kind"))


def psychological_levels(df: DataFrame, price: str = "close") -> DataFrame:
    """df with levels: the price rounded to ten thousands (half to even) and one step on either side."""
    base = F.bround(price, -4)
    return df.withColumn("levels", F.array(base - 10000, base, base + 10000))
