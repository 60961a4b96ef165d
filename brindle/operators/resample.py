"""Bars from ticks or from finer bars, and calendar gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules whose bins start at the same instants whether they are counted from midnight or from the epoch.
RULES = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}


def resample_ohlcv(df: DataFrame, rule: str, ts: str = "ts") -> DataFrame:
    """symbol, ts (start of the bin) and open, high, low, close, volume as far as df has them.

    df holds ticks (price, qty) or bars. First and last are the first and last non-null in time; bars with a null are
    dropped. One shuffle, after partial aggregation.
    """
    rule = RULES.get(rule, rule)
    if "price" in df.columns:
        df = df.select("symbol", F.col(ts).alias("ts"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.col("qty").alias("volume"))
    aggs = {
        "open": F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ts"))),
        "high": F.max("high"),
        "low": F.min("low"),
        "close": F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))),
        "volume": F.sum("volume"),
    }
    have = [c for c in aggs if c in df.columns]
    out = df.groupBy("symbol", F.window("ts", rule).alias("_w")).agg(*[aggs[c].alias(c) for c in have])
    return out.select("symbol", F.col("_w.start").alias("ts"), *have).dropna(subset=have)


def calendar(df: DataFrame, start: str, end: str, step: str = "1 day", out: str = "date") -> DataFrame:
    """Every step from start to end, both included; start and end are columns of the one-row df."""
    return df.select(F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"interval {step}"))).alias(out))


def missing_dates(df: DataFrame, date: str = "date", lookback_days: int | None = None) -> DataFrame:
    """Days between the first (or lookback_days before the last) and last date of df that it lacks."""
    dates = df.select(F.to_date(date).alias("date"))
    bounds = dates.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    if lookback_days is not None:
        bounds = bounds.withColumn("lo", F.date_sub("hi", lookback_days))
    return calendar(bounds, "lo", "hi").join(dates.distinct(), "date", "left_anti")


def missing_bars(df: DataFrame, rule: str = "1 hour") -> DataFrame:
    """Bins of the rule between the first and last bar of each symbol that have no bar."""
    rule = RULES.get(rule, rule)
    bounds = df.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    all_ = bounds.select("symbol", F.explode(F.sequence("lo", "hi", F.expr(f"interval {rule}"))).alias("ts"))
    return all_.join(df.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
