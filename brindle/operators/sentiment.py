"""Sentiment from titles, votes and indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scalars import any_keyword, below

#: Words that count a title as bullish or bearish, wherever they stand in it: fixed values.
BULL = ["moon", "pump", "buy", "long", "bull", "breakout", "ath", "soar", "gain", "profit", "support", "rally", "accumulate", "hodl", "higher"]
BEAR = ["crash", "dump", "sell", "short", "bear", "drop", "ban", "fear", "panic", "loss", "resistance", "collapse", "dead", "rekt", "lower"]


def title_score(titles: DataFrame, by: str, text: str = "text", bull: list[str] | None = None, bear: list[str] | None = None) -> DataFrame:
    """by, bullish, bearish (titles with such a word), score: 0 to 100, 50 without matches, half way to 50 for under three."""
    low = titles.select(by, F.lower(text).alias("_low"))
    out = low.groupBy(by).agg(F.count_if(any_keyword(F.col("_low"), bull or BULL)).alias("bullish"), F.count_if(any_keyword(F.col("_low"), bear or BEAR)).alias("bearish"))
    n = F.col("bullish") + F.col("bearish")
    score = F.try_divide(100.0 * F.col("bullish"), n)
    return out.withColumn("score", F.round(F.when(n == 0, 50.0).when(n < 3, (score + 50) / 2).otherwise(score), 2))


def composite(fear_greed: Column, titles: Column, trends: Column) -> Column:
    """Half fear and greed, 30 % titles, 20 % search trends."""
    return 0.5 * fear_greed + 0.3 * titles + 0.2 * trends


def reading(score: Column) -> Column:
    """Five labels from Extreme Fear to Extreme Greed."""
    return below(score, [(20, "Extreme Fear"), (40, "Fear"), (60, "Neutral"), (80, "Greed")], "Extreme Greed")


def contrarian(score: Column) -> Column:
    """buy under 15, sell over 85."""
    return F.when(score < 15, "buy").when(score > 85, "sell").otherwise("none")
