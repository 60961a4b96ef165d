"""Transactions, coins and mempool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.rolling import clip, ratio


def whale_movements(outputs: DataFrame, labels: DataFrame | None = None, threshold: float = 100.0) -> DataFrame:
    """tx, size, n_outputs, label, alert of the transactions whose outputs sum to the threshold; the last known address names them."""
    if labels is not None:
        outputs = outputs.join(labels, "address", "left")
    label = F.max_by("label", F.when(F.col("label").isNotNull(), F.col("address"))) if labels is not None else F.lit(None).cast("string")
    out = outputs.groupBy("tx").agg(F.sum("value").alias("size"), F.count(F.lit(1)).alias("n_outputs"), label.alias("label")).filter(F.col("size") >= threshold)
    s = F.col("size") / threshold * 100
    return out.withColumns({"label": F.coalesce("label", F.lit("unknown")), "alert": F.when(s > 5000, "critical").when(s > 1000, "high").when(s > 100, "medium").otherwise("low")})


def net_flow(outputs: DataFrame, inputs: DataFrame, addresses: DataFrame) -> DataFrame:
    """address, net: value received less value spent by the given addresses."""
    signed = outputs.select("address", "value").unionByName(inputs.select("address", (-F.col("value")).alias("value")))
    return signed.join(addresses, "address", "left_semi").groupBy("address").agg(F.sum("value").alias("net"))


def realised_value(coins: DataFrame, price: float, as_of: str) -> DataFrame:
    """One row: mvrv, n, confidence; a coin's price halves with every 1460 days of age."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("time"))
    realised = ratio(F.sum(F.col("coins") * price * F.pow(F.lit(0.5), age / 1460)), F.sum("coins"))
    out = coins.agg(realised.alias("_r"), F.count(F.lit(1)).alias("n"))
    conf = F.when(F.col("n") >= 100, 0.65).when(F.col("n") > 0, 0.35).otherwise(0.1)
    return out.select(F.coalesce(ratio(F.lit(price), F.col("_r")), F.lit(1.85)).alias("mvrv"), "n", conf.alias("confidence"))


def velocity_mvrv(price: Column, volume: Column, cap: Column) -> Column:
    """Fallback from turnover: between 1.1 and 3.8."""
    return clip(ratio(price * volume, cap / 365) / 100, 1.1, 3.8)


def spent_output_ratio(spent: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: sopr, the mean of the price at spending over the price at creation; 1.02 without any. spent: created, spent_price; prices: date, price."""
    df = spent.join(prices.select(F.col("date").alias("created"), F.col("price").alias("_p")), "created", "left")
    return df.agg(F.coalesce(F.avg(ratio(F.col("spent_price"), F.col("_p"))), F.lit(1.02)).alias("sopr"))


def concentration(balances: DataFrame, top: int = 50) -> DataFrame:
    """One row: the sum of the largest balances."""
    return balances.orderBy(F.col("balance").desc()).limit(top).agg(F.sum("balance").alias("top_balance"))


def accumulation(history: DataFrame, by: str = "symbol", order: str = "ts", x: str = "value") -> DataFrame:
    """by, score, bias: growth from first to last, ten times, between -1 and 1; neutral for under 7 points."""
    first = F.min_by(x, order)
    growth = ratio(F.max_by(x, order) - first, first)
    score = F.when(F.count(F.lit(1)) < 7, 0.0).otherwise(clip(10 * growth, -1.0, 1.0))
    out = history.groupBy(by).agg(score.alias("score"))
    return out.withColumn("bias", F.when(F.col("score") > 0.05, "bullish").when(F.col("score") < -0.05, "bearish").otherwise("neutral"))


def congestion(megabytes: Column) -> Column:
    """Label of a mempool's size."""
    return F.when(megabytes > 300, "Extreme").when(megabytes > 100, "High").when(megabytes > 20, "Medium").otherwise("Low")
