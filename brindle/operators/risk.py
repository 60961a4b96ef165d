"""Volatility, value at risk, stress, sizing, composite scores."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rolling import change, clip, full, last_row, quotient, ratio, tail
from brindle.functions.scalars import below, sentiment_label
from brindle.functions.selection import percentiles
from brindle.operators import garch
from brindle.operators import indicators as ind
from brindle.operators.kernels import garch_next_variance

#: Stress scenarios and their price moves: fixed values.
SCENARIOS = {"Flash Crash": -0.30, "Flow Reversal": -0.15, "Minor Correction": -0.05}


def annual_volatility(bars: DataFrame) -> DataFrame:
    """symbol, volatility: deviation of all log returns times the root of 365."""
    return ind.log_returns(bars).groupBy("symbol").agg((F.stddev_samp("log_ret") * math.sqrt(365)).alias("volatility"))


def value_at_risk(bars: DataFrame, confidences: tuple[float, ...] = (0.95, 0.99), least: int = 30) -> DataFrame:
    """symbol and var_95 and the like: the loss that returns exceed with the remaining probability; 0 for under `least` bars."""
    df = bars.withColumn("_r", change("close", 1))
    names = [f"var_{round(c * 100)}" for c in confidences]
    sizes = bars.groupBy("symbol").agg((F.count(F.lit(1)) < least).alias("_few"))
    found = percentiles(df, "_r", [1 - c for c in confidences], names).join(sizes, "symbol")
    return found.select("symbol", *[F.when(F.col("_few"), 0.0).otherwise(F.abs(F.col(n))).alias(n) for n in names])


def portfolio_var(bars: DataFrame, value: float = 100000.0, confidence: float = 0.95, days: int = 1) -> DataFrame:
    """symbol, var_pct, var_amount over some days."""
    q = F.abs(F.col("_q") * math.sqrt(days))
    return percentiles(bars.withColumn("_r", change("close", 1)), "_r", [1 - confidence], ["_q"]).select("symbol", F.round(q * 100, 2).alias("var_pct"), F.round(q * value, 2).alias("var_amount"))


def risk_report(bars: DataFrame, n: int = 90) -> DataFrame:
    """symbol, volatility, var_95, var_99, max_drawdown, score over the last n bars."""
    df = ind.drawdown(ind.log_returns(tail(bars, n))).withColumn("_r", change("close", 1))
    few = F.count(F.lit(1)) < 30
    var = lambda p: F.when(few, 0.0).otherwise(F.abs(F.percentile("_r", F.lit(p))))
    out = df.groupBy("symbol").agg((F.stddev_samp("log_ret") * math.sqrt(365)).alias("_v"), var(0.05).alias("_95"), var(0.01).alias("_99"), F.min("drawdown").alias("_dd"))
    score = F.least(F.lit(100.0), 50 * F.col("_v") + 100 * F.abs("_dd"))
    return out.select("symbol", F.round("_v", 4).alias("volatility"), F.round("_95", 4).alias("var_95"), F.round("_99", 4).alias("var_99"), F.round("_dd", 4).alias("max_drawdown"), F.round(score, 1).alias("score"))


def stress_test(df: DataFrame, value: str = "portfolio") -> DataFrame:
    """df with scenario, loss, remaining, severity: three rows for each of its rows."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("move")) for k, v in SCENARIOS.items()]))
    df = df.withColumn("_s", rows)
    loss = F.abs(F.col(value) * F.col("_s.move"))
    return df.withColumns({"scenario": F.col("_s.scenario"), "loss": loss, "remaining": F.col(value) - loss, "severity": F.when(F.col("_s.move") <= -0.15, "Critical").otherwise("Moderate")}).drop("_s")


def position_size(confidence: Column, volatility: Column, account: Column, max_risk: float = 0.02) -> Column:
    """Capital for a signal: none under 0.5 confidence, scaled by 20 % volatility, at most what risks max_risk with a 5 % stop."""
    scale = F.when(volatility <= 0, 0.5).otherwise(ratio(F.lit(0.2), volatility))
    size = account * scale * (2 * (confidence - 0.5))
    return F.when(confidence < 0.5, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(size, account * max_risk / 0.05)))


def assess(bars: DataFrame, regimes: DataFrame) -> DataFrame:
    """symbol, risk_score, risk_level, risks: volatility over 80 %, a fifth below the 30-bar high, a volatile regime."""
    vol = bars.withColumn("_r", change("close", 1)).groupBy("symbol").agg((F.stddev_samp("_r") * math.sqrt(365) * 100).alias("_v"))
    high = tail(bars, 30).groupBy("symbol").agg(F.max("high").alias("_h"), F.max_by("close", "ts").alias("_c"))
    df = vol.join(high, "symbol").join(regimes.select("symbol", "regime"), "symbol")
    wild, deep, odd = F.col("_v") > 80, F.coalesce(ratio(F.col("_c") - F.col("_h"), F.col("_h")) < -0.2, F.lit(False)), F.col("regime") == "volatile"
    score = F.lit(0.5) + F.when(wild, 0.2).otherwise(0.0) + F.when(odd, 0.1).otherwise(0.0)
    risks = F.array_compact(F.array(F.when(wild, "Extreme Volatility"), F.when(deep, "Significant Drawdown"), F.when(odd, "Regime Uncertainty")))
    return df.select("symbol", score.alias("risk_score"), F.when(score > 0.7, "high").when(score < 0.3, "low").otherwise("medium").alias("risk_level"), risks.alias("risks"))


def realized_volatility(bars: DataFrame, n: int = 30) -> DataFrame:
    """symbol, realized_vol: annualised percent of the last n log returns."""
    return tail(ind.log_returns(bars), n).groupBy("symbol").agg(F.round(F.stddev_samp("log_ret") * math.sqrt(365) * 100, 2).alias("realized_vol"))


def garch_volatility(bars: DataFrame, block: int = 4096) -> DataFrame:
    """symbol, garch_vol: annualised percent for the next bar from a GARCH(1,1) of all log returns; null for ten returns or fewer.

    Series of up to a block are one small group each; longer ones are fitted in blocks (operators/garch.py), to the same
    result. So no group is larger than a block.
    """
    rows = ind.log_returns(bars).filter("log_ret is not null").select("symbol", "ts", (100 * F.col("log_ret")).alias("r"))
    sizes = bars.select("symbol").distinct().join(rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.max(F.abs("r")).alias("_most")), "symbol", "left")
    annual = lambda v: F.sqrt(v) * math.sqrt(365)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "variance": [garch_next_variance(pdf.sort_values("ts")["r"].to_numpy())]})

    short = rows.join(sizes.filter(f"_n between 11 and {block}").select("symbol"), "symbol").groupBy("symbol").applyInPandas(run, "symbol string, variance double")
    long = sizes.filter(f"_n > {block} and _most > 0").select("symbol")
    if not long.isEmpty():
        short = short.unionByName(garch.next_variances(rows.join(long, "symbol").select("symbol", "ts", (F.col("r") * F.col("r")).alias("r2")), block))
    still = F.when((F.col("_n") > 10) & (F.col("_most") == 0), 0.0)
    return sizes.join(short, "symbol", "left").select("symbol", F.coalesce(annual(F.col("variance")), still).alias("garch_vol"))


def synthetic_iv(bars: DataFrame, fear_greed: Column | float = 50.0) -> DataFrame:
    """symbol, hv_30, iv, label: historical volatility and ATR, shifted by fear and greed; symbols with 30 bars or more."""
    fng = F.lit(fear_greed) if isinstance(fear_greed, (int, float)) else fear_greed
    df = ind.atr(ind.log_returns(bars)).withColumns({"_hv": full(F.stddev_samp, "log_ret", 30) * math.sqrt(365) * 100, "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    df = last_row(df).filter("_n >= 30")
    raw = 0.6 * F.col("_hv") + 0.4 * ratio(F.col("atr_14"), F.col("close")) * math.sqrt(365) * 100
    iv = raw * (1 + (50 - fng) / 200)
    label = F.when(iv > F.col("_hv") * 1.2, "overpriced").when(iv < F.col("_hv") * 0.8, "underpriced").otherwise("fair")
    return df.select("symbol", F.col("_hv").alias("hv_30"), iv.alias("iv"), label.alias("label"))


def sentiment_indicators(bars: DataFrame, flows: DataFrame) -> DataFrame:
    """symbol, composite, label, trend, volatility, volatility_class, net_flow_7d, flow_size; flows (symbol, ts, net_flow) count over the 7 days up to their last."""
    df = bars.withColumns({"_r7": change("close", 7) * 100, "_r1": change("close", 1)})
    vol = tail(df, 30).groupBy("symbol").agg((F.stddev_samp("_r1") * math.sqrt(365) * 100).alias("volatility"))
    last = flows.groupBy("symbol").agg(F.max("ts").alias("_end"))
    net = flows.join(last, "symbol").filter(F.col("ts") >= F.date_sub("_end", 7)).groupBy("symbol").agg(F.sum("net_flow").alias("net_flow_7d"))
    out = last_row(df).select("symbol", F.coalesce("_r7", F.lit(0.0)).alias("return_7d")).join(vol, "symbol").join(net, "symbol", "left").withColumn("net_flow_7d", F.coalesce("net_flow_7d", F.lit(0.0)))
    composite = 0.6 * F.tanh(F.col("return_7d") / 10) + 0.4 * F.tanh(F.col("net_flow_7d") / 1e9)
    vol_class = F.when(F.col("volatility").isNull(), "unknown").otherwise(below(F.col("volatility"), [(30, "low"), (60, "normal"), (100, "high")], "extreme"))
    size = below(F.abs("net_flow_7d"), [(100e6, "minimal"), (500e6, "moderate"), (1e9, "significant")], "massive")
    return out.select("symbol", composite.alias("composite"), sentiment_label(composite).alias("label"), F.when(F.col("return_7d") > 0, "bullish").otherwise("bearish").alias("trend"), "volatility", vol_class.alias("volatility_class"), "net_flow_7d", size.alias("flow_size"))


def history_position(bars: DataFrame) -> DataFrame:
    """symbol, percentile, from_high_pct, from_low_pct, position of the last close in its history; it is infinitely far above a low of zero."""
    cur = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("_c"), F.max("high").alias("_h"), F.min("low").alias("_l"))
    df = bars.join(cur, "symbol").groupBy("symbol", "_c", "_h", "_l").agg((F.count_if(F.col("close") < F.col("_c")) / F.count(F.lit(1)) * 100).alias("percentile"))
    high = quotient(F.col("_c") - F.col("_h"), F.col("_h")) * 100
    p = F.col("percentile")
    position = F.when((p > 95) & (high > -5), "near_high").when(p > 75, "upper").when(p > 25, "middle").when(p > 5, "lower").otherwise("near_low")
    return df.select("symbol", "percentile", high.alias("from_high_pct"), (quotient(F.col("_c") - F.col("_l"), F.col("_l")) * 100).alias("from_low_pct"), position.alias("position"))


def overall_confidence(age_hours: Column, regime: Column, signal: Column, risk: Column) -> Column:
    """Weighted confidence: freshness .2, completeness .15 (taken as 1), regime .25, mean signal .2, risk .2."""
    return 0.2 * F.greatest(F.lit(0.0), 1 - age_hours / 24) + 0.15 + 0.25 * F.coalesce(regime, F.lit(0.5)) + 0.2 * F.coalesce(signal, F.lit(0.5)) + 0.2 * (1 - F.coalesce(risk, F.lit(0.5)))


def clipped(x: Column) -> Column:
    """x between 0 and 1."""
    return clip(x, 0.0, 1.0)
