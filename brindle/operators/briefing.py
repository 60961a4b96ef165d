"""What the analyses say in words: factors for and against, guidance, instructions of regimes, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scalars import large_number

#: What a regime asks of the writer of a synthesis, and of whoever bounds risks.
INSTRUCTIONS = {
    "bull_trending": ("Focus on momentum continuation. RSI > 50 is a support zone. Ignore minor bearish divergences.", "Max size 5%. Acceptable drawdown 10%."),
    "bear_trending": ("Oversold bounces are exit points. Resistance levels are hard ceilings.", "Max size 2%. Tight stops at 3%."),
    "sideways_compression": ("Mean reversion. RSI extremes (30/70) are entry/exit targets. Squeeze play imminent.", "Reduced sizing until breakout."),
    "high_volatility": ("Extreme unpredictability. Reduce signal weighting. Wait for volatility to contract.", "Cash preservation mode. 1% max size."),
    "distribution": ("Smart money is exiting. Watch for lower highs. Bull trap risk is extreme.", "Hedge positions. Trailing stops tight."),
}
#: Traits of a regime and what to expect of it.
CHARACTER = {
    "bull": (["Sustained uptrend", "Higher highs/lows", "Strong momentum"], "Expect trend continuation with pullbacks to support"),
    "bear": (["Sustained downtrend", "Lower highs/lows", "Weak momentum"], "Expect trend continuation with bounces to resistance"),
    "sideways": (["Range-bound", "Lack of directional conviction", "Mean reversion"], "Expect range-bound trading between support/resistance"),
}
OTHERWISE = "Monitor for regime change"


def _looked_up(table: dict, i: int, key: Column, other: Column) -> Column:
    values = [F.array(*map(F.lit, v[i])) if isinstance(v[i], list) else F.lit(v[i]) for v in table.values()]
    pairs = [x for k, v in zip(table, values) for x in (F.lit(k), v)]
    return F.coalesce(F.create_map(*pairs)[key], other)


def instructions(df: DataFrame, regime: str = "regime") -> DataFrame:
    """df with synthesizer and risk_rule of its regime; null for others."""
    none = F.lit(None).cast("string")
    return df.withColumns({"synthesizer": _looked_up(INSTRUCTIONS, 0, F.col(regime), none), "risk_rule": _looked_up(INSTRUCTIONS, 1, F.col(regime), none)})


def characteristics(df: DataFrame, regime: str = "regime") -> DataFrame:
    """df with traits (none for others) and expected behaviour of its regime."""
    return df.withColumns({"traits": _looked_up(CHARACTER, 0, F.col(regime), F.array().cast("array<string>")), "expected": _looked_up(CHARACTER, 1, F.col(regime), F.lit(OTHERWISE))})


def bias(df: DataFrame) -> DataFrame:
    """df (regime, return_7d, net_flow_7d, volatility_class) with bullish, bearish and neutral factors as texts, and net_bias: the side that leads by two or more."""
    c = F.col
    ret, flow = F.format_string("%.1f%%", "return_7d"), large_number(c("net_flow_7d"))
    say = lambda test, *text: F.when(test, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))
    bull = [say(c("regime").isin("bull", "accumulation"), "Bullish regime: ", c("regime")), say(c("return_7d") > 0, "Positive 7-day momentum: ", ret), say(c("net_flow_7d") > 0, "Positive ETF flows: ", flow)]
    bear = [say(c("regime").isin("bear", "distribution"), "Bearish regime: ", c("regime")), say(c("return_7d") < 0, "Negative 7-day momentum: ", ret), say(c("net_flow_7d") < 0, "Negative ETF flows: ", flow)]
    calm = [say(c("volatility_class").isin("normal", "low"), "Normal volatility environment")]
    df = df.withColumns({n: F.array_compact(F.array(*x)) for n, x in (("bullish", bull), ("bearish", bear), ("neutral", calm))})
    lead = F.size("bullish") - F.size("bearish")
    return df.withColumn("net_bias", F.when(lead > 1, "bullish").when(lead < -1, "bearish").otherwise("neutral"))


def guidance(df: DataFrame) -> DataFrame:
    """df (regime, risk_score, volatility_class, support, close) with sizing, stop_level, stop_distance_pct, horizon and timing."""
    c = F.col
    sizing = F.when(c("risk_score") > 0.7, "Reduce position sizes to 25-50% of normal").when(c("risk_score") > 0.5, "Moderate position sizes at 50-75% of normal").otherwise("Normal position sizing appropriate")
    extreme = F.coalesce(c("volatility_class") == "extreme", F.lit(False))
    horizon = F.when(c("regime").isin("bull", "bear") & ~extreme, "swing_trading_3-10_days").when(extreme, "intraday_scalping").otherwise("position_trading_10-30_days")
    timing = F.when(c("regime") == "bull", "Buy dips to support levels").when(c("regime") == "bear", "Sell bounces to resistance levels")
    return df.withColumns({"sizing": sizing, "stop_level": c("support"), "stop_distance_pct": (c("close") - c("support")) / c("close") * 100, "horizon": horizon, "timing": timing})


def executive_summary(df: DataFrame) -> DataFrame:
    """symbol, summary: a sentence from regime, net_bias and risk_level."""
    return df.select("symbol", F.format_string("%s is in a %s regime; the factors lean %s and risk is %s.", "symbol", "regime", "net_bias", "risk_level").alias("summary"))


def daily_summary(bars: DataFrame) -> DataFrame:
    """date, n_symbols, volume, gainers, losers, best, worst of every day of bars: who rose most and least from open to close."""
    day = bars.groupBy(F.to_date("ts").alias("date"), "symbol").agg(F.min_by("open", "ts").alias("o"), F.max_by("close", "ts").alias("c"), F.sum("volume").alias("v")).withColumn("r", F.when(F.col("o") != 0, F.col("c") / F.col("o") - 1))
    order = F.struct("r", "symbol")
    return day.groupBy("date").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum("v").alias("volume"), F.count_if(F.col("r") > 0).alias("gainers"), F.count_if(F.col("r") < 0).alias("losers"), F.max_by("symbol", order).alias("best"), F.min_by("symbol", order).alias("worst"))


def validated(df: DataFrame, required: list[str]) -> DataFrame:
    """df with passed, score (1 or 0) and missing: the required columns that are null."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    return df.withColumns({"missing": missing, "passed": F.size(missing) == 0, "score": (F.size(missing) == 0).cast("double")})


def validation_report(df: DataFrame, required: list[str], group: str) -> DataFrame:
    """group, n, n_passed, pass_rate, status of rows of validated()."""
    out = validated(df, required).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"))
    rate = F.col("n_passed") / F.col("n")
    return out.withColumns({"pass_rate": rate, "status": F.when(rate >= 0.95, "healthy").when(rate >= 0.8, "degraded").otherwise("failing")})


def reasoning(df: DataFrame) -> DataFrame:
    """symbol, graph: nested steps from observations through inference to a recommendation, of rows with regime, net_bias, bullish, bearish, risk_level and confidence."""
    unsure = F.array_compact(F.array(F.when(F.col("confidence") < 0.6, "Regime is uncertain"), F.when((F.size("bullish") > 0) & (F.size("bearish") > 0), "Factors disagree")))
    workflow = F.when(F.col("risk_level").isin("high", "critical"), "risk_assessment").when(F.col("net_bias") == "neutral", "comprehensive_analysis").otherwise("technical_only")
    return df.select("symbol", F.struct(F.struct("bullish", "bearish").alias("observations"), F.struct("regime", "net_bias").alias("inference"), unsure.alias("uncertainties"), workflow.alias("workflow")).alias("graph"))
