"""Market regimes: features, ordered rules, confidence, duration, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rolling import change, full, last_row, ratio, series
from brindle.operators import indicators as ind

#: Probability of the next regime (columns in this order) from each regime: fixed values.
REGIMES = ["bull_trending", "bear_trending", "sideways_compression", "high_volatility", "distribution"]
MARKOV = {
    "bull_trending": [0.60, 0.00, 0.05, 0.15, 0.20],
    "bear_trending": [0.00, 0.60, 0.25, 0.10, 0.05],
    "sideways_compression": [0.30, 0.30, 0.30, 0.10, 0.00],
    "high_volatility": [0.20, 0.30, 0.40, 0.10, 0.00],
    "distribution": [0.00, 0.50, 0.10, 0.30, 0.10],
}
#: Limits by regime: share of capital, stop rule, what is ruled out. Fixed values.
CONSTRAINTS = {
    "bull_trending": (0.80, "trailing", "SHORTING_INTO_MOMENTUM"),
    "bear_trending": (0.30, "fixed_tight", "CATCHING_KNIVES,FOMO_BUYING"),
    "high_volatility": (0.50, "volatility_based", "LEVERAGE_GT_2X"),
    "sideways_compression": (0.40, "range_bound", "BREAKOUT_ANTICIPATION_WITHOUT_CONFIRMATION"),
    "distribution": (0.20, "aggressive_profit_taking", "HOLDING_THROUGH_DIPS"),
}
#: First characteristic of each regime of the first rule set: fixed values.
CHARACTER = {
    "bull": "Sustained uptrend",
    "bear": "Sustained downtrend",
    "accumulation": "Sideways consolidation",
    "distribution": "Sideways consolidation",
    "sideways": "Range-bound trading",
    "volatile": "High volatility",
}


def features(bars: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """One row a symbol: returns over 7 and 30 bars, place against SMA 20 and 50, volatility of the last 20 returns, ATR, shares of higher highs and lower lows, ADX, and the sum of the last 7 flow rows in billions."""
    df = ind.adx(ind.atr(ind.sma(bars, 20, 50)))
    df = df.withColumns({"return_7": change("close", 7), "return_30": change("close", 30), "_r": change("close", 1), "_dh": F.col("high") - F.lag("high").over(series()), "_dl": F.col("low") - F.lag("low").over(series())})
    ten = series().rowsBetween(-9, 0)
    df = df.withColumns(
        {
            "volatility": full(F.stddev_samp, "_r", 20),
            "hh_ratio": F.sum(F.when(F.col("_dh") > 0, 1).otherwise(0)).over(ten) / 10,
            "ll_ratio": F.sum(F.when(F.col("_dl") < 0, 1).otherwise(0)).over(ten) / 10,
            "vs_sma20": ratio(F.col("close"), F.col("sma_20")) - 1,
            "vs_sma50": ratio(F.col("close"), F.col("sma_50")) - 1,
        }
    )
    out = last_row(df).select("symbol", "ts", "close", "return_7", "return_30", "vs_sma20", "vs_sma50", "volatility", "atr_14", "hh_ratio", "ll_ratio", "adx")
    if flows is None:
        return out.withColumn("flow_7", F.lit(0.0))
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc(), "net_flow")
    recent = flows.withColumn("_k", F.row_number().over(w)).filter("_k <= 7").groupBy("symbol").agg((F.sum("net_flow") / 1e9).alias("flow_7"))
    return out.join(recent, "symbol", "left").withColumn("flow_7", F.coalesce("flow_7", F.lit(0.0)))


def classify(f: DataFrame) -> DataFrame:
    """regime by the first rule that holds; a null feature fails its rule."""
    c = F.col
    trend = c("hh_ratio") - c("ll_ratio")
    bull = (c("return_30") > 0.05) & (trend > 0.2) & (c("vs_sma20") > 0) & (c("vs_sma50") > 0)
    bear = (c("return_30") < -0.05) & (trend < -0.2) & (c("vs_sma20") < 0) & (c("vs_sma50") < 0)
    quiet = (F.abs("return_30") < 0.02) & (c("adx") < 25)
    return f.withColumn("regime", F.when(bull, "bull").when(bear, "bear").when(c("volatility") > 0.04, "volatile").when(quiet & (c("flow_7") > 0.5), "accumulation").when(c("flow_7") < -0.5, "distribution").otherwise("sideways"))


def confidence(f: DataFrame) -> DataFrame:
    """confidence: the share of the regime's signs that hold."""
    c = F.col
    share = lambda *tests: sum(F.coalesce(t, F.lit(False)).cast("int") for t in tests) / len(tests)
    bull = share(c("return_30") > 0.05, c("vs_sma20") > 0.02, c("hh_ratio") > 0.6, c("adx") > 25)
    bear = share(c("return_30") < -0.05, c("vs_sma20") < -0.02, c("ll_ratio") > 0.6, c("adx") > 25)
    wild = share(c("volatility") > 0.04, c("adx") < 20)
    flat = share(F.abs("return_30") < 0.05, c("adx") < 25)
    return f.withColumn("confidence", F.when(c("regime") == "bull", bull).when(c("regime") == "bear", bear).when(c("regime") == "volatile", wild).otherwise(flat))


def run_length(df: DataFrame, test: Column) -> DataFrame:
    """symbol, run_length: rows at the end of each series for which the test has held without a break; null breaks it."""
    df = df.withColumn("_t", F.coalesce(test, F.lit(False)))
    stop = df.groupBy("symbol").agg(F.max(F.when(~F.col("_t"), F.col("ts"))).alias("_stop"))
    after = F.col("_stop").isNull() | (F.col("ts") > F.col("_stop"))
    return df.join(stop, "symbol").groupBy("symbol").agg(F.count_if(after).alias("run_length"))


def duration(bars: DataFrame, regimes: DataFrame) -> DataFrame:
    """regimes with duration: bars above SMA 50 so far (bull, accumulation) or below it (bear, distribution); 10 for the others."""
    df = ind.sma(bars, 50)
    up = run_length(df, F.col("close") > F.col("sma_50")).withColumnRenamed("run_length", "_up")
    down = run_length(df, F.col("close") < F.col("sma_50")).withColumnRenamed("run_length", "_down")
    out = regimes.join(up, "symbol").join(down, "symbol")
    return out.withColumn("duration", F.when(F.col("regime").isin("bull", "accumulation"), F.col("_up")).when(F.col("regime").isin("bear", "distribution"), F.col("_down")).otherwise(10)).drop("_up", "_down")


def transitions(f: DataFrame) -> DataFrame:
    """symbol, regime, next_regime, probability: weights by rule, normalised to 1."""
    names = ["bull", "bear", "sideways", "volatile", "accumulation", "distribution"]
    c, rows = F.col, []
    for n in names:
        w = F.when(c("regime") == n, 0.5)
        if n == "distribution":
            w = w.when((c("regime") == "bull") & (c("return_30") < 0), 0.2)
        if n == "sideways":
            w = w.when((c("regime") == "bull") & (c("return_30") < 0), 0.15).when((c("regime") == "bear") & (c("return_30") > 0), 0.15)
        if n == "accumulation":
            w = w.when((c("regime") == "bear") & (c("return_30") > 0), 0.2)
        if n == "volatile":
            w = w.when(c("regime").isin("bull", "bear") & (c("volatility") > 0.04), 0.2)
        rows.append(F.struct(F.lit(n).alias("next_regime"), w.otherwise(0.1).alias("w")))
    arr = F.array(*rows)
    total = F.aggregate(arr, F.lit(0.0), lambda a, r: a + r["w"])
    return f.select("symbol", "regime", total.alias("_t"), F.explode(arr).alias("_n")).select("symbol", "regime", "_n.next_regime", (F.col("_n.w") / F.col("_t")).alias("probability"))


def detect(bars: DataFrame) -> DataFrame:
    """symbol, regime, confidence: the second rule set, from ATR against its own 95th percentile, SMA 50, RSI and a trend proxy."""
    df = ind.adx_proxy(ind.rsi(ind.atr_pct(ind.sma(bars, 50))))
    df = df.withColumn("vs_sma50", ratio(F.col("close"), F.col("sma_50")) - 1)
    stats = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.percentile("atr_pct", F.lit(0.95)).alias("p95"))
    f = last_row(df).join(stats, "symbol")
    c = F.col
    wild = c("atr_pct") > c("p95") * 1.05
    bull, bear, top = (c("vs_sma50") > 0.03) & (c("rsi_14") > 52), (c("vs_sma50") < -0.03) & (c("rsi_14") < 48), (c("rsi_14") > 70) & (c("vs_sma50") < 0.02)
    few = c("n") < 50
    regime = F.when(few, "sideways_compression").when(wild, "high_volatility").when(bull, "bull_trending").when(bear, "bear_trending").when(top, "distribution").otherwise("sideways_compression")
    strong = c("adx_proxy") > 15
    conf = F.when(few, 0.5).when(wild, 0.8).when(bull | bear, F.when(strong, 0.85).otherwise(0.7)).when(top, 0.65).otherwise(F.when(c("adx_proxy") < 15, 0.75).otherwise(0.6))
    return f.select("symbol", regime.alias("regime"), conf.alias("confidence"))


def likely_next(df: DataFrame, regime: str = "regime") -> DataFrame:
    """df with next_regime and next_probability: the likeliest other regime; an unknown regime expects sideways_compression with the even share."""
    table = df.sparkSession.createDataFrame([(k, max(((p, -i) for i, p in enumerate(v) if REGIMES[i] != k))) for k, v in MARKOV.items()], "_regime string, _best struct<p:double,i:int>")
    names = F.array(*[F.lit(r) for r in REGIMES])
    out = df.join(F.broadcast(table), F.col(regime) == F.col("_regime"), "left")  # five rows
    return out.withColumns({"next_regime": F.coalesce(F.get(names, -F.col("_best.i")), F.lit("sideways_compression")), "next_probability": F.coalesce("_best.p", F.lit(0.2))}).drop("_regime", "_best")


def constraints(df: DataFrame, regime: str = "regime") -> DataFrame:
    """df with max_allocation, stop_type and forbidden of its regime; half and `standard` for others."""
    pick = lambda i, other: F.coalesce(F.create_map(*[F.lit(x) for k, v in CONSTRAINTS.items() for x in (k, v[i])])[F.col(regime)], F.lit(other))
    return df.withColumns({"max_allocation": pick(0, 0.5), "stop_type": pick(1, "standard"), "forbidden": pick(2, "none")})


def from_history(history: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, regime of every symbol asked for, from its bars in whatever order; sideways for one without any."""
    return symbols.select("symbol").distinct().join(detect(history).select("symbol", "regime"), "symbol", "left").withColumn("regime", F.coalesce("regime", F.lit("sideways")))
