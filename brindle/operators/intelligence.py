"""Reports in words: narratives, ranked actions, the confidence of an analysis and the daily report with its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rolling import ratio

#: The sentences of the narratives: fixed values.
SUMMARY = "The market is currently in a **%s** regime with %.0f%% confidence. "
SENTIMENT = "Sentiment is **%s**. "
CAUTION = "Caution is advised due to elevated risk levels. "
REGIME = "Market has been in %s state for approx. %d days. Characteristics suggest structure is %s."
NO_SIGNALS = "No significant technical signals detected at this time."
SIGNALS = "Detected %d active signals. Primary signal is **%s** (%s) with %.0f%% confidence."
RISK = "Risk environment is rated **%s** (Score: %.0f/100). Primary concerns include: %s."
#: Action, priority, reason and timing by what calls for it: fixed values.
ACTIONS = {
    "risk_stops": ("Tighten Stop Losses", "critical", "High risk environment detect", "Immediate"),
    "risk_size": ("Reduce Position Size", "high", "Volatility mandates smaller sizing", "Next rebalance"),
    "bull": ("Accumulate Spot", "high", "Trend is bullish", "On 4H dips"),
    "bear": ("Preserve Capital / Hedge", "high", "Trend is bearish", "Immediate"),
}
#: The head of a block of lessons: a fixed value.
LESSONS = "*** LESSONS LEARNED (DO NOT REPEAT PAST MISTAKES) ***"
MONITOR = ("Monitor Support at $", "medium", "Key structural level", "Continuous")


def narratives(df: DataFrame) -> DataFrame:
    """symbol, summary, regime_text, signal_text, risk_text of rows with regime, confidence (0 to 1), label, duration, traits, n_signals, signal, direction, signal_confidence, risk_level, risk_score and risks.

    Missing parts leave their sentence out, or say undefined and unknown.
    """
    c = F.col
    percent = lambda x: F.round(x * 100, 0)
    summary = F.concat(
        F.format_string(SUMMARY, F.upper("regime"), percent(c("confidence"))),
        F.when(F.length("label") > 0, F.format_string(SENTIMENT, F.replace("label", F.lit("_"), F.lit(" ")))).otherwise(""),
        F.when(c("risk_level") == "high", CAUTION).otherwise(""),
    )
    trait = F.lower(F.coalesce(F.get("traits", F.lit(0)), F.lit("undefined")))
    regime = F.format_string(REGIME, "regime", F.coalesce("duration", F.lit(0)), trait)
    signal = F.when(F.coalesce("n_signals", F.lit(0)) == 0, NO_SIGNALS).otherwise(F.format_string(SIGNALS, "n_signals", "signal", "direction", percent(c("signal_confidence"))))
    risk = F.format_string(RISK, F.upper(F.coalesce("risk_level", F.lit("unknown"))), percent(F.coalesce("risk_score", F.lit(0.0))), F.array_join(F.slice("risks", 1, 2), ", "))
    return df.select("symbol", summary.alias("summary"), regime.alias("regime_text"), signal.alias("signal_text"), risk.alias("risk_text"))


def strongest(signals: DataFrame) -> DataFrame:
    """symbol, n_signals, signal, direction, signal_confidence: the most confident signal of each symbol, ties by name, and the mean_confidence of all."""
    w = Window.partitionBy("symbol").orderBy(F.desc("confidence"), "signal")
    whole = Window.partitionBy("symbol")
    rows = signals.withColumns({"_k": F.row_number().over(w), "n_signals": F.count(F.lit(1)).over(whole), "mean_confidence": F.avg("confidence").over(whole)})
    return rows.filter("_k = 1").select("symbol", "n_signals", "signal", "direction", F.col("confidence").alias("signal_confidence"), "mean_confidence")


def ranked_actions(df: DataFrame) -> DataFrame:
    """symbol, place, action, priority, rationale, timing of rows with regime, risk_level and support: protection first, then the trend, then what to watch."""
    item = lambda test, a, p, r, t: F.when(test, F.struct(a.alias("action"), F.lit(p).alias("priority"), F.lit(r).alias("rationale"), F.lit(t).alias("timing")))
    risky = F.coalesce(F.col("risk_level").isin("high", "critical"), F.lit(False))
    tests = {"risk_stops": risky, "risk_size": risky, "bull": F.col("regime") == "bull", "bear": F.col("regime") == "bear"}
    watch = F.concat(F.lit(MONITOR[0]), F.format_number(F.coalesce(F.col("support").cast("double"), F.lit(0.0)), 0))
    items = [item(tests[k], F.lit(v[0]), *v[1:]) for k, v in ACTIONS.items()] + [item(F.lit(True), watch, *MONITOR[1:])]
    return df.select("symbol", F.posexplode(F.array_compact(F.array(*items))).alias("place", "_a")).select("symbol", F.col("place") + 1, "_a.*").toDF("symbol", "place", "action", "priority", "rationale", "timing")


def agreement(primary: Column, secondary: Column) -> tuple[Column, Column]:
    """How far two sources of one flow confirm each other: a confidence by their relative difference (20 if the first is 0), and Verified or Caution."""
    away = F.coalesce(ratio(F.abs(primary - secondary), F.abs(primary)), F.lit(100.0))
    confidence = F.when(away < 0.05, 100).when(away < 0.15, 85).when(away < 0.5, 50).otherwise(20)
    return confidence, F.when(confidence > 70, "Verified").otherwise("Caution")


def _billions(x: Column) -> Column:
    return F.format_string("$%.1fB", x / 1e9)


def daily_report(days: DataFrame) -> DataFrame:
    """date, open, high, low, close, turnover, net_flow, confidence, status, thoughts (array), check of rows with the first seven and open_interest and holdings_flow: one report a day.

    Days without a price have no thought about it, and those without open interest none about that.
    """
    c = F.col
    busy = F.coalesce(c("turnover"), F.lit(0.0))
    money = F.format_string("$%,.2f", "close")
    up = F.when(busy > 10e9, F.concat(F.lit("Price closed UP at "), money, F.lit(". High volume proxy ("), _billions(busy), F.lit(") suggests sustained accumulation."))).otherwise(
        F.concat(F.lit("Price closed UP but low volume ("), _billions(busy), F.lit(") indicates potential exhaustion."))
    )
    down = F.concat(F.lit("Price closed DOWN at "), money, F.lit(". High volume ("), _billions(busy), F.lit(") indicates aggressive selling pressure."))
    price = F.when(c("close").isNotNull(), F.when(c("close") > c("open"), up).otherwise(down))
    interest = F.when(c("open_interest") > 0, F.concat(F.lit("Open Interest at "), _billions(c("open_interest")), F.lit(". High OI with positive funding suggests heavy long positioning.")))
    first, second = F.coalesce("net_flow", F.lit(0.0)), F.coalesce("holdings_flow", F.lit(0.0))
    confidence, status = agreement(first, second)
    check = F.concat(
        F.lit("CONSENSUS ["), status, F.lit("]: "), confidence.cast("string"), F.format_string("%% confidence. primary ($%.1fM) vs Holdings-Derived ($%.1fM). ", first, second),
        F.when(confidence > 70, "High reliability.").otherwise("Discrepancy exceeds tolerance; prioritizing primary source."),
    )
    return days.select("date", "open", "high", "low", "close", "turnover", "net_flow", confidence.alias("confidence"), status.alias("status"), F.array_compact(F.array(price, interest)).alias("thoughts"), check.alias("check"))


#: What a regime's branch of the decision tree says: action, conditions, next question. Fixed values.
BRANCHES = {
    "bull": ("seek_long_setups", ["price > major_support", "flows > 0"], "Is momentum sustainable?"),
    "bear": ("seek_short_setups", ["price < major_resistance", "flows < 0"], "Is selling exhausted?"),
    "sideways": ("range_trading", ["support_holds", "resistance_holds"], "Which boundary will break?"),
}
#: Uncertainties that no column tells: the lag of data, and sources that disagree where nothing was measured. Fixed values.
LAG, DISAGREEMENT = 0.1, 0.2


def reasoning(df: DataFrame) -> DataFrame:
    """symbol, claims, branch, uncertainties, workflows, checks of rows with regime, confidence, duration, trend, flow, risk_level, mean_confidence and divergence (null where it wasn't measured).

    claims: what is held with how much confidence, on what evidence, and for how long. branch: of the decision tree, null
    for a regime that has none. workflows: what the uncertainties call for.
    """
    c = F.col
    sure = F.coalesce("confidence", F.lit(0.5))
    claim = lambda text, evidence, confidence, valid: F.struct(text.alias("claim"), evidence.alias("evidence"), confidence.alias("confidence"), valid.alias("validity"))
    evidence = F.array(F.format_string("Regime confidence: %.2f", sure), F.format_string("Duration: %d days", F.coalesce("duration", F.lit(0))), F.concat(F.lit("Price momentum: "), F.coalesce("trend", F.lit("unknown"))))
    claims = F.array(
        claim(F.format_string("Market is in %s regime", "regime"), evidence, sure, F.when(sure > 0.7, "current").otherwise("degrading")),
        claim(F.format_string("Current risk level is %s", F.coalesce("risk_level", F.lit("medium"))), F.array().cast("array<string>"), F.lit(0.85), F.lit("current")),
    )
    branch = F.lit(None).cast("struct<action:string,conditions:array<string>,next_question:string>")
    for regime, (action, conditions, question) in BRANCHES.items():
        branch = F.when(c("regime") == regime, F.struct(F.lit(action).alias("action"), F.array(*map(F.lit, conditions)).alias("conditions"), F.lit(question).alias("next_question"))).otherwise(branch)
    doubts = F.struct((1 - sure).alias("regime_stability"), (1 - F.coalesce("mean_confidence", F.lit(0.0))).alias("signal_reliability"), F.lit(LAG).alias("data_freshness"), F.coalesce("divergence", F.lit(DISAGREEMENT)).alias("cross_source_divergence"))
    workflows = F.array_compact(F.array(F.when(1 - sure > 0.3, "regime_transition_audit"), F.when(c("regime") == "volatile", "tail_risk_scrub")))
    checks = F.array(F.format_string("Is %s regime still valid at current price?", "regime"), F.format_string("Do ETF flows support %s bias?", F.coalesce("flow", F.lit("unknown"))), F.lit("Are there hidden risks in derivatives positioning?"))
    return df.select("symbol", claims.alias("claims"), branch.alias("branch"), doubts.alias("uncertainties"), workflows.alias("workflows"), checks.alias("checks"))


def market_summary(daily: DataFrame, flows: DataFrame, as_of: str) -> DataFrame:
    """symbol, current, change_1d, change_7d (per cent, against the second and seventh row from the end; 0 with fewer rows), volatility_7d (deviation of the last seven closes), net_flow_7d (millions), top_inflows and top_outflows (arrays of ticker and flow, three at most, ties by ticker), freshness_hours, at a date.

    daily: (symbol, ts, close). flows: (date, ticker, flow_usd) of the seven days up to the date, whatever the symbol; without any, the sum is 0 and the arrays are empty. A symbol without a row by then is left out.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    rows = daily.filter(F.col("ts") <= at).withColumn("_k", F.row_number().over(w)).filter("_k <= 7")
    close = lambda k: F.max(F.when(F.col("_k") == k, F.col("close")))
    change = lambda k: F.coalesce(ratio(close(1) - close(k), close(k)) * 100, F.lit(0.0))
    hours = (F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(F.max("ts").cast("timestamp"))) / 3600
    price = rows.groupBy("symbol").agg(close(1).alias("current"), change(2).alias("change_1d"), change(7).alias("change_7d"), F.stddev_samp("close").alias("volatility_7d"), hours.alias("freshness_hours"))
    day = F.to_date(at)
    totals = flows.filter(F.col("date").between(F.date_sub(day, 7), day)).groupBy("ticker").agg(F.sum("flow_usd").alias("flow"))
    best = lambda order: totals.orderBy(order, "ticker").limit(3)
    listed = lambda df, name, sign: df.agg(F.transform(F.array_sort(F.collect_list(F.struct((sign * F.col("flow")).alias("o"), "ticker", "flow"))), lambda s: F.struct(s["ticker"].alias("ticker"), s["flow"].alias("flow"))).alias(name))
    net = totals.agg((F.coalesce(F.sum("flow"), F.lit(0.0)) / 1e6).alias("net_flow_7d"))
    one = net.join(listed(best(F.desc("flow")), "top_inflows", -1)).join(listed(best(F.asc("flow")), "top_outflows", 1))
    return price.join(F.broadcast(one))  # one row


def lessons(log: DataFrame, by: str, order: str, n: int = 3) -> DataFrame:
    """by, block: the last n reflections of each group that have a text, oldest first, as the block that a prompt starts with; groups without any are left out."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    rows = log.filter(F.length("reflection") > 0).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "reflection")), False), lambda s: F.concat(F.lit("- "), s["reflection"])), "\n")
    return rows.groupBy(by).agg(F.concat_ws("\n", F.lit(LESSONS), said).alias("block"))

