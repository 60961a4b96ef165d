"""Deterministic decision rules over text views, signals and regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scalars import below


def _has(x: str, word: str) -> Column:
    return F.contains(F.lower(F.col(x)), F.lit(word))


def facilitate(views: DataFrame) -> DataFrame:
    """views (retail, institution, whale, macro, regime) with decision, confidence, winner, allocation.

    The first of the persona rules that holds decides; macro views can override it or lower its confidence; a named
    intent of the whale that agrees adds 0.05. An optional column fractal (Full Bullish, Full Bearish) that agrees adds
    0.1.
    """
    bull = F.contains("regime", F.lit("bull"))
    rules = [(_has("whale", "distribute") & bull, "SELL", 0.85, "whale"), (_has("institution", "accumulating"), "BUY", 0.8, "institution"), (_has("retail", "fly") & bull, "BUY", 0.7, "retail")]

    def first(i: int, other):
        out = F.when(rules[0][0], rules[0][i])
        for r in rules[1:]:
            out = out.when(r[0], r[i])
        return out.otherwise(other)

    df = views.withColumns({"decision": first(1, "HOLD"), "confidence": first(2, 0.5), "winner": first(3, "consensus")})
    structural = _has("macro", "decoupling") & _has("macro", "bullish")
    beta = ~structural & _has("macro", "beta") & (F.col("decision") == "BUY")
    df = df.withColumns(
        {
            "confidence": F.when(structural, F.greatest("confidence", F.lit(0.85))).when(beta, F.least("confidence", F.lit(0.6))).otherwise(F.col("confidence")),
            "winner": F.when(structural, "macro").otherwise(F.col("winner")),
            "decision": F.when(structural, "BUY").otherwise(F.col("decision")),
        }
    )
    agrees = lambda x, up, down: ((F.col("decision") == "BUY") & _has(x, up)) | ((F.col("decision") == "SELL") & _has(x, down))
    if "fractal" in df.columns:
        df = df.withColumn("confidence", F.when(F.coalesce(agrees("fractal", "bullish", "bearish"), F.lit(False)), F.least(F.lit(0.99), F.col("confidence") + 0.1)).otherwise(F.col("confidence")))
    intent = F.contains("whale", F.lit("Intent:")) & ~_has("whale", "unknown") & agrees("whale", "accumulation", "distribution")
    df = df.withColumn("confidence", F.when(F.coalesce(intent, F.lit(False)), F.least(F.lit(0.95), F.col("confidence") + 0.05)).otherwise(F.col("confidence")))
    return df.withColumn("allocation", F.when(F.col("decision") == "HOLD", 0.0).otherwise(0.5))


def size_by_regime(df: DataFrame) -> DataFrame:
    """df with the allocation of purchases halved in high volatility."""
    return df.withColumn("allocation", F.when((F.col("regime") == "high_volatility") & (F.col("decision") == "BUY"), F.col("allocation") * 0.5).otherwise(F.col("allocation")))


def thinking_level(volatility: Column) -> Column:
    """Effort by volatility."""
    return below(volatility, [(30, "minimal"), (60, "low"), (90, "medium")], "high")


def critique(decision: Column, roi_pct: Column) -> Column:
    """noise under half a percent, wrong_direction for a loss over one percent, else ok."""
    wrong = ((decision == "BUY") & (roi_pct < -1)) | ((decision == "SELL") & (roi_pct > 1))
    return F.when(F.abs(roi_pct) < 0.5, "noise").when(wrong, "wrong_direction").otherwise("ok")


def order_quantity(side: Column, confidence: Column, cash: Column, holdings: Column, price: Column, override: Column | None = None) -> Column:
    """Quantity of an order: a tenth of the cash (purchases) or holdings (sales), half as much again for confidence over .8, half for under .6; nothing under 10 in cash or 0.0001 in holdings."""
    share = F.lit(0.1) * F.when(confidence > 0.8, 1.5).when(confidence < 0.6, 0.5).otherwise(1.0)
    share = F.least(F.lit(1.0), share if override is None else F.coalesce(override, share))
    spend, sell = cash * share, holdings * share
    buy = F.when(spend < 10, 0.0).otherwise(F.round(spend / price, 6))
    return F.when(side == "BUY", buy).when(side == "SELL", F.when(sell < 0.0001, 0.0).otherwise(F.round(sell, 6))).otherwise(0.0)


def regime_opportunities(regimes: DataFrame) -> DataFrame:
    """symbol, opportunity, confidence of bull and sideways regimes."""
    rows = regimes.filter(F.col("regime").isin("bull", "sideways"))
    bull = F.col("regime") == "bull"
    return rows.select("symbol", F.when(bull, "Trend Continuation").otherwise("Range Trading").alias("opportunity"), F.when(bull, 0.8).otherwise(0.6).alias("confidence"))


def opportunities(regimes: DataFrame, signals: DataFrame, risks: DataFrame) -> DataFrame:
    """symbol, opportunity, confidence: by regime, and signals over 0.75; only those over 0.9 where the risk is critical."""
    strong = signals.filter("confidence > 0.75").select("symbol", F.concat(F.lit("Signal: "), "signal").alias("opportunity"), "confidence")
    out = regime_opportunities(regimes).unionByName(strong).join(risks.select("symbol", "risk_level"), "symbol", "left")
    return out.filter((F.coalesce("risk_level", F.lit("medium")) != "critical") | (F.col("confidence") > 0.9)).drop("risk_level")


def actions(df: DataFrame) -> DataFrame:
    """symbol, action, priority of rows with regime, risk_level and support."""
    high = F.col("risk_level").isin("high", "critical")
    item = lambda c, a, p: F.when(c, F.struct(a.alias("action"), F.lit(p).alias("priority")))
    monitor = F.concat(F.lit("Monitor Support at $"), F.format_number(F.coalesce("support", F.lit(0.0)), 0))
    arr = F.array_compact(
        F.array(
            item(high, F.lit("Tighten Stop Losses"), "critical"),
            item(high, F.lit("Reduce Position Size"), "high"),
            item(F.col("regime") == "bull", F.lit("Accumulate Spot"), "high"),
            item(F.col("regime") == "bear", F.lit("Preserve Capital / Hedge"), "high"),
            item(F.lit(True), monitor, "medium"),
        )
    )
    return df.select("symbol", F.explode(arr).alias("_a")).select("symbol", "_a.action", "_a.priority")


#: What critiques are searched for, the pattern that it shows, and the instruction proposed against it: fixed values.
PATTERNS = {
    "RSI_misinterpretation": (["RSI"], "INJECTION: 'When trending, RSI overbought is NOT a sell signal. Look for divergence.'"),
    "FOMO_behavior": (["chase pumps", "FOMO"], "INJECTION: 'Do NOT buy widely publicized pumps. Wait for 30% pullback.'"),
    "risk_violation": (["leverage"], "INJECTION: 'Strictly enforce 2% stop loss on all leverage trades.'"),
}


def critique_patterns(critiques: DataFrame, by: str, text: str = "critique") -> DataFrame:
    """by, status, pattern, frequency, proposal: the pattern that most critiques of a group show (ties in the order of the table), a critique counting once for each pattern; a group without any says so."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(text), w)), F.lit(False)), F.lit(i)) for i, (words, _) in enumerate(PATTERNS.values())]))
    rows = critiques.select(by, F.explode_outer(found).alias("_i")).groupBy(by, "_i").agg(F.count(F.lit(1)).alias("_n"))
    best = rows.groupBy(by).agg(F.max(F.when(F.col("_i").isNotNull(), F.struct("_n", (-F.col("_i")).alias("_i")))).alias("_b"))
    name, proposal = F.array(*map(F.lit, PATTERNS)), F.array(*[F.lit(p) for _, p in PATTERNS.values()])
    at = -F.col("_b._i")
    status = F.when(F.col("_b").isNull(), "No systemic patterns found").otherwise("Optimization Proposal Generated")
    return best.select(by, status.alias("status"), F.get(name, at).alias("pattern"), F.col("_b._n").alias("frequency"), F.get(proposal, at).alias("proposal"))
