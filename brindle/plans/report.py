"""One row a symbol that brings the analyses together, and its renderings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import levels, regimes, risk, signals


def market_context(bars: DataFrame, digits: int = -2) -> DataFrame:
    """symbol, regime, confidence, risk_level, risk_score, support, resistance, percentile, n_signals. Nothing is collected."""
    r = regimes.confidence(regimes.classify(regimes.features(bars))).select("symbol", "close", "regime", "confidence")
    out = r.join(risk.assess(bars, r).select("symbol", "risk_level", "risk_score"), "symbol")
    out = out.join(levels.support_resistance(bars, digits=digits).select("symbol", "support", "resistance"), "symbol", "left")
    out = out.join(risk.history_position(bars).select("symbol", "percentile", "position"), "symbol")
    n = signals.library_signals(bars).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_signals"))
    return out.join(n, "symbol", "left").withColumn("n_signals", F.coalesce("n_signals", F.lit(0)))


def render(context: DataFrame, symbol: str, output: str = "markdown") -> str:
    """One symbol's row as markdown or JSON."""
    row = context.filter(F.col("symbol") == symbol).first()
    if row is None:
        return ""
    d = row.asDict()
    if output == "json":
        return json.dumps(d, default=str, sort_keys=True)
    return "\n".join([f"# {symbol}", f"The market is in a **{d['regime'].upper()}** regime with {100 * d['confidence']:.0f}% confidence.", f"Risk is **{d['risk_level']}** ({d['risk_score']:.2f}).", f"Signals: {d['n_signals']}."])
