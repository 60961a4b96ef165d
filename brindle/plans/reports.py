"""Queries of the reports; their SQL holds every sentence and weight itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import briefing, decisions, intelligence, risk
from brindle.plans import domain  # noqa: F401  (registers what reports draw on)
from brindle.plans.registry import ORACLES, QUERIES, R, register, sql
from brindle.sources.views import Market


def _query(name: str, m: Market) -> DataFrame:
    return QUERIES[name](m.spark, m.path)


def _context(m: Market) -> DataFrame:
    """What narratives draw on, from queries that have SQL of their own."""
    level = F.when(F.col("risk_score") > 0.7, "high").when(F.col("risk_score") < 0.3, "low").otherwise("medium")
    risks = F.array_compact(F.array(F.when(F.col("risk_score") > 0.6, "Extreme Volatility"), F.when(F.col("regime") == "volatile", "Regime Uncertainty")))
    out = _query("regime_rules", m).join(_query("regime_duration", m).select("symbol", "duration"), "symbol").join(_query("risk_assessment", m), "symbol")
    out = out.join(_query("sentiment_indicators", m).select("symbol", "label"), "symbol").join(intelligence.strongest(_query("signals_library", m)), "symbol", "left")
    out = out.join(_query("support_resistance", m).select("symbol", "support"), "symbol", "left")
    return briefing.characteristics(out).withColumns({"risk_level": level, "risks": risks})


_CTX = f"""rr AS ({ORACLES['regime_rules']}), du AS ({ORACLES['regime_duration']}), ra AS ({ORACLES['risk_assessment']}), se AS ({ORACLES['sentiment_indicators']}), su AS ({ORACLES['support_resistance']}), si AS ({ORACLES['signals_library']}),
sg AS (SELECT symbol, count(*) AS n, arg_min(signal, (-confidence, signal)) AS signal, arg_min(direction, (-confidence, signal)) AS direction, max(confidence) AS best, avg(confidence) AS mean FROM si GROUP BY symbol),
x AS (SELECT rr.symbol, rr.regime, rr.confidence, du.duration, ra.risk_score, se.label, su.support, coalesce(sg.n, 0) AS n, sg.signal, sg.direction, sg.best, sg.mean, CASE WHEN risk_score > 0.7 THEN 'high' WHEN risk_score < 0.3 THEN 'low' ELSE 'medium' END AS level
      FROM rr JOIN du USING (symbol) JOIN ra USING (symbol) JOIN se USING (symbol) LEFT JOIN sg USING (symbol) LEFT JOIN su USING (symbol))"""
register(
    "narratives",
    f"""WITH {_CTX} SELECT symbol,
'The market is currently in a **' || upper(regime) || '** regime with ' || printf('%d', CAST(round(confidence * 100) AS BIGINT)) || '% confidence. ' || 'Sentiment is **' || replace(label, '_', ' ') || '**. ' || CASE WHEN level = 'high' THEN 'Caution is advised due to elevated risk levels. ' ELSE '' END AS summary,
'Market has been in ' || regime || ' state for approx. ' || duration || ' days. Characteristics suggest structure is ' || CASE regime WHEN 'bull' THEN 'sustained uptrend' WHEN 'bear' THEN 'sustained downtrend' WHEN 'sideways' THEN 'range-bound' ELSE 'undefined' END || '.' AS regime_text,
CASE WHEN n = 0 THEN 'No significant technical signals detected at this time.' ELSE 'Detected ' || n || ' active signals. Primary signal is **' || signal || '** (' || direction || ') with ' || printf('%d', CAST(round(best * 100) AS BIGINT)) || '% confidence.' END AS signal_text,
'Risk environment is rated **' || upper(level) || '** (Score: ' || printf('%d', CAST(round(risk_score * 100) AS BIGINT)) || '/100). Primary concerns include: ' || concat_ws(', ', CASE WHEN risk_score > 0.6 THEN 'Extreme Volatility' END, CASE WHEN regime = 'volatile' THEN 'Regime Uncertainty' END) || '.' AS risk_text FROM x""",
)(lambda m: intelligence.narratives(_context(m)))
register(
    "ranked_actions",
    f"""WITH {_CTX}, a AS (
SELECT symbol, 1 AS o, 'Tighten Stop Losses' AS action, 'critical' AS priority, 'High risk environment detect' AS rationale, 'Immediate' AS timing FROM x WHERE level IN ('high', 'critical')
UNION ALL SELECT symbol, 2, 'Reduce Position Size', 'high', 'Volatility mandates smaller sizing', 'Next rebalance' FROM x WHERE level IN ('high', 'critical')
UNION ALL SELECT symbol, 3, 'Accumulate Spot', 'high', 'Trend is bullish', 'On 4H dips' FROM x WHERE regime = 'bull'
UNION ALL SELECT symbol, 4, 'Preserve Capital / Hedge', 'high', 'Trend is bearish', 'Immediate' FROM x WHERE regime = 'bear'
UNION ALL SELECT symbol, 5, 'Monitor Support at $' || CAST(coalesce(support, 0) AS BIGINT), 'medium', 'Key structural level', 'Continuous' FROM x)
SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY o) AS INT) AS place, action, priority, rationale, timing FROM a""",
)(lambda m: intelligence.ranked_actions(_context(m)))
register(
    "overall_confidence",
    sql(
        f"SELECT symbol, {R('0.2::DOUBLE * greatest(0, 1 - (epoch(TIMESTAMP ' + chr(39) + '2024-01-31' + chr(39) + ') - epoch(last)) / 3600 / 24) + 0.15::DOUBLE + 0.25::DOUBLE * coalesce(confidence, 0.5) + 0.2::DOUBLE * coalesce(mean, 0.5) + 0.2::DOUBLE * (1 - coalesce(risk_score, 0.5))')} AS confidence FROM x JOIN (SELECT symbol, max(ts) AS last FROM bars GROUP BY symbol) USING (symbol)",
        "bars",
        ctes=_CTX,
    ),
)(lambda m: _confidence(m))


def _confidence(m: Market) -> DataFrame:
    last = m.bars().groupBy("symbol").agg(F.max("ts").alias("_last"))
    age = (F.unix_seconds(F.lit("2024-01-31").cast("timestamp")) - F.unix_seconds(F.col("_last").cast("timestamp"))) / 3600
    return _context(m).join(last, "symbol").select("symbol", F.round(risk.overall_confidence(age, F.col("confidence"), F.col("mean_confidence"), F.col("risk_score")), 6).alias("confidence"))


register(
    "reasoning_graph",
    f"""WITH {_CTX} SELECT symbol, 'Market is in ' || regime || ' regime' AS claim, CASE WHEN confidence > 0.7 THEN 'current' ELSE 'degrading' END AS validity, CASE regime WHEN 'bull' THEN 'seek_long_setups' WHEN 'bear' THEN 'seek_short_setups' WHEN 'sideways' THEN 'range_trading' END AS action,
CASE regime WHEN 'bull' THEN 'price > major_support, flows > 0' WHEN 'bear' THEN 'price < major_resistance, flows < 0' WHEN 'sideways' THEN 'support_holds, resistance_holds' END AS conditions,
round(1 - confidence, 6) + 0.0::DOUBLE AS regime_stability, round(1 - coalesce(mean, 0), 6) + 0.0::DOUBLE AS signal_reliability, 0.1::DOUBLE AS data_freshness, 0.2::DOUBLE AS divergence,
concat_ws(', ', CASE WHEN 1 - confidence > 0.3 THEN 'regime_transition_audit' END, CASE WHEN regime = 'volatile' THEN 'tail_risk_scrub' END) AS workflows, 'Is ' || regime || ' regime still valid at current price?' AS first_check FROM x""",
)(lambda m: _reasoning(m))


def _reasoning(m: Market) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    out = intelligence.reasoning(_context(m).withColumns({"trend": none("string"), "flow": none("string"), "divergence": none("double")}))
    first = F.get("claims", F.lit(0))
    return out.select(
        "symbol", first["claim"].alias("claim"), first["validity"].alias("validity"), "branch.action", F.array_join("branch.conditions", ", ").alias("conditions"),
        F.round("uncertainties.regime_stability", 6).alias("regime_stability"), F.round("uncertainties.signal_reliability", 6).alias("signal_reliability"), "uncertainties.data_freshness", F.col("uncertainties.cross_source_divergence").alias("divergence"),
        F.array_join("workflows", ", ").alias("workflows"), F.get("checks", F.lit(0)).alias("first_check"),
    )


# ---- the daily report


def _days(m: Market) -> DataFrame:
    """A day of all orders: totals are prices and turnover, what was shipped for them is the second source of the flow."""
    orders = m.table("orders").withColumn("date", F.to_date("o_orderdate"))
    place = F.struct("o_orderdate", "o_orderkey")
    price = orders.groupBy("date").agg(
        F.min_by("o_totalprice", place).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", place).alias("close"),
        (F.sum("o_totalprice") * 20000).alias("turnover"), (F.sum("o_totalprice") / 1e6).alias("net_flow"),
    )
    shipped = m.table("lineitem").join(orders.select("o_orderkey", "date"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("date").agg((F.sum("l_extendedprice") / 1e6).alias("holdings_flow"), (F.sum("l_quantity") * 1e6).alias("open_interest"))
    return price.join(shipped, "date", "left")


register(
    "daily_intelligence",
    """WITH p AS (SELECT CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, sum(o_totalprice) * 20000 AS turnover, sum(o_totalprice) / 1e6 AS f FROM orders GROUP BY 1),
s AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(l_extendedprice) / 1e6 AS h, sum(l_quantity) * 1e6 AS oi FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
x AS (SELECT *, coalesce(abs(f - coalesce(h, 0)) / nullif(abs(f), 0), 100) AS away FROM p LEFT JOIN s USING (date)),
c AS (SELECT *, CASE WHEN away < 0.05 THEN 100 WHEN away < 0.15 THEN 85 WHEN away < 0.5 THEN 50 ELSE 20 END AS confidence FROM x)
SELECT date, confidence, CASE WHEN confidence > 70 THEN 'Verified' ELSE 'Caution' END AS status, CASE WHEN close > open AND turnover > 1e10 THEN 'up busy' WHEN close > open THEN 'up quiet' ELSE 'down' END AS price_thought, coalesce(oi > 0, false) AS interest_thought,
       'CONSENSUS [' || CASE WHEN confidence > 70 THEN 'Verified' ELSE 'Caution' END || ']: ' || confidence || '% confidence.' AS verdict FROM c""",
)(lambda m: _intelligence(m))


def _intelligence(m: Market) -> DataFrame:
    out = intelligence.daily_report(_days(m))
    first = F.get("thoughts", F.lit(0))
    kind = F.when(first.contains("sustained accumulation"), "up busy").when(first.contains("potential exhaustion"), "up quiet").when(first.contains("selling pressure"), "down")
    return out.select("date", "confidence", "status", kind.alias("price_thought"), (F.size("thoughts") > 1).alias("interest_thought"), F.regexp_extract("check", "^(.*?confidence\\.)", 1).alias("verdict"))


def _summary(m: Market) -> DataFrame:
    out = intelligence.market_summary(m.bars_1d(), m.flows().withColumn("date", F.date_add("date", 10440)), "2024-01-25 12:00:00")
    names = lambda c: F.array_join(F.transform(c, lambda s: s["ticker"]), ", ")
    return out.select("symbol", *[F.round(c, 6).alias(c) for c in ("current", "change_1d", "change_7d", "volatility_7d")], F.round("net_flow_7d", 4).alias("net_flow_7d"), names("top_inflows").alias("top_inflows"), names("top_outflows").alias("top_outflows"), "freshness_hours")


register(
    "market_summary",
    sql(
        f"""SELECT symbol, {R('c1')} AS current, {R('coalesce((c1 - c2) / c2 * 100, 0)')} AS change_1d, {R('coalesce((c1 - c7) / c7 * 100, 0)')} AS change_7d, {R('vol')} AS volatility_7d, round(coalesce((SELECT sum(flow) FROM t), 0) / 1e6, 4) + 0.0::DOUBLE AS net_flow_7d,
        coalesce((SELECT string_agg(ticker, ', ' ORDER BY flow DESC, ticker) FROM (SELECT * FROM t ORDER BY flow DESC, ticker LIMIT 3)), '') AS top_inflows, coalesce((SELECT string_agg(ticker, ', ' ORDER BY flow, ticker) FROM (SELECT * FROM t ORDER BY flow, ticker LIMIT 3)), '') AS top_outflows, fresh AS freshness_hours
        FROM (SELECT symbol, max(close) FILTER (WHERE k = 1) AS c1, max(close) FILTER (WHERE k = 2) AS c2, max(close) FILTER (WHERE k = 7) AS c7, stddev_samp(close) AS vol, (epoch(TIMESTAMP '2024-01-25 12:00:00') - epoch(max(ts))) / 3600 AS fresh FROM p WHERE k <= 7 GROUP BY symbol)""",
        "bars_1d",
        "flows",
        ctes="p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars_1d WHERE ts <= TIMESTAMP '2024-01-25 12:00:00'), t AS (SELECT ticker, sum(flow_usd) AS flow FROM flows WHERE date + 10440 BETWEEN DATE '2024-01-18' AND DATE '2024-01-25' GROUP BY ticker)",
    ),
)(_summary)


def _lessons(m: Market) -> DataFrame:
    """Orders are decisions; those of large totals have a reflection."""
    o = m.table("orders")
    log = o.select("o_custkey", "o_orderkey", F.when(F.col("o_totalprice") > 150000, F.concat(F.lit("Order of "), "o_orderpriority", F.lit(" was too large"))).when(F.col("o_totalprice") > 100000, "").alias("reflection"))
    return intelligence.lessons(log, "o_custkey", "o_orderkey")


register(
    "lessons",
    """SELECT o_custkey, '*** LESSONS LEARNED (DO NOT REPEAT PAST MISTAKES) ***' || chr(10) || string_agg('- Order of ' || o_orderpriority || ' was too large', chr(10) ORDER BY o_orderkey) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_totalprice > 150000) WHERE k <= 3 GROUP BY o_custkey""",
)(_lessons)


def _patterns(m: Market) -> DataFrame:
    """Line items are critiques of their supplier: of what was returned, shipped late or discounted."""
    li = m.table("lineitem").filter("l_linestatus = 'F'")
    say = lambda test, text: F.when(test, F.lit(text))
    text = F.concat_ws(", ", say(F.col("l_returnflag") == "R", "ignored the RSI"), say(F.col("l_quantity") > 45, "tends to chase pumps"), say(F.col("l_quantity") < 3, "pure FOMO"), say(F.col("l_discount") > 0.08, "too much leverage"))
    return decisions.critique_patterns(li.filter("l_suppkey % 3 <> 0 or l_returnflag <> 'R'").select("l_suppkey", text.alias("critique")), "l_suppkey")


register(
    "critique_patterns",
    """WITH c AS (SELECT l_suppkey, l_returnflag = 'R' AS a, l_quantity > 45 OR l_quantity < 3 AS b, l_discount > 0.08 AS c FROM lineitem WHERE l_linestatus = 'F' AND (l_suppkey % 3 <> 0 OR l_returnflag <> 'R')),
n AS (SELECT l_suppkey, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE c) AS c FROM c GROUP BY 1)
SELECT l_suppkey, CASE WHEN greatest(a, b, c) = 0 THEN 'No systemic patterns found' ELSE 'Optimization Proposal Generated' END AS status,
CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'RSI_misinterpretation' WHEN b >= c THEN 'FOMO_behavior' ELSE 'risk_violation' END AS pattern, nullif(greatest(a, b, c), 0) AS frequency,
CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'INJECTION: ''When trending, RSI overbought is NOT a sell signal. Look for divergence.''' WHEN b >= c THEN 'INJECTION: ''Do NOT buy widely publicized pumps. Wait for 30% pullback.''' ELSE 'INJECTION: ''Strictly enforce 2% stop loss on all leverage trades.''' END AS proposal FROM n""",
)(_patterns)
