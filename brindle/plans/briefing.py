"""Queries of briefings, decision logs, small scalars and files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import scalars
from brindle.functions.rolling import change, last_row
from brindle.operators import briefing, decisions, regimes, zones
from brindle.plans import relational, windows  # noqa: F401  (their SQL is used below)
from brindle.plans.domain import _zones
from brindle.plans.registry import ORACLES, QUERIES, R, register, sql
from brindle.sources import readers, sinks
from brindle.sources.tables import shared_folder
from brindle.sources.views import Market


def _query(name: str, m: Market) -> DataFrame:
    return QUERIES[name](m.spark, m.path)


# ---- regimes in words

# the texts stand in the SQL a second time, so that a changed table fails
_I = """('bull_trending', 'Focus on momentum continuation. RSI > 50 is a support zone. Ignore minor bearish divergences.', 'Max size 5%. Acceptable drawdown 10%.'),
('bear_trending', 'Oversold bounces are exit points. Resistance levels are hard ceilings.', 'Max size 2%. Tight stops at 3%.'),
('sideways_compression', 'Mean reversion. RSI extremes (30/70) are entry/exit targets. Squeeze play imminent.', 'Reduced sizing until breakout.'),
('high_volatility', 'Extreme unpredictability. Reduce signal weighting. Wait for volatility to contract.', 'Cash preservation mode. 1% max size.'),
('distribution', 'Smart money is exiting. Watch for lower highs. Bull trap risk is extreme.', 'Hedge positions. Trailing stops tight.')"""
register("regime_instructions", f"SELECT symbol, regime, a AS synthesizer, b AS risk_rule FROM ({ORACLES['regime_detector']}) LEFT JOIN (VALUES {_I}) t(r, a, b) ON r = regime")(
    lambda m: briefing.instructions(regimes.detect(m.bars())).select("symbol", "regime", "synthesizer", "risk_rule")
)
_C = """('bull', 'Sustained uptrend; Higher highs/lows; Strong momentum', 'Expect trend continuation with pullbacks to support'),
('bear', 'Sustained downtrend; Lower highs/lows; Weak momentum', 'Expect trend continuation with bounces to resistance'),
('sideways', 'Range-bound; Lack of directional conviction; Mean reversion', 'Expect range-bound trading between support/resistance')"""
register("regime_characteristics", f"SELECT symbol, regime, coalesce(a, '') AS traits, coalesce(b, 'Monitor for regime change') AS expected FROM ({ORACLES['regime_rules']}) LEFT JOIN (VALUES {_C}) t(r, a, b) ON r = regime")(
    lambda m: briefing.characteristics(_query("regime_rules", m)).select("symbol", "regime", F.array_join("traits", "; ").alias("traits"), "expected")
)
register("regime_from_history", f"SELECT symbol, coalesce(regime, 'sideways') AS regime FROM (SELECT DISTINCT event_type AS symbol FROM events UNION SELECT DISTINCT c_mktsegment FROM customer) LEFT JOIN ({ORACLES['regime_detector']}) USING (symbol)")(
    lambda m: regimes.from_history(m.bars().orderBy(F.rand(3)), m.table("events").select(F.col("event_type").alias("symbol")).unionByName(m.table("customer").select(F.col("c_mktsegment").alias("symbol"))))
)

# ---- bias and guidance


def _context(m: Market) -> DataFrame:
    seven = last_row(m.bars().withColumn("return_7d", F.round(change("close", 7) * 100, 6))).select("symbol", "close", F.coalesce("return_7d", F.lit(0.0)).alias("return_7d"))
    flow = _query("sentiment_indicators", m).select("symbol", "volatility_class", "net_flow_7d")
    return _query("regime_rules", m).select("symbol", "regime").join(seven, "symbol").join(flow, "symbol")


_CTX = f"""rr AS ({ORACLES['regime_rules']}), si AS ({ORACLES['sentiment_indicators']}),
sv AS (SELECT symbol, arg_max(close, ts) AS close, coalesce(round((arg_max(close, ts) / nullif(arg_max(l7, ts), 0) - 1) * 100, 6), 0) AS return_7d FROM (SELECT *, lag(close, 7) OVER (PARTITION BY symbol ORDER BY ts) AS l7 FROM bars) GROUP BY 1),
cx AS (SELECT rr.symbol, rr.regime, sv.close, sv.return_7d, si.volatility_class, si.net_flow_7d FROM rr JOIN sv USING (symbol) JOIN si USING (symbol)),
cn AS (SELECT *, CAST(regime IN ('bull', 'accumulation') AS INT) + CAST(return_7d > 0 AS INT) + CAST(net_flow_7d > 0 AS INT) AS n_bull, CAST(regime IN ('bear', 'distribution') AS INT) + CAST(return_7d < 0 AS INT) + CAST(net_flow_7d < 0 AS INT) AS n_bear FROM cx)"""
register(
    "net_bias",
    sql("SELECT symbol, n_bull, n_bear, CAST(volatility_class IN ('normal', 'low') AS INT) AS n_neutral, CASE WHEN n_bull > n_bear + 1 THEN 'bullish' WHEN n_bear > n_bull + 1 THEN 'bearish' ELSE 'neutral' END AS net_bias FROM cn", "bars", ctes=_CTX),
)(lambda m: briefing.bias(_context(m)).select("symbol", F.size("bullish").alias("n_bull"), F.size("bearish").alias("n_bear"), F.size("neutral").alias("n_neutral"), "net_bias"))


def _guided(m: Market) -> DataFrame:
    levels_ = _query("support_resistance", m).select("symbol", "support")
    level = F.when(F.col("risk_score") > 0.7, "high").when(F.col("risk_score") < 0.3, "low").otherwise("medium")
    risks = _query("risk_assessment", m).select("symbol", "risk_score", level.alias("risk_level"))
    return _context(m).join(levels_, "symbol", "left").join(risks, "symbol")


register(
    "trade_guidance",
    sql(
        f"""SELECT symbol, CASE WHEN risk_score > 0.7 THEN 'Reduce position sizes to 25-50% of normal' WHEN risk_score > 0.5 THEN 'Moderate position sizes at 50-75% of normal' ELSE 'Normal position sizing appropriate' END AS sizing,
        CASE WHEN regime IN ('bull', 'bear') AND volatility_class <> 'extreme' THEN 'swing_trading_3-10_days' WHEN volatility_class = 'extreme' THEN 'intraday_scalping' ELSE 'position_trading_10-30_days' END AS horizon,
        CASE regime WHEN 'bull' THEN 'Buy dips to support levels' WHEN 'bear' THEN 'Sell bounces to resistance levels' END AS timing, {R('(close - support) / close * 100')} AS stop_distance_pct
        FROM cx LEFT JOIN (SELECT symbol, support FROM ({ORACLES['support_resistance']})) USING (symbol) JOIN (SELECT symbol, risk_score FROM ({ORACLES['risk_assessment']})) USING (symbol)""",
        "bars",
        ctes=_CTX,
    ),
)(lambda m: briefing.guidance(_guided(m)).select("symbol", "sizing", "horizon", "timing", F.round("stop_distance_pct", 6).alias("stop_distance_pct")))
register(
    "executive_summary",
    sql(
        f"""SELECT symbol, printf('%s is in a %s regime; the factors lean %s and risk is %s.', symbol, regime, CASE WHEN n_bull > n_bear + 1 THEN 'bullish' WHEN n_bear > n_bull + 1 THEN 'bearish' ELSE 'neutral' END, risk_level) AS summary
        FROM cn JOIN (SELECT symbol, CASE WHEN risk_score > 0.7 THEN 'high' WHEN risk_score < 0.3 THEN 'low' ELSE 'medium' END AS risk_level FROM ({ORACLES['risk_assessment']})) USING (symbol)""",
        "bars",
        ctes=_CTX,
    ),
)(lambda m: briefing.executive_summary(briefing.bias(_guided(m))))
register(
    "reasoning_workflow",
    sql(
        f"""SELECT symbol, CASE WHEN risk_level IN ('high', 'critical') THEN 'risk_assessment' WHEN abs(n_bull - n_bear) <= 1 THEN 'comprehensive_analysis' ELSE 'technical_only' END AS workflow, n_bull > 0 AND n_bear > 0 AS disagree
        FROM cn JOIN (SELECT symbol, CASE WHEN risk_score > 0.7 THEN 'high' WHEN risk_score < 0.3 THEN 'low' ELSE 'medium' END AS risk_level FROM ({ORACLES['risk_assessment']})) USING (symbol)""",
        "bars",
        ctes=_CTX,
    ),
)(lambda m: briefing.reasoning(briefing.bias(_guided(m)).withColumn("confidence", F.lit(1.0))).select("symbol", "graph.workflow", F.array_contains("graph.uncertainties", "Factors disagree").alias("disagree")))
register(
    "daily_summary",
    sql(
        f"""SELECT date, count(*) AS n_symbols, sum(v) AS volume, count(*) FILTER (WHERE r > 0) AS gainers, count(*) FILTER (WHERE r < 0) AS losers, arg_max(symbol, (r, symbol)) AS best, arg_min(symbol, (r, symbol)) AS worst
        FROM (SELECT CAST(ts AS DATE) AS date, symbol, sum(volume) AS v, arg_max(close, ts) / nullif(arg_min(open, ts), 0) - 1 AS r FROM bars GROUP BY 1, 2) GROUP BY date""",
        "bars",
    ),
)(lambda m: briefing.daily_summary(m.bars()))
register(
    "validation_report",
    "SELECT source, count(*) AS n, count(text) AS n_passed, (round(count(text) / count(*), 6) + 0.0::DOUBLE) AS pass_rate, CASE WHEN count(text) / count(*) >= 0.95 THEN 'healthy' WHEN count(text) / count(*) >= 0.8 THEN 'degraded' ELSE 'failing' END AS status FROM documents GROUP BY source",
)(lambda m: briefing.validation_report(m.table("documents").select("source", "text"), ["text"], "source").withColumn("pass_rate", F.round("pass_rate", 6)))
register("price_validator", "SELECT event_id, value IS NOT NULL AS passed, CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS score FROM events")(
    lambda m: briefing.validated(m.table("events").select("event_id", F.col("value").alias("price")), ["price"]).select("event_id", "passed", "score")
)
register("zone_export")(lambda m: zones.exported(_zones(m)))

# ---- decision log


def _decision_log(m: Market) -> DataFrame:
    """Orders are decisions; what was shipped for them is their outcome."""
    empty = m.spark.createDataFrame([], "id long, made_at timestamp_ntz, context string, outcome double, reflection string")
    made = m.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("made_at"), "o_orderpriority")
    outcomes = m.table("lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at")).agg(F.sum("l_quantity").alias("outcome")).withColumn("reflection", F.lit(None).cast("string"))
    return sinks.with_outcomes(sinks.appended(empty, made, ["o_orderpriority"]), outcomes)


_LOG = "u AS (SELECT l_orderkey AS id, l_shipdate AS shipped, CAST(sum(l_quantity) AS DOUBLE) AS outcome FROM lineitem GROUP BY 1, 2), g AS (SELECT o_orderkey AS id, json_extract_string(to_json({'o_orderpriority': o_orderpriority}), '$.o_orderpriority') AS priority, o.outcome FROM orders LEFT JOIN (SELECT id, arg_max(outcome, shipped) AS outcome FROM u GROUP BY 1) o ON o.id = o_orderkey)"
register("decision_log", f"WITH {_LOG} SELECT * FROM g")(lambda m: _decision_log(m).select("id", F.get_json_object("context", "$.o_orderpriority").alias("priority"), F.col("outcome").cast("double").alias("outcome")))
register("daily_reflection", f"WITH {_LOG} SELECT id, CASE WHEN abs(outcome / 10 - 2.5) < 0.5 THEN 'noise' WHEN outcome / 10 - 2.5 < -1 THEN 'wrong_direction' ELSE 'ok' END AS critique FROM g WHERE outcome IS NOT NULL")(
    lambda m: _decision_log(m).filter("outcome is not null and reflection is null").select("id", decisions.critique(F.lit("BUY"), F.col("outcome") / 10 - 2.5).alias("critique"))
)

# ---- scalars

register("fenced_json", "SELECT o_orderkey, o_orderkey AS fenced, o_orderkey AS bare, CAST(NULL AS BIGINT) AS broken FROM orders")(
    lambda m: m.table("orders").select("o_orderkey", *[scalars.fenced_json(F.format_string(t, "o_orderkey"), "k long")["k"].alias(n) for n, t in (("fenced", '```json\n{"k": %d}\n```'), ("bare", '{"k": %d}'), ("broken", "k = %d"))])
)
register("base64_names", "SELECT c_custkey, to_base64(encode(c_name)) AS code FROM customer")(lambda m: m.table("customer").select("c_custkey", scalars.encoded(F.encode("c_name", "UTF-8")).alias("code")))
register("instant_parse", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 5 HOUR AS iso, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, CAST(NULL AS TIMESTAMP) AS bad FROM orders")(
    lambda m: m.table("orders").select("o_orderkey", scalars.parse_instant(F.date_format("o_orderdate", "yyyy-MM-dd'T05:00:00Z'")).alias("iso"), scalars.parse_instant(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), scalars.parse_instant(F.lit("soon")).alias("bad"))
)
register("order_ids", "SELECT o_orderkey, 36 AS id_length, true AS valid, CAST(1 AS BIGINT) AS n_same FROM orders")(
    lambda m: m.table("orders").select("o_orderkey", F.uuid().alias("id")).select("o_orderkey", F.length("id").alias("id_length"), F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("valid"), F.count(F.lit(1)).over(Window.partitionBy("id")).alias("n_same"))
)
register("pair_base", "SELECT DISTINCT event_type AS base FROM events")(lambda m: m.table("events").select(scalars.pair_base(F.concat("event_type", F.lit("USDT"))).alias("base")).distinct())

# ---- files


def _csv(m: Market) -> DataFrame:
    path = f"{shared_folder(m.spark)}/csv-{uuid.uuid4().hex}"
    nation = m.table("nation")
    sinks.write_csv(nation, path)
    return m.spark.read.option("header", True).schema(nation.schema).csv(path).select("n_nationkey", "n_name", "n_regionkey")


register("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(_csv)
register("split_rows", "SELECT '[' || n_nationkey || ',\"' || n_name || '\",' || n_regionkey || ']' AS data FROM nation")(lambda m: sinks.split_rows(m.table("nation").select("n_nationkey", "n_name", "n_regionkey")))
_RULES = [{"name": "title", "strategy": "label_regex", "pattern": "<title>([^<]*)</title>"}, {"name": "is_article", "strategy": "text_block_contains", "words": ["<article", "<p"]}]
register("adapter_rules", "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, contains(html, '<article') AND contains(html, '<p') AS is_article FROM pages")(
    lambda m: readers.extracted(m.table("pages").select("page_id", "html"), json.loads(json.dumps(_RULES)), "html").select("page_id", "title", "is_article")
)

# ---- what is put together from queries that have SQL

ORACLES["market_context"] = f"""SELECT symbol, regime, CASE WHEN risk_score > 0.7 THEN 'high' WHEN risk_score < 0.3 THEN 'low' ELSE 'medium' END AS risk_level, coalesce(n, 0) AS n_signals, position
FROM (SELECT symbol, regime FROM ({ORACLES['regime_rules']})) JOIN (SELECT symbol, risk_score FROM ({ORACLES['risk_assessment']})) USING (symbol)
JOIN (SELECT symbol, position FROM ({ORACLES['history_compare']})) USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS n FROM ({ORACLES['signals_library']}) GROUP BY 1) USING (symbol)"""
ORACLES["flash_outlook"] = sql(
    f"SELECT symbol, ts, (round(rsi_14, 4) + 0.0::DOUBLE) AS rsi_14, {R('r')} AS r FROM (SELECT symbol, ts, close / nullif(lag(close) OVER w, 0) - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) JOIN (SELECT symbol, ts, rsi_14 FROM ({ORACLES['rsi_14']})) USING (symbol, ts) WHERE k <= 3",
    "bars",
)
_FACTORS = ["factor_historical_sr", "factor_swing", "factor_fibonacci", "factor_ma", "factor_round", "factor_pivot", "factor_gap"]
_UNION = " UNION ALL ".join(f"SELECT '{n}' AS factor_type, symbol, price, strength FROM ({ORACLES[n]})" for n in _FACTORS)


def _union(m: Market) -> DataFrame:
    parts = [_query(n, m).select(F.lit(n).alias("factor_type"), "symbol", "price", "strength") for n in _FACTORS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


register("factor_union", f"SELECT factor_type, symbol, count(*) AS n, (round(avg(strength), 4) + 0.0::DOUBLE) AS strength, (round(max(price), 4) + 0.0::DOUBLE) AS highest FROM ({_UNION}) GROUP BY 1, 2")(
    lambda m: _union(m).groupBy("factor_type", "symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("strength"), 4).alias("strength"), F.round(F.max("price"), 4).alias("highest"))
)
