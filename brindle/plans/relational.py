"""Projections, joins, aggregations, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import scalars
from brindle.operators import evaluation, flows, levels, onchain, quality, resample
from brindle.plans.registry import R, register, sql
from brindle.sources import readers, sinks
from brindle.sources.views import Market


def _rr(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# ---- normalising and filtering

register("price_dedupe", sql(f"SELECT date, {R('open')} AS open, {R('close')} AS close FROM (SELECT CAST(ts AS DATE) AS date, *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, symbol) AS k FROM bars) WHERE k = 1", "bars"))(
    lambda m: _rr(_dedupe(m), open=6, close=6)
)


def _dedupe(m: Market) -> DataFrame:
    raw = m.bars().select(F.to_date("ts").cast("string").alias("Date"), F.col("open").alias("OPEN"), F.col("close").alias("Close"), F.concat(F.col("ts").cast("string"), "symbol").alias("Ordinal"))
    return flows.normalize_prices(raw, ordinal="Ordinal")


register(
    "flow_pivot",
    sql("SELECT date, ticker, " + ", ".join(f"{R(f'''avg(value) FILTER (WHERE field = '{f}')''', 4)} AS {f.lower()}_value" for f in "FOP") + " FROM flow_long GROUP BY 1, 2", "flow_long"),
)(lambda m: flows.pivot_flows(m.flow_long(), ["F", "O", "P"]).select("date", "ticker", *[F.round(f, 4).alias(f"{f.lower()}_value") for f in "FOP"]))
register(
    "flow_delta",
    sql(f"SELECT date, ticker, field, {R('coalesce(value - lag(value) OVER (PARTITION BY ticker, field ORDER BY date), 0)', 2)} AS delta FROM s", "flow_long", ctes="s AS (SELECT date, ticker, field, sum(value) AS value FROM flow_long GROUP BY ALL)"),
)(lambda m: _rr(flows.flow_delta(m.flow_long().groupBy("date", "ticker", "field").agg(F.sum("value").alias("value"))).drop("value"), delta=2))
register("macro_pct_change", sql(f"SELECT date, asset_id, {R('price', 4)} AS price, {R('coalesce((price / nullif(lag(price) OVER (PARTITION BY asset_id ORDER BY date), 0) - 1) * 100, 0)', 4)} AS change_pct FROM macro", "macro"))(
    lambda m: _rr(flows.normalize_macro(m.macro()), price=4, change_pct=4)
)
register("date_range_filter", sql(f"SELECT date, ticker, {R('flow_usd', 2)} AS flow_usd FROM flows WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' AND ticker = '1-URGENT'", "flows"))(
    lambda m: _rr(flows.select_flows(m.flows(), "1996-01-01", "1996-03-31", "1-urgent"), flow_usd=2)
)
register("lookback_filter", sql(f"SELECT symbol, ts, {R('close')} AS close FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 3 DAY", "bars"))(lambda m: _lookback(m.bars()))


def _lookback(bars: DataFrame) -> DataFrame:
    last = bars.agg(F.max("ts").alias("_end"))
    return bars.join(F.broadcast(last), F.col("ts") >= F.col("_end") - F.expr("interval 3 days")).select("symbol", "ts", F.round("close", 6).alias("close"))  # one row


register("latest_on_or_before", sql(f"SELECT symbol, {R('arg_max(close, ts)')} AS close FROM bars WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY symbol", "bars"))(
    lambda m: m.bars().filter(F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).groupBy("symbol").agg(F.round(F.max_by("close", "ts"), 6).alias("close"))
)
register("null_drop", sql("SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM (SELECT symbol, lag(close, 3) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) WHERE p IS NOT NULL GROUP BY symbol", "bars"))(
    lambda m: m.bars().withColumn("p", F.lag("close", 3).over(Window.partitionBy("symbol").orderBy("ts"))).dropna(subset=["p"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
)
register(
    "human_number_parse",
    """SELECT p_partkey, round(p_retailprice * 1000, 4) + 0.0::DOUBLE AS k_value, round(p_retailprice * 1e9, 0) + 0.0::DOUBLE AS b_value, 0.0::DOUBLE AS bad_value, round(p_retailprice, 4) + 0.0::DOUBLE AS pct_value FROM part""",
)(lambda m: _numbers(m))


def _numbers(m: Market) -> DataFrame:
    t = F.format_string("%.2f", "p_retailprice")
    p = scalars.parse_number
    return m.table("part").select("p_partkey", F.round(p(F.concat(t, F.lit("k"))), 4).alias("k_value"), F.round(p(F.concat(F.lit("$"), t, F.lit("B"))), 0).alias("b_value"), p(F.lit("n/a")).alias("bad_value"), F.round(p(F.concat(t, F.lit("%"))), 4).alias("pct_value"))


register(
    "large_number_format",
    """SELECT o_orderkey, CASE WHEN x >= 1e9 THEN printf('$%.2fB', x / 1e9) WHEN x >= 1e6 THEN printf('$%.2fM', x / 1e6) WHEN x >= 1e3 THEN printf('$%.2fK', x / 1e3) ELSE printf('$%.2f', x) END AS text
    FROM (SELECT o_orderkey, (o_totalprice * o_totalprice / 4 + 1) * 1.000003::DOUBLE AS x FROM orders)""",
)(lambda m: m.table("orders").select("o_orderkey", scalars.large_number((F.col("o_totalprice") * F.col("o_totalprice") / 4 + 1) * 1.000003).alias("text")))
register("label_bucketize", f"SELECT c_custkey, CASE WHEN c_acctbal / 10000 >= 0.85 THEN 'critical' WHEN c_acctbal / 10000 >= 0.70 THEN 'strong' WHEN c_acctbal / 10000 >= 0.55 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN c_acctbal / 5000 - 1 > 0.6 THEN 'very_bullish' WHEN c_acctbal / 5000 - 1 > 0.2 THEN 'bullish' WHEN c_acctbal / 5000 - 1 > -0.2 THEN 'neutral' WHEN c_acctbal / 5000 - 1 > -0.6 THEN 'bearish' ELSE 'very_bearish' END AS mood FROM customer")(
    lambda m: m.table("customer").select("c_custkey", scalars.banded(F.col("c_acctbal") / 10000, scalars.STRENGTH, "weak").alias("strength"), scalars.sentiment_label(F.col("c_acctbal") / 5000 - 1).alias("mood"))
)
register("json_props", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE), -1) AS missing FROM events")(
    lambda m: m.table("events").select("event_id", readers.json_number(F.col("props"), "$.k").alias("k"), readers.json_number(F.col("props"), "$.missing", -1.0).alias("missing"))
)
register("html_extract", r"SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_items FROM pages")(lambda m: readers.page_fields(m.table("pages")))
register("cache_key_md5", "SELECT c_custkey, md5('{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}') AS key FROM customer")(
    lambda m: m.table("customer").select("c_custkey", scalars.cache_key(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))).alias("key"))
)
register("day_parse", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS dmy, CAST(NULL AS DATE) AS bad FROM orders")(
    lambda m: m.table("orders").select("o_orderkey", scalars.parse_day(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso"), scalars.parse_day(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("dmy"), scalars.parse_day(F.lit("soon")).alias("bad"))
)

# ---- joins

_PRICE = "p AS (SELECT CAST(ts AS DATE) AS date, avg(close) AS close FROM bars GROUP BY 1), f AS (SELECT date + 10440 AS date, ticker, flow_usd FROM flows)"
register("price_with_flows", sql(f"SELECT p.date, ticker, {R('close')} AS close, {R('flow_usd', 2)} AS flow_usd FROM p LEFT JOIN f USING (date)", "bars", "flows", ctes=_PRICE))(lambda m: _price_flows(m))


def _price_flows(m: Market) -> DataFrame:
    price = m.bars().groupBy(F.to_date("ts").alias("date")).agg(F.avg("close").alias("close"))
    shifted = m.flows().withColumn("date", F.date_add("date", 10440))
    return _rr(price.join(shifted, "date", "left").select("date", "ticker", "close", "flow_usd"), close=6, flow_usd=2)


register("asof_backward", sql(f"SELECT p.ts, direction, {R('b.close')} AS asof_close FROM predictions p ASOF LEFT JOIN (SELECT ts, close FROM bars_1h) b ON p.ts >= b.ts", "predictions", "bars_1h"))(
    lambda m: evaluation.asof(m.predictions(), m.bars_1h(), "close").select("ts", "direction", F.round("asof_close", 6).alias("asof_close"))
)
register("asof_forward", sql(f"SELECT p.ts, direction, {R('b.close')} AS next_close FROM predictions p ASOF LEFT JOIN (SELECT ts, close FROM bars_1h) b ON p.ts < b.ts", "predictions", "bars_1h"))(
    lambda m: evaluation.asof(m.predictions(), m.bars_1h(), "close", direction="forward").select("ts", "direction", F.round("next_close", 6).alias("next_close"))
)
_EVAL = f"""e AS (SELECT p.*, a.close AS cur, n.close AS nxt FROM predictions p ASOF JOIN bars_1h a ON p.ts >= a.ts ASOF JOIN bars_1h n ON p.ts < n.ts)"""
register(
    "prediction_eval",
    sql(
        f"SELECT CAST(count(*) AS BIGINT) AS n, {R('avg(CASE WHEN direction = (CASE WHEN nxt > cur THEN ' + chr(39) + 'BULLISH' + chr(39) + ' ELSE ' + chr(39) + 'BEARISH' + chr(39) + ' END) THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy, {R('sqrt(avg((price_target - nxt) * (price_target - nxt)))')} AS rmse, {R('avg(CASE WHEN direction = ' + chr(39) + 'BULLISH' + chr(39) + ' THEN (nxt - cur) / cur ELSE -(nxt - cur) / cur END) * 100')} AS mean_edge_pct FROM e",
        "predictions",
        "bars_1h",
        ctes=_EVAL,
    ),
)(lambda m: _rr(evaluation.summarize_predictions(evaluation.evaluate_predictions(m.predictions(), m.bars_1h())), accuracy=6, rmse=6, mean_edge_pct=6))
register(
    "touch_counts",
    sql(f"SELECT l.symbol, {R('l.price')} AS price, CAST(count(*) FILTER (WHERE b.high BETWEEN l.price * 0.99::DOUBLE AND l.price * 1.01::DOUBLE OR b.low BETWEEN l.price * 0.99::DOUBLE AND l.price * 1.01::DOUBLE) AS BIGINT) AS touches FROM l JOIN bars b USING (symbol) GROUP BY l.symbol, l.price", "bars", "bars_1d", ctes="l AS (SELECT DISTINCT symbol, high AS price FROM bars_1d)"),
)(lambda m: _rr(levels.touches(m.bars_1d().select("symbol", F.col("high").alias("price")).distinct(), m.bars()), price=6))
register("whale_lookup", sql("SELECT tx, CASE WHEN min(address) <= 20 THEN 'exchange_' || max(address) FILTER (WHERE address <= 20) ELSE 'unknown' END AS label FROM outputs GROUP BY tx", "outputs"))(
    lambda m: onchain.whale_movements(m.outputs(), _labels(m), 0.0).select("tx", "label")
)


def _labels(m: Market) -> DataFrame:
    return m.table("supplier").filter("s_suppkey <= 20").select(F.col("s_suppkey").alias("address"), F.concat(F.lit("exchange_"), F.col("s_suppkey").cast("string")).alias("label"))


register(
    "whale_movements",
    sql(f"SELECT tx, {R('size', 2)} AS size, n_outputs, CASE WHEN size / 3000 > 5000 THEN 'critical' WHEN size / 3000 > 1000 THEN 'high' WHEN size / 3000 > 100 THEN 'medium' ELSE 'low' END AS alert FROM (SELECT tx, sum(value) AS size, CAST(count(*) AS BIGINT) AS n_outputs FROM outputs GROUP BY tx) WHERE size >= 300000", "outputs"),
)(lambda m: _rr(onchain.whale_movements(m.outputs(), None, 300000.0).select("tx", "size", "n_outputs", "alert"), size=2))
register("exchange_netflow", sql(f"SELECT address, {R('sum(CASE WHEN l % 2 = 0 THEN value ELSE -value END)', 2)} AS net FROM (SELECT l_suppkey AS address, l_extendedprice AS value, l_linenumber AS l FROM lineitem) WHERE address IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1"))(
    lambda m: _rr(_netflow(m), net=2)
)


def _netflow(m: Market) -> DataFrame:
    lines = m.table("lineitem").select(F.col("l_suppkey").alias("address"), F.col("l_extendedprice").alias("value"), "l_linenumber")
    known = m.table("supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("address"))
    return onchain.net_flow(lines.filter("l_linenumber % 2 = 0"), lines.filter("l_linenumber % 2 <> 0"), known)


register("missing_dates", sql(f"SELECT date FROM (SELECT CAST(unnest(generate_series((SELECT min(ts) FROM g), (SELECT max(ts) FROM g), INTERVAL 1 DAY)) AS DATE) AS date) WHERE date NOT IN (SELECT ts FROM g)", "daily_flow", ctes="g AS (SELECT ts FROM daily_flow)"))(
    lambda m: resample.missing_dates(m.daily_flow().select(F.col("ts").alias("date")))
)
register("missing_dates_last_30", sql(f"SELECT date FROM (SELECT CAST(unnest(generate_series((SELECT max(ts) FROM g) - INTERVAL 30 DAY, (SELECT max(ts) FROM g), INTERVAL 1 DAY)) AS DATE) AS date) WHERE date NOT IN (SELECT ts FROM g)", "daily_flow", ctes="g AS (SELECT ts FROM daily_flow)"))(
    lambda m: resample.missing_dates(m.daily_flow().select(F.col("ts").alias("date")), lookback_days=30)
)
register("missing_bars_15m", sql("SELECT symbol, ts FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) AS ts FROM bars_15m GROUP BY symbol) ANTI JOIN bars_15m USING (symbol, ts)", "bars_15m"))(
    lambda m: resample.missing_bars(m.bars("15m"), "15m")
)
register("distance_to_price", sql(f"SELECT symbol, {R('p')} AS price, {R('(p - c) / c * 100')} AS distance_pct FROM (SELECT DISTINCT symbol, high AS p FROM bars_1d) JOIN (SELECT symbol, arg_max(close, ts) AS c FROM bars GROUP BY symbol) USING (symbol)", "bars", "bars_1d"))(
    lambda m: _distance(m)
)


def _distance(m: Market) -> DataFrame:
    df = m.bars_1d().select("symbol", F.col("high").alias("price")).distinct().join(levels.current(m.bars()), "symbol")
    return df.select("symbol", F.round("price", 6).alias("price"), F.round((F.col("price") - F.col("cur")) / F.col("cur") * 100, 6).alias("distance_pct"))


# ---- merges

_MERGE = """o AS (SELECT o_orderkey AS k, o_orderdate AS d, o_totalprice AS v, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey AS k, o_orderdate AS d, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice * 2 END AS v, 'N' AS s FROM orders WHERE o_orderkey % 2 = 0)"""


def _sides(m: Market) -> tuple[DataFrame, DataFrame]:
    """Two versions of the orders: some keys only in the old one, some only in the new one, some in both; a few new values are null."""
    orders = m.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))
    new = orders.filter("k % 2 = 0").withColumns({"v": F.when(F.col("k") % 7 != 0, F.col("v") * 2), "s": F.lit("N")})
    return orders.filter("k % 3 <> 0"), new


_BOTH = "SELECT k, {} FROM o FULL JOIN n USING (k)"
_WHOLE = ", ".join(f"CASE WHEN {{0}}.s IS NOT NULL THEN {{0}}.{c} ELSE {{1}}.{c} END AS {c}" for c in "dvs")  # s is never null: it tells whether the side has the row
register("upsert_merge", sql(_BOTH.format(_WHOLE.format("n", "o")), ctes=_MERGE))(lambda m: sinks.merged(*_sides(m), ["k"]))
register("insert_only_merge", sql(_BOTH.format(_WHOLE.format("o", "n")), ctes=_MERGE))(lambda m: sinks.merged(*_sides(m), ["k"], "insert_only"))
register("update_merge", sql(_BOTH.format("CASE WHEN o.s IS NOT NULL THEN o.d ELSE n.d END AS d, coalesce(n.v, o.v) AS v, CASE WHEN o.s IS NOT NULL THEN o.s ELSE n.s END AS s"), ctes=_MERGE))(
    lambda m: sinks.merged(*_sides(m), ["k"], "update", ["v"])
)
register("priority_union", sql(_BOTH.format(_WHOLE.format("n", "o")), ctes=_MERGE))(lambda m: sinks.by_priority(list(_sides(m)), ["k"]))
register("latest_per_key", "SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")(lambda m: quality.latest_per_key(m.table("conversations"), ["conv_id"], ["turn"]).select("conv_id", "role", "turn"))

# ---- aggregation, sorting, sets

register("daily_net_flow", sql(f"SELECT date, {R('sum(flow_usd)', 2)} AS net_flow FROM flows GROUP BY date", "flows"))(lambda m: m.flows().groupBy("date").agg(F.round(F.sum("flow_usd"), 2).alias("net_flow")))
register("top3_inflows", sql(f"SELECT ticker, {R('sum(flow_usd)', 2)} AS total FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", "flows"))(lambda m: _rr(flows.top_flows(m.flows()), total=2))
register("bottom3_outflows", sql(f"SELECT ticker, {R('sum(flow_usd)', 2)} AS total FROM flows GROUP BY 1 ORDER BY 2, 1 LIMIT 3", "flows"))(lambda m: _rr(flows.top_flows(m.flows(), largest=False), total=2))
register("last_n_rows", sql(f"SELECT ts, {R('close')} AS close FROM bars_1h ORDER BY ts DESC LIMIT 25", "bars_1h"))(lambda m: sinks.last_rows(m.bars_1h(), 25).select("ts", F.round("close", 6).alias("close")))
register("union_sides", sql("SELECT snapshot, 'bid' AS side, count(*) AS n FROM book WHERE side = 'bid' GROUP BY 1 UNION ALL SELECT snapshot, 'ask', count(*) FROM book WHERE side = 'ask' GROUP BY 1", "book"))(lambda m: _union_sides(m))


def _union_sides(m: Market) -> DataFrame:
    book = m.book()
    part = lambda s: book.filter(F.col("side") == s).groupBy("snapshot").agg(F.count(F.lit(1)).alias("n")).select("snapshot", F.lit(s).alias("side"), "n")
    return part("bid").unionByName(part("ask"))


register("common_dates", sql("SELECT CAST(o_orderdate AS DATE) AS date FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem"))(
    lambda m: m.table("orders").select(F.to_date("o_orderdate").alias("date")).intersect(m.table("lineitem").select(F.to_date("l_shipdate").alias("date")))
)
register("dates_without_orders", "SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders")(
    lambda m: m.table("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().exceptAll(m.table("orders").select(F.to_date("o_orderdate").alias("date")).distinct())
)
register(
    "date_divergence",
    """WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT (SELECT count(*) FROM a JOIN b USING (date)) AS common, (SELECT count(*) FROM a ANTI JOIN b USING (date)) AS only_a, CAST(abs((SELECT max(date) FROM a) - (SELECT max(date) FROM b)) AS INTEGER) AS divergence_days, true AS overlap""",
)(lambda m: flows.date_overlap(m.table("orders").select(F.to_date("o_orderdate").alias("date")), m.table("lineitem").select(F.to_date("l_shipdate").alias("date"))))
register("distinct_types", sql(f"SELECT symbol, {R('count(DISTINCT dayofweek(ts)) / 10.0::DOUBLE')} AS diversity FROM bars GROUP BY symbol", "bars"))(
    lambda m: m.bars().groupBy("symbol").agg(F.round(F.count_distinct(F.dayofweek("ts")) / 10, 6).alias("diversity"))
)
register("issue_mode", "SELECT role AS issue, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")(
    lambda m: m.table("conversations").groupBy(F.col("role").alias("issue")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "issue").limit(1)
)
register("conversation_log", "SELECT conv_id, string_agg(role, ' > ' ORDER BY turn) AS log FROM conversations GROUP BY conv_id")(
    lambda m: m.table("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), " > ").alias("log"))
)
register("last_user_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user') WHERE k <= 3")(
    lambda m: m.table("conversations").filter("role = 'user'").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))).filter("k <= 3").select("conv_id", "turn")
)
register("open_turns", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user') AND NOT bool_or(role = 'assistant')")(
    lambda m: m.table("conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "user").alias("u"), F.bool_or(F.col("role") == "assistant").alias("a")).filter("u and not a").select("conv_id")
)
register(
    "session_activity",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) + 0.0::DOUBLE AS value FROM s GROUP BY user_id, sid""",
)(lambda m: m.table("events").groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select("user_id", F.col("s.start").alias("start"), "n", "value"))

# ---- quality

register(
    "outlier_flags",
    sql("SELECT symbol, ts, " + R("abs(volume - m) / nullif(s, 0)") + " AS z, coalesce(abs(volume - m) / nullif(s, 0) > 3, false) AS outlier FROM bars JOIN (SELECT symbol, avg(volume) AS m, stddev_samp(volume) AS s FROM bars GROUP BY 1) USING (symbol)", "bars"),
)(lambda m: _rr(quality.outliers(m.bars(), "volume", by=["symbol"]).select("symbol", "ts", "z", "outlier"), z=6))
_COLS = ["event_id", "user_id", "event_type", "value"]
register(
    "column_stats",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", {R(f'avg({c})') if c != 'event_type' else 'CAST(NULL AS DOUBLE)'} AS mean FROM events" for c in _COLS),
)(lambda m: _rr(quality.column_stats(m.table("events"), _COLS), mean=6))
register("completeness", sql(f"SELECT {R('(count(a) + count(b) + count(c)) / (count(*) * 3.0::DOUBLE)')} AS completeness FROM (SELECT symbol AS a, lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS b, close AS c FROM bars)", "bars"))(
    lambda m: _rr(quality.completeness(m.bars().withColumn("b", F.lag("close", 5).over(Window.partitionBy("symbol").orderBy("ts"))), ["symbol", "b", "close"]), completeness=6)
)
register("freshness", sql(f"SELECT max(ts) AS last, {R('(epoch(TIMESTAMP ' + chr(39) + '2024-02-01' + chr(39) + ') - epoch(max(ts))) / 3600')} AS age_hours, false AS fresh FROM bars", "bars"))(
    lambda m: _rr(quality.freshness(m.bars(), "ts", "2024-02-01"), age_hours=6)
)
register("bar_constraint_violations", sql("SELECT symbol, ts FROM bars WHERE NOT (high >= low AND high >= open AND high >= close AND low <= open AND low <= close)", "bars"))(lambda m: quality.validate_bars(m.bars()).select("symbol", "ts"))
