"""Where queries are registered, and the SQL views their checks share."""

from __future__ import annotations

from collections.abc import Callable

from brindle.sources.views import Market

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: DuckDB definitions of the views in sources/views.py.
VIEWS = {
    "bars": """SELECT event_type AS symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""",
    "bars_15m": """SELECT event_type AS symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""",
    "bars_1h": """SELECT 'ALL' AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""",
    "bars_1d": """SELECT event_type AS symbol, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""",
    "flows": """SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS ticker, sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) AS flow_usd FROM orders GROUP BY 1, 2""",
    "daily_flow": """SELECT 'ALL' AS symbol, CAST(o_orderdate AS DATE) AS ts, sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) AS net_flow FROM orders GROUP BY 2""",
    "flow_long": """SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS ticker, o_orderstatus AS field, o_totalprice AS value FROM orders""",
    "macro": """SELECT CAST(o_orderdate AS DATE) AS date, c_mktsegment AS asset_id, avg(o_totalprice) AS price FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""",
    "oi": """SELECT p_retailprice AS price, CAST(sum(p_size) AS DOUBLE) AS open_interest FROM part GROUP BY 1""",
    "quotes": """SELECT item, s_name AS source, value FROM (SELECT l_partkey AS item, l_suppkey, avg(l_extendedprice / l_quantity) AS value FROM lineitem GROUP BY 1, 2) JOIN supplier ON s_suppkey = l_suppkey""",
    "book": """SELECT CAST(l_shipdate AS DATE) AS snapshot, CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side, round_even(l_extendedprice / l_quantity / 100, 0) + 1 AS price, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2, 3""",
    "outputs": """SELECT l_orderkey AS tx, l_suppkey AS address, l_extendedprice AS value FROM lineitem""",
    "utxo": """SELECT CAST(l_shipdate AS DATE) AS time, l_quantity AS coins FROM lineitem""",
    "predictions": """SELECT ts, CASE WHEN value > 35 THEN 'BULLISH' WHEN value > 20 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction, value * 1.02::DOUBLE AS price_target FROM events WHERE event_type = 'signup'""",
}


def sql(body: str, *views: str, ctes: str = "", recursive: bool = False) -> str:
    """A statement with the named views in front; ctes are further `name AS (...)` parts."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in views]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n" if parts else ""
    return head + body.strip()


def R(x: str, n: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"(round({x}, {n}) + 0.0::DOUBLE)"


def over(n: int, agg: str, x: str = "close", by: str = "symbol", order: str = "ts") -> str:
    """A rolling aggregate that is null until n values are there."""
    frame = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {agg}({x}) {frame} END"


def register(name: str, oracle: str | None = None):
    """Registers a function of Market as a query over (spark, sf_dir)."""

    def wrap(f):
        QUERIES[name] = lambda spark, path, f=f: f(Market(spark, path))
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap
