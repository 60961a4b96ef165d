"""Queries of validation, of models kept and promoted, and of small steps between tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import scalars
from brindle.operators import flows, ml, quality
from brindle.plans.reading import _joined, _number, _row
from brindle.plans.registry import R, register, sql
from brindle.sources import readers, sinks
from brindle.sources.tables import shared_folder
from brindle.sources.views import Market

# ---- validation by rules


def _suite(m: Market) -> DataFrame:
    """The bars by the rules of prices, the line items by the default ones, and the events by rules that ask for a column they lack."""
    runs = {
        "bars": quality.validation_suite(m.bars(), "price", "ts", "2024-02-01"),
        "lineitem": quality.validation_suite(m.table("lineitem").select("l_quantity", "l_extendedprice", "l_discount"), "other"),
        "events": quality.validation_suite(m.table("events").select("value", "ts"), "strict", "ts", "2024-02-01", {"strict": {"required": ["value", "price"], "z": 2.5}}),
    }
    out = None
    for name, df in runs.items():
        df = df.select(F.lit(name).alias("dataset"), "status", "n", F.array_join("missing", ", ").alias("missing"), F.array_join(F.transform(F.array_sort(F.map_entries("outliers")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ").alias("outliers"))
        out = df if out is None else out.unionByName(df)
    return out


def _beyond(table: str, columns: list[str], z: float) -> str:
    """Column and number of values beyond z deviations, joined."""
    each = " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) FILTER (WHERE abs({c} - m) / nullif(s, 0) > {z}) AS k FROM {table}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {table})" for c in sorted(columns))
    return f"(SELECT coalesce(string_agg(c || ':' || k, ', ' ORDER BY c), '') FROM ({each}) WHERE k > 0)"


register(
    "validation_suite",
    sql(
        f"""SELECT 'bars' AS dataset, CASE WHEN (SELECT max(ts) FROM bars) < TIMESTAMP '2024-01-31 18:00:00' THEN 'stale' ELSE 'valid' END AS status, (SELECT count(*) FROM bars) AS n, '' AS missing, {_beyond('bars', ['open', 'high', 'low', 'close', 'volume'], 4.0)} AS outliers
UNION ALL SELECT 'lineitem', 'valid', (SELECT count(*) FROM lineitem), '', {_beyond('lineitem', ['l_quantity', 'l_extendedprice', 'l_discount'], 3.0)}
UNION ALL SELECT 'events', 'invalid', (SELECT count(*) FROM events), 'price', {_beyond('events', ['value'], 2.5)}""",
        "bars",
    ),
)(_suite)

# ---- models


def _kept(m: Market) -> DataFrame:
    """A forest predicts the same after it was kept and loaded."""
    features = ["tech_rsi", "tech_sma_dist", "tech_volatility"]
    train, test = ml.ordered_split(ml.dataset(m.bars()))
    forest, path = ml.Forest.fit(train, features, trees=10, depth=6), f"{shared_folder(m.spark)}/forest-{uuid.uuid4().hex}"
    forest.save(path)
    again = ml.Forest.load(m.spark, path)
    one, two = (f.predict(test).select("symbol", "ts", F.col("prediction").alias(n)) for f, n in ((forest, "a"), (again, "b")))
    return one.join(two, ["symbol", "ts"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("a") == F.col("b")).alias("same"))


register(
    "rf_kept_and_loaded",
    sql("SELECT symbol, count(*) AS n, true AS same FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT *, lead(close, 6) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS target FROM bars) WHERE target IS NOT NULL) WHERE i > floor(n * 0.8) GROUP BY symbol", "bars"),
)(_kept)


def _gate(m: Market) -> DataFrame:
    """Parts are trained models: their price is the new error, that of the part before the old one, and their type names the features."""
    p = m.table("part")
    old = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_retailprice").alias("old"), F.split("p_type", " ").alias("old_names"))
    rows = p.select("p_partkey", F.col("p_retailprice").alias("new"), F.split("p_type", " ").alias("names")).join(old, "p_partkey", "left")
    return rows.select("p_partkey", ml.promoted(F.col("new"), F.col("old"), ml.same_names("names", "old_names")).alias("promoted"))


_SET = "list_sort(list_distinct(string_split({}.p_type, ' ')))"
register(
    "model_gate",
    f"SELECT a.p_partkey, coalesce(b.p_partkey IS NULL OR {_SET.format('a')} <> {_SET.format('b')} OR b.p_retailprice <= 0 OR (b.p_retailprice - a.p_retailprice) / b.p_retailprice >= 0.02, true) AS promoted FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - 1",
)(_gate)


def _flat(m: Market) -> DataFrame:
    """Nested contexts with parts that are missing or no number."""
    e = m.table("events")
    nested = e.select("event_id", F.struct(F.struct(F.col("value").alias("score"), F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).otherwise("n/a").alias("k")).alias("sentiment"), F.when(F.col("event_id") % 3 == 0, F.struct(F.col("user_id").alias("whale"))).alias("onchain")).alias("context"))
    return ml.flatten_context(nested, {"score": "context.sentiment.score", "k": "context.sentiment.k", "whale": "context.onchain.whale"}).select("event_id", "score", "k", "whale")


register("context_flatten", "SELECT event_id, coalesce(value, 0) AS score, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE 0.0::DOUBLE END AS k, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS DOUBLE) ELSE 0.0::DOUBLE END AS whale FROM events")(_flat)

# ---- small steps


def _resolved(m: Market) -> DataFrame:
    """The flow column of tables that spell it each in its own way."""
    out = None
    for name in ("Flow_USD", "NET_FLOW", "flow"):
        df = flows.lowered(m.flows().toDF("Date", "TICKER", name))
        got = flows.resolve_column(df.columns, ["net_flow", "flow_usd", "flow"])
        part = df.groupBy("ticker").agg(F.round(F.sum(got), 2).alias("total")).withColumn("column", F.lit(got))
        out = part if out is None else out.unionByName(part)
    return out


register("column_resolution", sql("SELECT ticker, round(sum(flow_usd), 2) + 0.0::DOUBLE AS total, c AS column FROM flows, (VALUES ('flow_usd'), ('net_flow'), ('flow')) t(c) GROUP BY ticker, c".replace("AS column", 'AS "column"'), "flows"))(_resolved)
register("fallback_source", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT l_linenumber + 1000000000 FROM lineitem")(
    lambda m: sinks.first_non_empty(m.table("orders").filter("o_orderkey < 0").select("o_orderkey"), m.table("orders").filter("o_orderkey % 2 = 0").select("o_orderkey")).unionByName(
        sinks.first_non_empty(m.table("lineitem").select((F.col("l_linenumber") + 1000000000).cast("long").alias("o_orderkey")), m.table("orders").select("o_orderkey"))
    )
)


def _json(m: Market) -> DataFrame:
    """Orders through JSON lines and back, types declared."""
    path = f"{shared_folder(m.spark)}/json-{uuid.uuid4().hex}"
    df = m.table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    sinks.write_json(df, path)
    return m.spark.read.schema(df.schema).json(path)


register("json_round_trip", "SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders")(_json)
register("price_text", "SELECT p_partkey, printf('$%.2f', p_retailprice % 1000) AS price, printf('%+.2f%%', p_retailprice % 7 - 3) AS change FROM part")(
    lambda m: m.table("part").select("p_partkey", scalars.price_text(F.col("p_retailprice") % 1000).alias("price"), scalars.percent_text(F.col("p_retailprice") % 7 - 3).alias("change"))
)
register("label_text", "SELECT c_custkey, upper(replace(c_mktsegment, 'I', '_')) AS shouted, lower(replace(replace(c_mktsegment, 'I', '_'), '_', ' ')) AS said FROM customer")(
    lambda m: m.table("customer").select("c_custkey", F.upper(F.replace("c_mktsegment", F.lit("I"), F.lit("_"))).alias("shouted"), scalars.said(F.replace("c_mktsegment", F.lit("I"), F.lit("_"))).alias("said"))
)


def _funding_pages(m: Market) -> DataFrame:
    """A page a nation: suppliers are exchanges, their balances the current and the predicted rate; some rows are short."""
    s = m.table("supplier")
    short = F.concat(F.lit("<tr><td>"), F.col("s_name"), F.lit("</td></tr>"))
    row = F.when(F.col("s_suppkey") % 4 == 0, short).otherwise(_row(F.col("s_name"), F.concat(_number("s_acctbal", 2), F.lit("%")), F.concat(F.col("s_nationkey").cast("string"), F.lit("%"))))
    head = "<table><tr><th>Exchange</th><th>Current</th><th>Predicted</th></tr>"
    return _joined(s, ["s_nationkey"], "s_suppkey", row).select(F.col("s_nationkey").cast("string").alias("path"), F.concat(F.lit(head), "body", F.lit("</table>")).alias("html"))


register("funding_table_read", "SELECT s_name AS exchange, printf('%.2f%%', s_acctbal) AS current, s_nationkey || '%' AS predicted FROM supplier WHERE s_suppkey % 4 <> 0")(lambda m: readers.funding_table(_funding_pages(m)))
