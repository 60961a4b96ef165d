"""Queries of catalogues and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import catalogue
from brindle.plans.registry import register
from brindle.sources.tables import written
from brindle.sources.views import Market


def _chain(m: Market) -> DataFrame:
    """An order is made from the three orders of its customer before it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = [F.lag("o_orderkey", k).over(w) for k in (1, 2, 3)]
    return m.table("orders").select(F.col("o_orderkey").alias("id"), F.array(*before).alias("p")).select("id", F.explode("p").alias("parent")).filter("parent is not null")


register(
    "order_ancestors",
    """WITH RECURSIVE e AS (SELECT id, parent FROM (SELECT o_orderkey AS id, unnest([lag(o_orderkey, 1) OVER w, lag(o_orderkey, 2) OVER w, lag(o_orderkey, 3) OVER w]) AS parent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE parent IS NOT NULL),
r AS (SELECT id, parent AS ancestor, 1 AS depth FROM e UNION SELECT r.id, e.parent, r.depth + 1 FROM r JOIN e ON e.id = r.ancestor)
SELECT id, ancestor, min(depth) AS depth FROM r GROUP BY 1, 2""",
)(lambda m: catalogue.ancestors(_chain(m)))

_PROFILED = {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "o_orderpriority": False}


def _merged(m: Market) -> DataFrame:
    """The yearly profiles of the orders, kept and merged; the sketches are held against exact numbers of the same pass."""
    orders = m.table("orders").select(*_PROFILED, F.year("o_orderdate").alias("year"))
    yearly, _ = written(catalogue.profile(orders, "year"), "profiles")
    whole = catalogue.merged(yearly)
    exact = orders.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("_d")) for c in _PROFILED]).alias("_e")).select(F.inline("_e"))
    near = F.abs(F.col("distinct") - F.col("_d")) <= F.ceil(0.04 * F.col("_d"))
    between = F.when(F.col("low").isNotNull(), F.col("median").between(F.col("low"), F.col("high")))
    return whole.join(exact, "column").select("column", "n", "nulls", F.round("mean", 4).alias("mean"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), near.alias("distinct_near"), between.alias("median_inside"))


register(
    "catalogue_merged",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, "
        + (f"round(avg({c}), 4) + 0.0::DOUBLE AS mean, round(CAST(min({c}) AS DOUBLE), 4) AS low, round(CAST(max({c}) AS DOUBLE), 4) AS high, true AS distinct_near, true AS median_inside" if number else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, true AS distinct_near, CAST(NULL AS BOOLEAN) AS median_inside")
        + " FROM orders"
        for c, number in _PROFILED.items()
    ),
)(_merged)


def _drift(m: Market) -> DataFrame:
    """From the customers' table to the suppliers', their columns named without prefix; keys become text and the mark of one in five balances is lost."""
    bare = lambda t: m.table(t).toDF(*[c.split("_", 1)[1] for c in m.table(t).columns])
    new = bare("supplier").withColumns({"suppkey": F.col("suppkey").cast("string"), "acctbal": F.when(F.col("suppkey") % 5 != 0, F.col("acctbal")), "nationkey": F.col("nationkey").cast("string")})
    side = lambda df: catalogue.merged(catalogue.profile(df))
    out = catalogue.drift(side(bare("customer")), side(new))
    return out.select("column", "change", F.round("old_nulls", 6).alias("old_nulls"), F.round("new_nulls", 6).alias("new_nulls"))


register(
    "catalogue_drift",
    """WITH c AS (SELECT count(*) AS n FROM customer), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE s_suppkey % 5 = 0) AS lost FROM supplier),
v(c, change, o, w) AS (VALUES ('custkey', 'removed', 0.0, NULL), ('suppkey', 'added', NULL, 0.0), ('name', 'same', 0.0, 0.0), ('nationkey', 'retyped', 0.0, 0.0), ('mktsegment', 'removed', 0.0, NULL), ('acctbal', 'same', 0.0, 1.0))
SELECT v.c AS "column", change, CAST(o AS DOUBLE) AS old_nulls, CASE WHEN v.c = 'acctbal' THEN round(lost / s.n, 6) ELSE CAST(w AS DOUBLE) END AS new_nulls FROM v, s""",
)(_drift)
