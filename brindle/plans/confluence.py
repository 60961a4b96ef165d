"""Zones over given clusters: scores, tests against history and the nearest ones, for factors that SQL can give as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import levels, zones
from brindle.plans import domain  # noqa: F401  (registers the factors)
from brindle.plans.registry import ORACLES, QUERIES, R, register, sql
from brindle.sources.views import Market

_DETECTORS = {"factor_historical_sr": "historical_sr", "factor_swing": "swing_point", "factor_fibonacci": "fibonacci", "factor_ma": "moving_average", "factor_round": "round_number", "factor_pivot": "pivot_point", "factor_gap": "gap_level"}
#: Weights of the factor types: fixed values.
_WEIGHTS = "CASE factor_type WHEN 'historical_sr' THEN 0.18 WHEN 'fibonacci' THEN 0.12 WHEN 'moving_average' THEN 0.10 WHEN 'round_number' THEN 0.08 WHEN 'pivot_point' THEN 0.08 WHEN 'gap_level' THEN 0.04 WHEN 'swing_point' THEN 0.03 ELSE 0.05 END"
_FACTORS = " UNION ALL ".join(f"SELECT symbol, price, strength, direction, '{t}' AS factor_type FROM ({ORACLES[q]})" for q, t in _DETECTORS.items())
_SCORED = f"""f AS ({_FACTORS}), cu AS (SELECT symbol, arg_max(close, ts) AS cur FROM bars GROUP BY symbol),
r AS (SELECT f.*, cur, CAST(floor(price / (0.03::DOUBLE * cur)) AS BIGINT) AS cluster, CAST({_WEIGHTS} AS DOUBLE) AS w FROM f JOIN cu USING (symbol)),
g AS (SELECT symbol, cluster, cur, sum(price * strength) / nullif(sum(strength), 0) AS zone, min(price) AS low, max(price) AS high, count(*) AS n, count(DISTINCT factor_type) AS types,
             sum(CASE WHEN direction = 'support' THEN strength ELSE 0 END) AS s, sum(CASE WHEN direction = 'resistance' THEN strength ELSE 0 END) AS rs FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2),
b AS (SELECT symbol, cluster, sum(w * strength * exp(-10 * abs(price - zone) / zone)) / sum(w) AS base FROM r JOIN g USING (symbol, cluster) GROUP BY 1, 2),
z AS (SELECT g.*, least(1.0::DOUBLE, greatest(0.0::DOUBLE, base + 0.15::DOUBLE * types / 10 + least(0.2::DOUBLE, 0.03::DOUBLE * n) - least(0.15::DOUBLE, 0.5::DOUBLE * abs(zone - cur) / cur))) AS score,
             CASE WHEN s > rs THEN 'support' WHEN rs > s THEN 'resistance' ELSE 'pivot' END AS kind FROM g JOIN b USING (symbol, cluster))"""
_STRENGTH = "CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.70 THEN 'strong' WHEN score >= 0.55 THEN 'moderate' ELSE 'weak' END"


def _zones(m: Market) -> DataFrame:
    """Factors three hundredths of the price apart are a cluster; prices as the factors' queries round them."""
    parts = [QUERIES[q](m.spark, m.path).select("symbol", "price", "strength", "direction", F.lit(t).alias("factor_type")) for q, t in _DETECTORS.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.join(levels.current(m.bars()), "symbol")
    return zones.scored(rows.withColumn("cluster", F.floor(F.col("price") / (0.03 * F.col("cur"))).cast("long")))


register("zone_scores_on_grid", sql(f"SELECT symbol, cluster, {R('zone')} AS zone_price, n AS n_factors, kind AS zone_type, {R('score')} AS score, {_STRENGTH} AS strength, {R('(zone - cur) / cur * 100')} AS distance_pct FROM z", "bars", ctes=_SCORED))(
    lambda m: _zones(m).select("symbol", "cluster", F.round("zone_price", 6).alias("zone_price"), "n_factors", "zone_type", F.round("score", 6).alias("score"), "strength", F.round("distance_pct", 6).alias("distance_pct"))
)
_TESTED = f"""{_SCORED},
t AS (SELECT z.symbol, cluster, count(*) AS tests, max(b.ts) AS last_test FROM z JOIN bars b ON b.symbol = z.symbol AND b.low <= zone + greatest((z.high - z.low) / 2, zone * 0.001::DOUBLE) AND b.high >= zone - greatest((z.high - z.low) / 2, zone * 0.001::DOUBLE) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars),
mv AS (SELECT symbol, abs(max(close) FILTER (WHERE k = 1) / nullif(max(close) FILTER (WHERE k = 5), 0) - 1) AS move FROM k GROUP BY symbol)"""
register(
    "zone_tests_on_grid",
    sql(f"SELECT z.symbol, z.cluster, coalesce(tests, 0) AS tests, last_test, {R('CASE WHEN coalesce(tests, 0) = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, greatest(0.2::DOUBLE, 1 - tests / 20) + 0.3::DOUBLE * coalesce(move, 0))) END')} AS breach_probability FROM z LEFT JOIN t USING (symbol, cluster) JOIN mv USING (symbol)", "bars", ctes=_TESTED),
)(lambda m: zones.tested(_zones(m), m.bars()).select("symbol", "cluster", "tests", "last_test", F.round("breach_probability", 6).alias("breach_probability")))
register(
    "nearest_zones_on_grid",
    sql("SELECT symbol, cluster, k AS place FROM (SELECT symbol, cluster, row_number() OVER (PARTITION BY symbol, zone > cur ORDER BY abs(zone - cur) / cur, cluster) AS k, zone > cur AS up FROM z WHERE zone <> cur) WHERE k <= 2", "bars", ctes=_SCORED),
)(lambda m: _nearest(m))


def _nearest(m: Market) -> DataFrame:
    """The two nearest zones above the price and the two below it, with their places."""
    found = _zones(m)
    both = zones.nearest(found, 2, "above").unionByName(zones.nearest(found, 2, "below"))
    w = Window.partitionBy("symbol", F.col("distance_pct") > 0).orderBy(F.abs("distance_pct"), "cluster")
    return both.select("symbol", "cluster", F.row_number().over(w).cast("long").alias("place"))
