"""Factors, zones, signals, regimes, risk, consensus, books, coins, sentiment and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.rolling import change, last_row, tail
from brindle.operators import consensus, decisions, levels, microstructure, ml, onchain, regimes, risk, sentiment, signals, zones
from brindle.operators import indicators as ind
from brindle.plans.registry import ORACLES, R, over, register, sql
from brindle.sources.views import Market

_O = "OVER (PARTITION BY symbol ORDER BY ts)"
_K = "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)"


def _rr(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _f(df: DataFrame) -> DataFrame:
    return _rr(df.select("symbol", "price", "strength", "direction"), price=6, strength=6)


_CUR = "cur AS (SELECT symbol, arg_max(close, ts) AS cur FROM bars GROUP BY symbol)"
_FOUT = f"SELECT symbol, {R('price')} AS price, {R('strength')} AS strength, direction FROM x"

# ---- factors

_BEYOND = lambda x, op: " AND ".join(f"{x} {op} {f}({x}, {k}) {_O}" for f in ("lag", "lead") for k in (1, 2))
register(
    "factor_historical_sr",
    sql(
        _FOUT,
        "bars",
        ctes=f"""n AS (SELECT *, row_number() {_O} AS i, count(*) OVER (PARTITION BY symbol) AS n, {_BEYOND('high', '>')} AS sh, {_BEYOND('low', '<')} AS sl FROM bars),
m AS (SELECT *, max(i) OVER (PARTITION BY symbol, high) AS lh, max(i) OVER (PARTITION BY symbol, low) AS ll FROM n),
l AS (SELECT symbol, high AS price, lh AS last, n, 'resistance' AS direction FROM m WHERE sh UNION ALL SELECT symbol, low, ll, n, 'support' FROM m WHERE sl),
t AS (SELECT l.symbol, l.price, count(*) FILTER (WHERE b.high BETWEEN l.price * 0.99::DOUBLE AND l.price * 1.01::DOUBLE OR b.low BETWEEN l.price * 0.99::DOUBLE AND l.price * 1.01::DOUBLE) AS touches FROM (SELECT DISTINCT symbol, price FROM l) l JOIN bars b USING (symbol) GROUP BY 1, 2),
x AS (SELECT symbol, price, least(1.0::DOUBLE, touches / 5.0::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * last / n)) AS strength, direction FROM l JOIN t USING (symbol, price))""",
    ),
)(lambda m: _f(levels.historical_sr(m.bars())))
_C21 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"
register(
    "factor_swing",
    sql(
        _FOUT,
        "bars",
        ctes=f"""w AS (SELECT *, max(high) {_C21} AS h, min(low) {_C21} AS l, count(*) {_C21} AS n FROM bars),
x AS (SELECT symbol, high AS price, 0.6::DOUBLE AS strength, 'resistance' AS direction FROM w WHERE n = 21 AND high = h UNION ALL SELECT symbol, low, 0.6::DOUBLE, 'support' FROM w WHERE n = 21 AND low = l)""",
    ),
)(lambda m: _f(levels.swing_points(m.bars())))
register(
    "factor_fibonacci",
    sql(
        _FOUT,
        "bars",
        ctes=f"""l AS (SELECT symbol, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM (SELECT *, {_K} AS k FROM bars) WHERE k <= 60 GROUP BY symbol),
f(level, strength) AS (VALUES (0.0::DOUBLE, 0.5::DOUBLE), (0.236, 0.5), (0.382, 0.7), (0.5, 0.9), (0.618, 0.9), (0.786, 0.7), (1.0, 0.5)),
p AS (SELECT symbol, c, l + (h - l) * (1 - level) AS price, strength FROM l, f),
x AS (SELECT *, CASE WHEN price < c THEN 'support' ELSE 'resistance' END AS direction FROM p)""",
    ),
)(lambda m: _f(levels.fibonacci(m.bars())))
register(
    "factor_ma",
    sql(
        _FOUT,
        "bars",
        ctes="s AS (SELECT symbol, close AS c, "
        + f"{_K} AS k, "
        + ", ".join(f"{over(n, 'avg')} AS s{n}" for n in (20, 50, 100, 200))
        + " FROM bars), u AS ("
        + " UNION ALL ".join(f"SELECT symbol, c, {n} AS n, s{n} AS price FROM s WHERE k = 1 AND s{n} IS NOT NULL" for n in (20, 50, 100, 200))
        + "), x AS (SELECT symbol, price, least(1.0::DOUBLE, greatest(0.3::DOUBLE, 1 - 2 * abs(price - c) / c) * CASE WHEN n >= 200 THEN 1.2::DOUBLE WHEN n >= 100 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) AS strength, CASE WHEN price < c THEN 'support' ELSE 'resistance' END AS direction FROM u)",
    ),
)(lambda m: _f(levels.moving_averages(m.bars())))
register(
    "factor_round",
    sql(
        _FOUT,
        "bars",
        ctes="""l AS (SELECT symbol, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM bars GROUP BY symbol),
k AS (SELECT *, unnest(range(CAST(ceil(l / 10) AS BIGINT), CAST(floor(h / 10) AS BIGINT) + 1)) AS k FROM l),
x AS (SELECT symbol, k * 10.0::DOUBLE AS price, CASE WHEN k % 10 = 0 THEN 0.8::DOUBLE WHEN k % 5 = 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS strength, CASE WHEN k * 10.0::DOUBLE < c THEN 'support' ELSE 'resistance' END AS direction FROM k)""",
    ),
)(lambda m: _f(levels.round_numbers(m.bars(), 10.0)))
register(
    "factor_pivot",
    sql(
        _FOUT,
        "bars",
        ctes=f"""b AS (SELECT symbol, high AS h, low AS l, close AS c, (high + low + close) / 3 AS p FROM (SELECT *, {_K} AS k FROM bars) WHERE k = 2),
x AS (SELECT symbol, p AS price, 0.8::DOUBLE AS strength, 'pivot' AS direction FROM b UNION ALL SELECT symbol, 2 * p - l, 0.6, 'resistance' FROM b UNION ALL SELECT symbol, p + (h - l), 0.5, 'resistance' FROM b UNION ALL SELECT symbol, 2 * p - h, 0.6, 'support' FROM b UNION ALL SELECT symbol, p - (h - l), 0.5, 'support' FROM b)""",
    ),
)(lambda m: _f(levels.pivot_points(m.bars())))
register(
    "factor_gap",
    sql(
        _FOUT,
        "bars_15m",
        ctes=f"""p AS (SELECT *, lag(high) {_O} AS ph, lag(low) {_O} AS pl FROM bars_15m),
g AS (SELECT *, CASE WHEN low > ph THEN 'up' ELSE 'down' END AS gap FROM p WHERE low > ph OR high < pl),
q AS (SELECT symbol, gap, lag(high) OVER (PARTITION BY symbol, gap ORDER BY ts) AS gh, lag(low) OVER (PARTITION BY symbol, gap ORDER BY ts) AS gl FROM g),
x AS (SELECT symbol, CASE WHEN gap = 'up' THEN gh ELSE gl END AS price, 0.7::DOUBLE AS strength, CASE WHEN gap = 'up' THEN 'support' ELSE 'resistance' END AS direction FROM q WHERE CASE WHEN gap = 'up' THEN gh ELSE gl END IS NOT NULL)""",
    ),
)(lambda m: _f(levels.gap_levels(m.bars("15m"))))
register(
    "factor_flow_pivot",
    sql(
        _FOUT,
        "bars",
        ctes="""f AS (SELECT symbol, CAST(ts AS DATE) AS date, sum(volume * (close - open)) AS flow FROM bars GROUP BY 1, 2),
z AS (SELECT f.*, (flow - m) / nullif(s, 0) AS z FROM f JOIN (SELECT symbol, avg(flow) AS m, stddev_samp(flow) AS s FROM f GROUP BY 1) USING (symbol)),
d AS (SELECT symbol, CAST(ts AS DATE) AS date, (avg(high) + avg(low)) / 2 AS price FROM bars GROUP BY 1, 2),
x AS (SELECT symbol, price, least(1.0::DOUBLE, abs(z) / 3) AS strength, CASE WHEN flow > 0 THEN 'support' ELSE 'resistance' END AS direction FROM z JOIN d USING (symbol, date) WHERE abs(z) > 2)""",
    ),
)(lambda m: _f(levels.flow_pivots(m.bars(), m.bars().groupBy("symbol", F.to_date("ts").alias("date")).agg(F.sum(F.col("volume") * (F.col("close") - F.col("open"))).alias("flow")))))
register(
    "factor_oi",
    sql(
        f"SELECT {R('price')} AS price, {R('oi / top')} AS strength, CASE WHEN abs(price - 950) / 950 <= 0.01 THEN 'magnet' WHEN price < 950 THEN 'support' ELSE 'resistance' END AS direction FROM b, s WHERE oi >= m + 2 * d",
        ctes="b AS (SELECT round_even(p_retailprice, -1) AS price, CAST(sum(p_size) AS DOUBLE) AS oi FROM part GROUP BY 1), s AS (SELECT avg(oi) AS m, stddev_samp(oi) AS d, max(oi) AS top FROM b)",
    ).replace("oi >= m + 2 * d", "oi >= m + 2 * d"),
)(lambda m: _rr(levels.open_interest_levels(m.open_interest(), F.lit(950.0)).select("price", "strength", "direction"), price=6, strength=6))
register(
    "volume_profile",
    sql(
        f"SELECT symbol, bin AS first_bin, last_bin, {R('lo + ((bin + last_bin) / 2 + 0.5::DOUBLE) * step')} AS price, {R('CAST(volume AS DOUBLE)')} AS volume FROM r WHERE n > 0",
        "bars",
        ctes="""b AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY 1),
c AS (SELECT *, greatest(10, CAST(floor((hi - lo) / (lo * 0.005::DOUBLE)) AS BIGINT)) AS edges FROM b),
d AS (SELECT *, (hi - lo) / (edges - 1) AS step FROM c),
p AS (SELECT symbol, CAST(volume AS DECIMAL(28, 8)) AS v, lo, step, edges, CAST(least(greatest(floor((low - lo) / step) + 1, 1), edges) AS BIGINT) - 1 AS f, CAST(least(greatest(floor((high - lo) / step) + 1, 1), edges) AS BIGINT) - 1 AS t FROM bars JOIN d USING (symbol)),
q AS (SELECT symbol, v, lo, step, f, least(greatest(t, f), edges - 2) + 1 AS t FROM p WHERE f <= edges - 2),
e AS (SELECT symbol, lo, step, f AS bin, v, 1 AS n FROM q UNION ALL SELECT symbol, lo, step, t, -v, -1 FROM q),
g AS (SELECT symbol, lo, step, bin, sum(v) AS v, sum(n) AS n FROM e GROUP BY ALL),
r AS (SELECT symbol, lo, step, bin, lead(bin) OVER w - 1 AS last_bin, sum(v) OVER w AS volume, sum(n) OVER w AS n FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bin))""",
    ),
)(lambda m: _rr(levels.volume_profile(m.bars()), price=6, volume=6))
register("factor_volume_peaks")(lambda m: _f(levels.volume_peaks(m.bars())))
register("all_factors")(lambda m: levels.all_factors(m.stored_bars()).groupBy("symbol", "factor_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("strength"), 6).alias("strength")))
register("zones")(lambda m: _zones(m))
register("zone_scores")(lambda m: _scores(m).select("symbol", "cluster", F.round("score", 6).alias("score"), "strength", "n_factors", "zone_type"))
register("nearest_zones")(lambda m: zones.nearest(_zones(m), 3).select("symbol", "cluster", "zone_price", "distance_pct"))


def _scores(m: Market) -> DataFrame:
    bars = m.stored_bars()
    return zones.scored(zones.clustered(levels.all_factors(bars), levels.current(bars)))


def _zones(m: Market) -> DataFrame:
    bars = m.stored_bars()
    out = zones.confluence_zones(levels.all_factors(bars), bars, least_score=0.2)
    return _rr(out, zone_price=6, low=6, high=6, score=6, distance_pct=6, breach_probability=6)


_TOL = "greatest((z.high - z.low) / 2, ((z.high + z.low) / 2) * 0.001::DOUBLE)"
register(
    "zone_tests",
    sql(
        f"SELECT z.symbol, z.cluster, CAST(count(b.ts) AS BIGINT) AS tests, max(b.ts) AS last_test FROM z LEFT JOIN bars b ON b.symbol = z.symbol AND b.low <= (z.high + z.low) / 2 + {_TOL} AND b.high >= (z.high + z.low) / 2 - {_TOL} GROUP BY 1, 2",
        "bars",
        "bars_1d",
        ctes="z AS (SELECT symbol, CAST(dayofyear(ts) AS BIGINT) AS cluster, close * 0.999::DOUBLE AS low, close * 1.001::DOUBLE AS high FROM bars_1d)",
    ),
)(lambda m: zones.tested(m.bars_1d().select("symbol", F.dayofyear("ts").cast("long").alias("cluster"), (F.col("close") * 0.999).alias("low"), (F.col("close") * 1.001).alias("high")).withColumn("zone_price", (F.col("high") + F.col("low")) / 2), m.bars()).select("symbol", "cluster", F.col("tests").cast("long").alias("tests"), "last_test"))
_SR = """w AS (SELECT *, min(low) OVER v AS wl, max(high) OVER v AS wh, count(*) OVER v AS n FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING)),
l AS (SELECT symbol, round_even(low, -1) AS level FROM w WHERE n = 14 AND low = wl UNION ALL SELECT symbol, round_even(high, -1) FROM w WHERE n = 14 AND high = wh),
c AS (SELECT symbol, level, count(*) AS n FROM l GROUP BY 1, 2)"""
register(
    "support_resistance",
    sql(
        f"SELECT symbol, {R('cur')} AS cur, max(level) FILTER (WHERE level < cur) AS support, arg_max(n, level) FILTER (WHERE level < cur) AS support_count, min(level) FILTER (WHERE level > cur) AS resistance, arg_min(n, level) FILTER (WHERE level > cur) AS resistance_count FROM c JOIN cur USING (symbol) GROUP BY symbol, cur",
        "bars",
        ctes=_CUR + ", " + _SR,
    ),
)(lambda m: _rr(levels.support_resistance(m.bars(), digits=-1), cur=6))
register("psychological_levels", sql("SELECT symbol, round_even(c * 1000, -4) - 10000 AS lower_level, round_even(c * 1000, -4) + 10000 AS upper_level FROM (SELECT symbol, arg_max(close, ts) AS c FROM bars GROUP BY symbol)", "bars"))(
    lambda m: signals.psychological_levels(levels.current(m.bars()).withColumn("close", F.col("cur") * 1000)).select("symbol", F.get("levels", F.lit(0)).alias("lower_level"), F.get("levels", F.lit(2)).alias("upper_level"))
)

# ---- signals

_RSI = f"""d AS (SELECT *, close - lag(close) {_O} AS d FROM bars),
u AS (SELECT *, CASE WHEN d IS NULL THEN 0.0::DOUBLE ELSE greatest(d, 0) END AS up, CASE WHEN d IS NULL THEN 0.0::DOUBLE ELSE greatest(-d, 0) END AS dn FROM d),
g AS (SELECT *, {over(14, 'avg', 'up')} AS gain, {over(14, 'avg', 'dn')} AS loss, {over(20, 'avg')} AS s20, {over(50, 'avg')} AS s50, {over(200, 'avg')} AS s200, count(*) OVER (PARTITION BY symbol) AS n FROM u),
r AS (SELECT *, CASE WHEN loss = 0 THEN CASE WHEN gain > 0 THEN 100.0::DOUBLE END ELSE 100 - 100 / (1 + gain / loss) END AS rsi, lag(s50) {_O} AS p50, lag(s200) {_O} AS p200, {_K} AS k FROM g),
z AS (SELECT * FROM r WHERE k = 1)"""
register(
    "signals_library",
    sql(
        f"""SELECT symbol, signal, direction, {R('confidence')} AS confidence FROM (
SELECT symbol, 'RSI Oversold' AS signal, 'bullish' AS direction, 0.7::DOUBLE + (30 - rsi) / 100 AS confidence FROM z WHERE n >= 50 AND rsi < 30
UNION ALL SELECT symbol, 'RSI Overbought', 'bearish', 0.7::DOUBLE + (rsi - 70) / 100 FROM z WHERE n >= 50 AND rsi > 70
UNION ALL SELECT symbol, 'Golden Cross', 'bullish', 0.9 FROM z WHERE n > 200 AND p50 < p200 AND s50 > s200
UNION ALL SELECT symbol, 'Death Cross', 'bearish', 0.9 FROM z WHERE n > 200 AND p50 > p200 AND s50 < s200
UNION ALL SELECT symbol, CASE WHEN close > s50 THEN 'Price > SMA 50' ELSE 'Price < SMA 50' END, CASE WHEN close > s50 THEN 'bullish' ELSE 'bearish' END, 0.6 FROM z WHERE n >= 50)""",
        "bars",
        ctes=_RSI,
    ),
)(lambda m: _rr(signals.library_signals(m.bars()), confidence=6))
register(
    "signals_basic",
    sql(
        f"""SELECT symbol, signal, direction, confidence, {R('close * a')} AS stop_loss, {R('close * b')} AS take_profit FROM (
SELECT symbol, close, 'Trend Alignment' AS signal, 'bullish' AS direction, 0.7::DOUBLE AS confidence, 0.95::DOUBLE AS a, 1.10::DOUBLE AS b FROM z WHERE s20 > s50
UNION ALL SELECT symbol, close, 'RSI Oversold', 'bullish', 0.8, 0.98, 1.05 FROM z WHERE rsi < 30
UNION ALL SELECT symbol, close, 'RSI Overbought', 'bearish', 0.6, 1.02, 0.95 FROM z WHERE rsi > 70)""",
        "bars",
        ctes=_RSI,
    ),
)(lambda m: _rr(signals.basic_signals(m.bars()), stop_loss=6, take_profit=6))
_ALIGN = f"""v AS (SELECT symbol, CASE WHEN close > s THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS v FROM (SELECT *, {over(50, 'avg')} AS s, {_K} AS k FROM bars) WHERE k = 1 AND s IS NOT NULL
UNION ALL SELECT symbol, CASE WHEN close > s THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END FROM (SELECT *, {over(50, 'avg')} AS s, {_K} AS k FROM bars_15m) WHERE k = 1 AND s IS NOT NULL)"""
register(
    "timeframe_alignment",
    sql("SELECT symbol, abs(avg(v)) * 100 AS score, CASE WHEN avg(v) > 0.3 THEN 'bullish' WHEN avg(v) < -0.3 THEN 'bearish' ELSE 'neutral' END AS direction, abs(avg(v)) * 100 = 100 AS aligned FROM v GROUP BY symbol", "bars", "bars_15m", ctes=_ALIGN),
)(lambda m: signals.alignment({"4h": m.bars(), "15m": m.bars("15m")}))
_FRACTAL = ", ".join(f"t_{v} AS (SELECT symbol, close, s FROM (SELECT *, {over(20, 'avg')} AS s, {_K} AS k FROM {v}) WHERE k = 1)" for v in ("bars", "bars_15m", "bars_1d"))
register(
    "fractal_alignment",
    sql(
        "SELECT symbol, coalesce(bool_and(coalesce(close > s, false)), false) OR coalesce(bool_and(coalesce(close < s, false)), false) AS aligned, CASE WHEN bool_and(coalesce(close > s, false)) THEN 'Full Bullish' WHEN bool_and(coalesce(close < s, false)) THEN 'Full Bearish' ELSE 'Mixed' END AS kind FROM (SELECT * FROM t_bars UNION ALL SELECT * FROM t_bars_15m UNION ALL SELECT * FROM t_bars_1d) GROUP BY symbol",
        "bars",
        "bars_15m",
        "bars_1d",
        ctes=_FRACTAL,
    ),
)(lambda m: signals.fractal_alignment({"15m": m.bars("15m"), "4h": m.bars(), "1d": m.bars_1d()}))

# ---- regimes

_FEAT = f"""p AS (SELECT *, lag(close) {_O} AS pc, lag(high) {_O} AS ph, lag(low) {_O} AS pl FROM bars),
t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, close / nullif(pc, 0) - 1 AS r, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dn FROM p),
a AS (SELECT *, {over(14, 'avg', 'tr')} AS atr, {over(14, 'sum', 'up')} AS su, {over(14, 'sum', 'dn')} AS sd, {over(20, 'avg')} AS s20, {over(50, 'avg')} AS s50, {over(20, 'stddev_samp', 'r')} AS vol, close / nullif(lag(close, 7) {_O}, 0) - 1 AS r7, close / nullif(lag(close, 30) {_O}, 0) - 1 AS r30,
 sum(CASE WHEN high - ph > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10.0::DOUBLE AS hh, sum(CASE WHEN low - pl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10.0::DOUBLE AS ll FROM t),
i AS (SELECT *, 100 * su / nullif(atr, 0) AS pdi, 100 * sd / nullif(atr, 0) AS ndi FROM a),
x AS (SELECT *, 100 * abs(pdi - ndi) / nullif(pdi + ndi, 0) AS dx FROM i),
y AS (SELECT *, {over(14, 'avg', 'dx')} AS adx, {_K} AS k FROM x),
f AS (SELECT *, close / s20 - 1 AS v20, close / s50 - 1 AS v50 FROM y WHERE k = 1),
c AS (SELECT *, CASE WHEN r30 > 0.05 AND hh - ll > 0.2 AND v20 > 0 AND v50 > 0 THEN 'bull' WHEN r30 < -0.05 AND hh - ll < -0.2 AND v20 < 0 AND v50 < 0 THEN 'bear' WHEN vol > 0.04 THEN 'volatile' ELSE 'sideways' END AS regime FROM f)"""
register(
    "regime_features",
    sql(f"SELECT symbol, ts, {R('r7')} AS return_7, {R('r30')} AS return_30, {R('v20')} AS vs_sma20, {R('v50')} AS vs_sma50, {R('vol')} AS volatility, {R('atr')} AS atr_14, {R('hh')} AS hh_ratio, {R('ll')} AS ll_ratio, {R('adx')} AS adx FROM f", "bars", ctes=_FEAT),
)(lambda m: _rr(regimes.features(m.bars()).drop("close", "flow_7"), **{c: 6 for c in ("return_7", "return_30", "vs_sma20", "vs_sma50", "volatility", "atr_14", "hh_ratio", "ll_ratio", "adx")}))
register(
    "regime_rules",
    sql(
        f"""SELECT symbol, regime, {R("CASE regime WHEN 'bull' THEN (CAST(r30 > 0.05 AS INT) + CAST(v20 > 0.02 AS INT) + CAST(hh > 0.6 AS INT) + CAST(adx > 25 AS INT)) / 4.0::DOUBLE WHEN 'bear' THEN (CAST(r30 < -0.05 AS INT) + CAST(v20 < -0.02 AS INT) + CAST(ll > 0.6 AS INT) + CAST(adx > 25 AS INT)) / 4.0::DOUBLE WHEN 'volatile' THEN (CAST(vol > 0.04 AS INT) + CAST(adx < 20 AS INT)) / 2.0::DOUBLE ELSE (CAST(abs(r30) < 0.05 AS INT) + CAST(adx < 25 AS INT)) / 2.0::DOUBLE END")} AS confidence FROM c""",
        "bars",
        ctes=_FEAT,
    ),
)(lambda m: _rr(regimes.confidence(regimes.classify(regimes.features(m.bars()))).select("symbol", "regime", "confidence"), confidence=6))
register(
    "regime_duration",
    sql(
        f"SELECT symbol, regime, CAST(CASE regime WHEN 'bull' THEN u WHEN 'bear' THEN d ELSE 10 END AS BIGINT) AS duration FROM c JOIN (SELECT symbol, count(*) FILTER (WHERE ts > coalesce(us, TIMESTAMP '1900-01-01')) AS u, count(*) FILTER (WHERE ts > coalesce(ds, TIMESTAMP '1900-01-01')) AS d FROM y JOIN (SELECT symbol, max(ts) FILTER (WHERE NOT coalesce(close > s50, false)) AS us, max(ts) FILTER (WHERE NOT coalesce(close < s50, false)) AS ds FROM y GROUP BY symbol) USING (symbol) GROUP BY symbol) USING (symbol)",
        "bars",
        ctes=_FEAT,
    ),
)(lambda m: regimes.duration(m.bars(), regimes.classify(regimes.features(m.bars()))).select("symbol", "regime", F.col("duration").cast("long").alias("duration")))
register(
    "regime_transition",
    sql(
        f"SELECT symbol, regime, next_regime, {R('w / sum(w) OVER (PARTITION BY symbol)')} AS probability FROM (SELECT symbol, regime, n AS next_regime, CASE WHEN n = regime THEN 0.5::DOUBLE WHEN n = 'distribution' AND regime = 'bull' AND r30 < 0 THEN 0.2::DOUBLE WHEN n = 'sideways' AND (regime = 'bull' AND r30 < 0 OR regime = 'bear' AND r30 > 0) THEN 0.15::DOUBLE WHEN n = 'accumulation' AND regime = 'bear' AND r30 > 0 THEN 0.2::DOUBLE WHEN n = 'volatile' AND regime IN ('bull', 'bear') AND vol > 0.04 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS w FROM c, (VALUES ('bull'), ('bear'), ('sideways'), ('volatile'), ('accumulation'), ('distribution')) t(n))",
        "bars",
        ctes=_FEAT,
    ),
)(lambda m: _rr(regimes.transitions(regimes.classify(regimes.features(m.bars()))), probability=6))
_DETECT = (
    _RSI
    + f""", tr AS (SELECT *, CASE WHEN lag(close) {_O} IS NULL THEN NULL ELSE greatest(high - low, abs(high - lag(close) {_O}), abs(low - lag(close) {_O})) END AS tr, abs(close / nullif(lag(close, 14) {_O}, 0) - 1) AS mm FROM r),
ap AS (SELECT *, ({over(14, 'avg', 'tr')}) / close AS ap, 100 * ({over(14, 'avg', 'mm')}) AS px, close / s50 - 1 AS v FROM tr),
q AS (SELECT ap.*, p95 FROM ap JOIN (SELECT symbol, quantile_cont(ap, 0.95) AS p95 FROM ap GROUP BY symbol) USING (symbol) WHERE k = 1)"""
)
register(
    "regime_detector",
    sql(
        """SELECT symbol, CASE WHEN n < 50 THEN 'sideways_compression' WHEN ap > p95 * 1.05 THEN 'high_volatility' WHEN v > 0.03 AND rsi > 52 THEN 'bull_trending' WHEN v < -0.03 AND rsi < 48 THEN 'bear_trending' WHEN rsi > 70 AND v < 0.02 THEN 'distribution' ELSE 'sideways_compression' END AS regime,
CASE WHEN n < 50 THEN 0.5::DOUBLE WHEN ap > p95 * 1.05 THEN 0.8::DOUBLE WHEN (v > 0.03 AND rsi > 52) OR (v < -0.03 AND rsi < 48) THEN CASE WHEN px > 15 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END WHEN rsi > 70 AND v < 0.02 THEN 0.65::DOUBLE WHEN px < 15 THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM q""",
        "bars",
        ctes=_DETECT,
    ),
)(lambda m: regimes.detect(m.bars()))
register("markov_next", f"SELECT symbol, regime, n AS next_regime, p AS next_probability FROM ({ORACLES['regime_detector']}) JOIN (VALUES ('bull_trending', 'distribution', 0.2::DOUBLE), ('bear_trending', 'sideways_compression', 0.25), ('sideways_compression', 'bull_trending', 0.3), ('high_volatility', 'sideways_compression', 0.4), ('distribution', 'bear_trending', 0.5)) t(r, n, p) ON r = regime")(
    lambda m: regimes.likely_next(regimes.detect(m.bars())).select("symbol", "regime", "next_regime", "next_probability")
)
register("regime_constraints", f"SELECT symbol, regime, a AS max_allocation, s AS stop_type FROM ({ORACLES['regime_detector']}) JOIN (VALUES ('bull_trending', 0.8::DOUBLE, 'trailing'), ('bear_trending', 0.3, 'fixed_tight'), ('sideways_compression', 0.4, 'range_bound'), ('high_volatility', 0.5, 'volatility_based'), ('distribution', 0.2, 'aggressive_profit_taking')) t(r, a, s) ON r = regime")(
    lambda m: regimes.constraints(regimes.detect(m.bars())).select("symbol", "regime", "max_allocation", "stop_type")
)

# ---- risk

_RET = f"r AS (SELECT *, close / nullif(lag(close) {_O}, 0) - 1 AS r, ln(close / lag(close) {_O}) AS lr, {_K} AS k FROM bars)"
register("annual_volatility", sql(f"SELECT symbol, {R('stddev_samp(lr) * sqrt(365)')} AS volatility FROM r GROUP BY symbol", "bars", ctes=_RET))(lambda m: _rr(risk.annual_volatility(m.bars()), volatility=6))
register("var_95_99", sql(f"SELECT symbol, {R('abs(quantile_cont(r, 0.05))')} AS var_95, {R('abs(quantile_cont(r, 0.01))')} AS var_99 FROM r GROUP BY symbol", "bars", ctes=_RET))(lambda m: _rr(risk.value_at_risk(m.bars()), var_95=6, var_99=6))
register("portfolio_var", sql(f"SELECT symbol, {R('abs(quantile_cont(r, 0.05) * sqrt(10)) * 100', 2)} AS var_pct, {R('abs(quantile_cont(r, 0.05) * sqrt(10)) * 100000', 2)} AS var_amount FROM r GROUP BY symbol", "bars", ctes=_RET))(
    lambda m: risk.portfolio_var(m.bars(), days=10)
)
register(
    "risk_report",
    sql(
        f"SELECT symbol, {R('v', 4)} AS volatility, {R('p5', 4)} AS var_95, {R('p1', 4)} AS var_99, {R('dd', 4)} AS max_drawdown, {R('least(100, 50 * v + 100 * abs(dd))', 1)} AS score FROM (SELECT symbol, stddev_samp(lr) * sqrt(365) AS v, abs(quantile_cont(r, 0.05)) AS p5, abs(quantile_cont(r, 0.01)) AS p1, min((close - pk) / pk) AS dd FROM q GROUP BY symbol)",
        "bars",
        ctes=f"l AS (SELECT * FROM (SELECT *, {_K} AS k FROM bars) WHERE k <= 90), q AS (SELECT *, close / nullif(lag(close) {_O}, 0) - 1 AS r, ln(close / lag(close) {_O}) AS lr, max(close) {_O} AS pk FROM l)",
    ),
)(lambda m: risk.risk_report(m.bars()))
register("stress_test", f"SELECT c_custkey, scenario, {R('c_acctbal * m', 4)} AS loss, {R('c_acctbal - c_acctbal * m', 4)} AS remaining, CASE WHEN m >= 0.15 THEN 'Critical' ELSE 'Moderate' END AS severity FROM customer, (VALUES ('Flash Crash', 0.30::DOUBLE), ('Flow Reversal', 0.15), ('Minor Correction', 0.05)) s(scenario, m) WHERE c_acctbal > 0")(
    lambda m: _rr(risk.stress_test(m.table("customer").filter("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("portfolio"))).drop("portfolio"), loss=4, remaining=4)
)
register(
    "position_sizing",
    f"SELECT p_partkey, {R('CASE WHEN c < 0.5 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(10000 * (0.2::DOUBLE / v) * (2 * (c - 0.5::DOUBLE)), 10000 * 0.02::DOUBLE / 0.05::DOUBLE)) END')} AS size FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS c, (p_partkey % 100 + 1) / 100.0::DOUBLE AS v FROM part)",
)(lambda m: m.table("part").select("p_partkey", F.round(risk.position_size(F.col("p_size") / 50.0, (F.col("p_partkey") % 100 + 1) / 100.0, F.lit(10000.0)), 6).alias("size")))
register("risk_assessment", sql("SELECT symbol, 0.5::DOUBLE + CASE WHEN v > 80 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regime = 'volatile' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS risk_score FROM c JOIN (SELECT symbol, stddev_samp(r) * sqrt(365) * 100 AS v FROM t GROUP BY symbol) USING (symbol)", "bars", ctes=_FEAT))(
    lambda m: risk.assess(m.bars(), regimes.classify(regimes.features(m.bars()))).select("symbol", "risk_score")
)
register("realized_vol_30", sql(f"SELECT symbol, {R('stddev_samp(lr) * sqrt(365) * 100', 2)} AS realized_vol FROM r WHERE k <= 30 GROUP BY symbol", "bars", ctes=_RET))(lambda m: risk.realized_volatility(m.bars()))
register(
    "synthetic_iv",
    sql(
        f"SELECT symbol, {R('hv')} AS hv_30, {R('iv')} AS iv, CASE WHEN iv > hv * 1.2 THEN 'overpriced' WHEN iv < hv * 0.8 THEN 'underpriced' ELSE 'fair' END AS label FROM (SELECT symbol, hv, (0.6::DOUBLE * hv + 0.4::DOUBLE * atr / close * sqrt(365) * 100) * (1 + (50 - 30) / 200.0::DOUBLE) AS iv FROM z WHERE k = 1)",
        "bars",
        ctes=f"q AS (SELECT *, ln(close / lag(close) {_O}) AS lr, greatest(high - low, abs(high - lag(close) {_O}), abs(low - lag(close) {_O})) AS tr FROM bars), z AS (SELECT *, ({over(30, 'stddev_samp', 'lr')}) * sqrt(365) * 100 AS hv, {over(14, 'avg', 'tr')} AS atr, {_K} AS k FROM q)",
    ),
)(lambda m: _rr(risk.synthetic_iv(m.bars(), 30.0), hv_30=6, iv=6))
register("garch_vol")(lambda m: _rr(risk.garch_volatility(m.bars()), garch_vol=4))
_SENT = f"r7 AS (SELECT symbol, close, (close / nullif(lag(close, 7) {_O}, 0) - 1) * 100 AS r7, close / nullif(lag(close) {_O}, 0) - 1 AS r1, {_K} AS k FROM bars), n AS (SELECT symbol, ts, volume * (close - open) * 1e5 AS nf FROM bars), w AS (SELECT symbol, sum(nf) AS net FROM n JOIN (SELECT symbol, max(CAST(ts AS DATE)) AS e FROM n GROUP BY symbol) USING (symbol) WHERE CAST(ts AS DATE) >= e - 7 GROUP BY symbol), v AS (SELECT symbol, stddev_samp(r1) * sqrt(365) * 100 AS vol FROM r7 WHERE k <= 30 GROUP BY symbol), s AS (SELECT symbol, coalesce(r7, 0) AS r7, vol, net, 0.6::DOUBLE * tanh(coalesce(r7, 0) / 10) + 0.4::DOUBLE * tanh(net / 1e9) AS c FROM r7 JOIN w USING (symbol) JOIN v USING (symbol) WHERE k = 1)"
register(
    "sentiment_indicators",
    sql(
        f"SELECT symbol, {R('c')} AS composite, CASE WHEN c > 0.6 THEN 'very_bullish' WHEN c > 0.2 THEN 'bullish' WHEN c > -0.2 THEN 'neutral' WHEN c > -0.6 THEN 'bearish' ELSE 'very_bearish' END AS label, CASE WHEN r7 > 0 THEN 'bullish' ELSE 'bearish' END AS trend, {R('vol', 4)} AS volatility, CASE WHEN vol < 30 THEN 'low' WHEN vol < 60 THEN 'normal' WHEN vol < 100 THEN 'high' ELSE 'extreme' END AS volatility_class, {R('net', 2)} AS net_flow_7d, CASE WHEN abs(net) < 100e6 THEN 'minimal' WHEN abs(net) < 500e6 THEN 'moderate' WHEN abs(net) < 1e9 THEN 'significant' ELSE 'massive' END AS flow_size FROM s",
        "bars",
        ctes=_SENT,
    ),
)(lambda m: _rr(risk.sentiment_indicators(m.bars(), m.bars().select("symbol", F.to_date("ts").alias("ts"), (F.col("volume") * (F.col("close") - F.col("open")) * 1e5).alias("net_flow"))), composite=6, volatility=4, net_flow_7d=2))
register(
    "history_compare",
    sql(
        f"SELECT symbol, {R('p')} AS percentile, {R('(c - h) / h * 100')} AS from_high_pct, {R('(c - l) / l * 100')} AS from_low_pct, CASE WHEN p > 95 AND (c - h) / h * 100 > -5 THEN 'near_high' WHEN p > 75 THEN 'upper' WHEN p > 25 THEN 'middle' WHEN p > 5 THEN 'lower' ELSE 'near_low' END AS position FROM (SELECT symbol, c, h, l, count(*) FILTER (WHERE close < c) / count(*)::DOUBLE * 100 AS p FROM bars JOIN (SELECT symbol, arg_max(close, ts) AS c, max(high) AS h, min(low) AS l FROM bars GROUP BY symbol) USING (symbol) GROUP BY ALL)",
        "bars",
    ),
)(lambda m: _rr(risk.history_position(m.bars()), percentile=6, from_high_pct=6, from_low_pct=6))

# ---- consensus and correlation

register(
    "price_consensus",
    sql(
        f"SELECT item, {R('price')} AS price, {R('spread', 4)} AS spread_pct, {R('conf', 4)} AS confidence, CASE WHEN conf >= 0.9 THEN 'High Confidence' WHEN conf >= 0.7 THEN 'Moderate Confidence' WHEN conf >= 0.5 THEN 'Low Confidence' ELSE 'Unreliable' END AS label, n_sources, n_sources - used AS n_outliers FROM (SELECT *, greatest(0.0::DOUBLE, 1 - spread / 10) * CASE WHEN used = 1 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS conf FROM (SELECT *, (hi - lo) / price * 100 AS spread FROM u))",
        "quotes",
        ctes="""m AS (SELECT item, median(value) AS md FROM quotes WHERE value > 0 GROUP BY 1),
o AS (SELECT q.item, value, abs(value - md) / md <= 0.02 AS ok FROM quotes q JOIN m USING (item) WHERE value > 0),
u AS (SELECT item, count(*) AS n_sources, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN count(*) ELSE count(*) FILTER (WHERE ok) END AS used, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN avg(value) ELSE avg(value) FILTER (WHERE ok) END AS price, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN max(value) ELSE max(value) FILTER (WHERE ok) END AS hi, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN min(value) ELSE min(value) FILTER (WHERE ok) END AS lo FROM o GROUP BY item)""",
    ),
)(lambda m: _rr(consensus.price_consensus(m.quotes()), price=6, spread_pct=4, confidence=4))
register(
    "metric_uncertainty",
    f"""WITH d AS (SELECT p_partkey, p_retailprice AS v, 0.6::DOUBLE AS c, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice * (1 + (p_size - 25) / 100.0::DOUBLE) END AS k FROM part), e AS (SELECT *, abs(v - k) / abs(k) AS dev FROM d)
SELECT p_partkey, CASE WHEN k IS NULL THEN 'unvalidated' WHEN dev < 0.05 THEN 'strong' WHEN dev < 0.15 THEN 'moderate' ELSE 'weak' END AS agreement, {R('CASE WHEN dev < 0.05 THEN 0.7::DOUBLE * v + 0.3::DOUBLE * k WHEN dev < 0.15 THEN 0.9::DOUBLE * v + 0.1::DOUBLE * k ELSE v END')} AS final_value, {R('CASE WHEN k IS NULL THEN c WHEN dev < 0.05 THEN c + (1 - c) * 0.5::DOUBLE WHEN dev < 0.15 THEN c ELSE c * 0.7::DOUBLE END')} AS final_confidence FROM e""",
)(lambda m: _rr(consensus.metric_agreement(m.table("part").select("p_partkey", F.col("p_retailprice").alias("value"), F.lit(0.6).alias("confidence"), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice") * (1 + (F.col("p_size") - 25) / 100.0)).alias("validation"))).select("p_partkey", "agreement", "final_value", "final_confidence"), final_value=6, final_confidence=6))
register("source_agreement", "SELECT p_partkey, CASE WHEN d < 0.05 THEN 100 WHEN d < 0.15 THEN 85 WHEN d < 0.5 THEN 50 ELSE 20 END AS score FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN 100.0::DOUBLE ELSE abs((p_size - 1) - p_partkey % 50) / abs(p_size - 1)::DOUBLE END AS d FROM part)")(
    lambda m: m.table("part").select("p_partkey", consensus.source_agreement((F.col("p_size") - 1).cast("double"), (F.col("p_partkey") % 50).cast("double")).alias("score"))
)
_CORR = f"j AS (SELECT asset_id, date, net_flow, price FROM macro JOIN daily_flow ON ts = date), k AS (SELECT asset_id, CASE WHEN count(*) OVER w = 30 THEN corr(net_flow, price) OVER w END AS v, row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) AS k FROM j WINDOW w AS (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), s AS (SELECT asset_id, v, CASE WHEN v IS NULL THEN 'insufficient_overlap' WHEN asset_id IN ('BUILDING', 'MACHINERY') AND v > 0.2 THEN 'decoupling_bullish' WHEN asset_id IN ('BUILDING', 'MACHINERY') AND v < -0.8 THEN 'tightly_coupled' WHEN asset_id IN ('HOUSEHOLD', 'FURNITURE') AND v < -0.2 THEN 'divergence_warning' WHEN asset_id IN ('HOUSEHOLD', 'FURNITURE') AND v > 0.9 THEN 'high_beta' ELSE 'normal' END AS status FROM k WHERE k = 1)"
register("macro_corr_status", sql(f"SELECT asset_id, {R('v')} AS correlation, status FROM s", "macro", "daily_flow", ctes=_CORR))(lambda m: _rr(_status(m), correlation=6))
register("macro_vote", sql("SELECT CASE WHEN count(*) = 0 THEN 'UNKNOWN' WHEN bool_or(contains(status, 'decoupling')) THEN 'DECOUPLING_BULLISH' WHEN bool_or(contains(status, 'divergence')) THEN 'DIVERGENCE' ELSE 'COUPLED' END AS macro_regime, 0.75::DOUBLE AS confidence FROM s", "macro", "daily_flow", ctes=_CORR))(lambda m: consensus.macro_vote(_status(m)))


def _status(m: Market) -> DataFrame:
    corr = consensus.rolling_correlation(m.daily_flow().select(F.col("ts").alias("date"), F.col("net_flow").alias("base")), m.macro())
    return consensus.correlation_status(corr, ["BUILDING", "MACHINERY"], ["HOUSEHOLD", "FURNITURE"])


register("macro_latest", sql(f"SELECT asset_id, {R('price', 4)} AS price, {R('(price - p) / p * 100', 4)} AS change_pct, CASE WHEN price > p THEN 'up' WHEN price < p THEN 'down' ELSE 'flat' END AS trend FROM (SELECT *, lag(price) OVER (PARTITION BY asset_id ORDER BY date) AS p, row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) AS k FROM macro) WHERE k = 1", "macro"))(
    lambda m: _rr(consensus.latest_change(m.macro()), price=4, change_pct=4)
)

# ---- books and derivatives

_LV = "lv AS (SELECT *, row_number() OVER w AS level, sum(qty) OVER (PARTITION BY snapshot, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS cum, first(price) OVER (PARTITION BY snapshot, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS best FROM book WINDOW w AS (PARTITION BY snapshot, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END))"
register(
    "depth_imbalance",
    sql(
        f"SELECT snapshot, {R('x')} AS imbalance, CASE WHEN x > 0.2 THEN 'strong_bid' WHEN x > 0.05 THEN 'mild_bid' WHEN x < -0.2 THEN 'strong_ask' WHEN x < -0.05 THEN 'mild_ask' ELSE 'balanced' END AS reading FROM (SELECT snapshot, (b - a) / (b + a) AS x FROM (SELECT snapshot, coalesce(sum(qty) FILTER (WHERE side = 'bid'), 0) AS b, coalesce(sum(qty) FILTER (WHERE side = 'ask'), 0) AS a FROM lv WHERE level <= 5 GROUP BY 1))",
        "book",
        ctes=_LV,
    ),
)(lambda m: _rr(microstructure.imbalance(m.book()), imbalance=6))
register("depth_weighted_price", sql(f"SELECT snapshot, side, {R('coalesce(sum(price * f) / nullif(sum(f), 0), 0)')} AS dwp FROM (SELECT *, greatest(0, least(qty, 50 - (cum - qty))) AS f FROM lv) GROUP BY 1, 2", "book", ctes=_LV))(
    lambda m: _rr(microstructure.depth_weighted_price(m.book(), 50.0), dwp=6)
)
register("depth_gradient", sql(f"SELECT snapshot, side, {R('CASE WHEN count(*) < 5 OR sum(d) = 0 THEN 0.0::DOUBLE ELSE regr_slope(cum, d) END', 4)} AS gradient FROM (SELECT *, abs((price - best) / best) * 100 AS d FROM lv WHERE level <= 10) GROUP BY 1, 2", "book", ctes=_LV))(
    lambda m: _rr(microstructure.gradient(m.book()), gradient=4)
)
register("depth_walls", sql("SELECT snapshot, side, CAST(count(*) AS BIGINT) AS walls, CASE WHEN side = 'bid' THEN max(price) ELSE min(price) END AS nearest_wall FROM book JOIN (SELECT snapshot, avg(qty) AS m FROM book GROUP BY 1) USING (snapshot) WHERE qty > 2 * m GROUP BY 1, 2", "book"))(
    lambda m: microstructure.walls(m.book(), 2.0)
)
register("book_spread", sql(f"SELECT snapshot, b AS best_bid, a AS best_ask, {R('(a - b) / nullif(b, 0) * 100')} AS spread_pct, CASE WHEN (a - b) / nullif(b, 0) * 100 < 0.01 THEN 'High' ELSE 'Low' END AS liquidity FROM (SELECT snapshot, max(price) FILTER (WHERE side = 'bid') AS b, min(price) FILTER (WHERE side = 'ask') AS a FROM book GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL", "book"))(
    lambda m: _rr(microstructure.spread(m.book()), spread_pct=6)
)
register(
    "order_flow_delta",
    sql(
        f"SELECT snapshot, {R('x')} AS delta, CASE WHEN x > 0.1 THEN 'bullish' WHEN x < -0.1 THEN 'bearish' ELSE 'neutral' END AS bias FROM (SELECT snapshot, (b - a) / nullif(b + a, 0) AS x FROM (SELECT snapshot, coalesce(sum(qty) FILTER (WHERE side = 'bid'), 0) AS b, coalesce(sum(qty) FILTER (WHERE side = 'ask'), 0) AS a FROM book JOIN (SELECT snapshot, (max(price) FILTER (WHERE side = 'bid') + min(price) FILTER (WHERE side = 'ask')) / 2 AS mid FROM book GROUP BY 1) USING (snapshot) WHERE abs(price - mid) <= 0.5::DOUBLE * mid GROUP BY 1))",
        "book",
    ),
)(lambda m: _rr(microstructure.flow_delta(m.book(), 0.5), delta=6))
register("liquidity_density", sql(f"SELECT snapshot, {R('sum(qty) / 2')} AS density FROM lv WHERE abs(price - best) <= 0.05::DOUBLE * best GROUP BY 1", "book", ctes=_LV))(lambda m: _rr(microstructure.liquidity_density(m.book(), 0.05), density=6))
register("liquidity_heatmap", sql(f"SELECT round_even(price, -1) AS bucket, {R('sum(qty)', 2)} AS qty FROM book GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "book"))(lambda m: _rr(microstructure.heatmap(m.book()), qty=2))
register("funding_proxy", sql(f"SELECT symbol, ts, {R('CASE WHEN open <= 0 THEN 0 ELSE (close - open) / open * 3 * 365 * 100 END', 4)} AS funding FROM bars", "bars"))(
    lambda m: _rr(microstructure.funding_proxy(m.bars(), "open", "close").select("symbol", "ts", "funding"), funding=4)
)
register(
    "funding_summary",
    sql(
        f"SELECT symbol, {R('c')} AS current, {R('a')} AS avg_recent, {R('al')} AS avg_all, CASE WHEN c > a THEN 'increasing' ELSE 'decreasing' END AS trend, abs(c) > 0.001 AS extreme FROM (SELECT symbol, max(x) FILTER (WHERE k = 1) AS c, avg(x) FILTER (WHERE k <= 21) AS a, avg(x) AS al FROM (SELECT symbol, (close - open) / open AS x, {_K} AS k FROM bars) GROUP BY symbol)",
        "bars",
    ),
)(lambda m: _rr(microstructure.rate_summary(m.bars().withColumn("x", (F.col("close") - F.col("open")) / F.col("open")), "x"), current=6, avg_recent=6, avg_all=6))
register("oi_change", sql(f"SELECT symbol, {R('(arg_max(volume, ts) - arg_min(volume, ts)) / arg_min(volume, ts) * 100')} AS change_pct FROM bars GROUP BY symbol", "bars"))(lambda m: _rr(microstructure.first_last_change(m.bars(), "volume"), change_pct=6))
register("long_short_ratio", sql(f"SELECT symbol, {R('c')} AS current, {R('a')} AS average, c > 2 OR c < 0.5 AS extreme, CASE WHEN c > 3 THEN 'bearish' WHEN c < 0.33 THEN 'bullish' ELSE 'none' END AS contrarian FROM (SELECT symbol, arg_max(close / open, ts) AS c, avg(close / open) AS a FROM bars GROUP BY symbol)", "bars"))(
    lambda m: _rr(microstructure.long_short(m.bars().withColumn("x", F.col("close") / F.col("open")), "x"), current=6, average=6)
)
register("taker_ratio", sql(f"SELECT symbol, {R('c')} AS current, {R('a')} AS average, c > 1 AS buyers_lead, CASE WHEN c > 1.5 THEN 'strong_buy' WHEN c < 0.5 THEN 'strong_sell' ELSE 'neutral' END AS pressure FROM (SELECT symbol, arg_max(close / open, ts) AS c, avg(close / open) AS a FROM bars GROUP BY symbol)", "bars"))(
    lambda m: _rr(microstructure.taker_ratio(m.bars().withColumn("x", F.col("close") / F.col("open")), "x"), current=6, average=6)
)
_MAG = "p AS (SELECT symbol, arg_max(close, ts) * 1000 AS close FROM bars GROUP BY symbol), g AS (SELECT symbol, close, unnest([round_even(close / 1000, 0) * 1000 + 1000, round_even(close / 1000, 0) * 1000 - 1000, round_even(close / 1000, 0) * 1000, close * 1.05::DOUBLE, close * 0.95::DOUBLE]) AS price_level, unnest([80, 80, 60, 95, 95]) AS intensity FROM p)"
register("liquidation_magnets", sql(f"SELECT symbol, {R('price_level', 4)} AS price_level, intensity, CASE WHEN price_level > close THEN 'above' ELSE 'below' END AS kind FROM g", "bars", ctes=_MAG))(lambda m: _rr(_magnets(m).drop("close"), price_level=4))
register(
    "cascade_risk",
    sql(f"SELECT symbol, {R('price_level', 4)} AS nearest, {R('d')} AS distance, p AS probability, CASE WHEN p > 0.7 THEN 'HIGH' WHEN p > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT *, CASE WHEN d < 0.01 THEN 0.9::DOUBLE WHEN d < 0.02 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS p FROM (SELECT *, abs(price_level - close) / close AS d FROM g) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d, price_level) = 1)", "bars", ctes=_MAG),
)(lambda m: _rr(microstructure.cascade_risk(_magnets(m)), nearest=4, distance=6))


def _magnets(m: Market) -> DataFrame:
    return microstructure.magnets(levels.current(m.bars()).select("symbol", (F.col("cur") * 1000).alias("close")))


# ---- coins

register("mvrv", sql(f"SELECT {R('100 / (sum(coins * 100 * power(0.5::DOUBLE, (DATE ' + chr(39) + '2002-01-01' + chr(39) + ' - time) / 1460.0::DOUBLE)) / sum(coins))')} AS mvrv, CAST(count(*) AS BIGINT) AS n, 0.65::DOUBLE AS confidence FROM utxo", "utxo"))(
    lambda m: _rr(onchain.realised_value(m.utxo(), 100.0, "2002-01-01"), mvrv=6)
)
register("velocity_mvrv", f"SELECT o_orderkey, {R('least(greatest(o_totalprice * 500 / (1e9 / 365) / 100, 1.1::DOUBLE), 3.8::DOUBLE)')} AS mvrv FROM orders")(
    lambda m: m.table("orders").select("o_orderkey", F.round(onchain.velocity_mvrv(F.col("o_totalprice"), F.lit(500.0), F.lit(1e9)), 6).alias("mvrv"))
)
register("sopr", sql(f"SELECT {R('avg(o_totalprice / p)')} AS sopr FROM orders JOIN (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS p FROM orders GROUP BY 1) ON d = CAST(o_orderdate AS DATE)"))(
    lambda m: _rr(onchain.spent_output_ratio(m.table("orders").select(F.to_date("o_orderdate").alias("created"), F.col("o_totalprice").alias("spent_price")), m.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("price"))), sopr=6)
)
register("whale_concentration", f"SELECT {R('sum(c_acctbal)', 2)} AS top_balance FROM (SELECT c_acctbal FROM customer ORDER BY c_acctbal DESC LIMIT 50)")(
    lambda m: _rr(onchain.concentration(m.table("customer").select(F.col("c_acctbal").alias("balance"))), top_balance=2)
)
register("whale_accumulation", sql(f"SELECT symbol, {R('s')} AS score, CASE WHEN s > 0.05 THEN 'bullish' WHEN s < -0.05 THEN 'bearish' ELSE 'neutral' END AS bias FROM (SELECT symbol, CASE WHEN count(*) < 7 THEN 0.0::DOUBLE ELSE least(greatest(10 * (arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts), -1), 1) END AS s FROM bars GROUP BY symbol)", "bars"))(
    lambda m: _rr(onchain.accumulation(m.bars(), x="close"), score=6)
)
register("mempool_congestion", "SELECT p_partkey, CASE WHEN p_size * 8 > 300 THEN 'Extreme' WHEN p_size * 8 > 100 THEN 'High' WHEN p_size * 8 > 20 THEN 'Medium' ELSE 'Low' END AS congestion FROM part")(
    lambda m: m.table("part").select("p_partkey", onchain.congestion(F.col("p_size") * 8).alias("congestion"))
)

# ---- sentiment

_BULL, _BEAR = ["thing", "able", "for"], ["stupid", "trash", "scum", "worthless"]
_ANY = lambda words: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
register(
    "keyword_sentiment",
    f"SELECT source, CAST(b AS BIGINT) AS bullish, CAST(r AS BIGINT) AS bearish, {R('CASE WHEN b + r = 0 THEN 50.0::DOUBLE WHEN b + r < 3 THEN (100.0::DOUBLE * b / (b + r) + 50) / 2 ELSE 100.0::DOUBLE * b / (b + r) END', 2)} AS score FROM (SELECT source, count(*) FILTER (WHERE {_ANY(_BULL)}) AS b, count(*) FILTER (WHERE {_ANY(_BEAR)}) AS r FROM documents GROUP BY source)",
)(lambda m: sentiment.title_score(m.table("documents").select("source", "text"), "source", bull=_BULL, bear=_BEAR))
register("sentiment_composite", f"SELECT p_partkey, {R('0.5::DOUBLE * p_size * 2 + 0.3::DOUBLE * (p_partkey % 101) + 10')} AS score, CASE WHEN s < 20 THEN 'Extreme Fear' WHEN s < 40 THEN 'Fear' WHEN s < 60 THEN 'Neutral' WHEN s < 80 THEN 'Greed' ELSE 'Extreme Greed' END AS reading, CASE WHEN s < 15 THEN 'buy' WHEN s > 85 THEN 'sell' ELSE 'none' END AS contrarian FROM (SELECT *, 0.5::DOUBLE * p_size * 2 + 0.3::DOUBLE * (p_partkey % 101) + 10 AS s FROM part)")(
    lambda m: m.table("part").withColumn("s", sentiment.composite(F.col("p_size") * 2, F.col("p_partkey") % 101, F.lit(50.0))).select("p_partkey", F.round("s", 6).alias("score"), sentiment.reading(F.col("s")).alias("reading"), sentiment.contrarian(F.col("s")).alias("contrarian"))
)

# ---- learning

register(
    "ml_dataset",
    sql(f"SELECT symbol, ts, {R('lead(close, 6) ' + _O + ' / nullif(close, 0) - 1')} AS target FROM bars", "bars"),
)(lambda m: _rr(ml.dataset(m.bars()).select("symbol", "ts", "target"), target=6))
register(
    "ml_dataset_context",
    sql(
        f"SELECT b.symbol, b.ts, {R('coalesce(c.value, 0)')} AS sent_composite, {R('target')} AS target FROM (SELECT *, lead(close, 6) {_O} / nullif(close, 0) - 1 AS target FROM bars) b ASOF LEFT JOIN c ON b.ts >= c.ts",
        "bars",
        ctes="c AS (SELECT ts, value FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) < 3)",
    ),
)(lambda m: _rr(ml.dataset(m.bars(), _sparse(m)).select("symbol", "ts", "sent_composite", "target"), sent_composite=6, target=6))


def _sparse(m: Market) -> DataFrame:
    """A context that is known only now and then: events with a rare property."""
    return m.table("events").filter(F.get_json_object("props", "$.k").cast("int") < 3).select("ts", F.col("value").alias("sent_composite"))


register("ml_split", sql("SELECT symbol, CAST(count(*) FILTER (WHERE i <= floor(n * 0.8)) AS BIGINT) AS train, CAST(count(*) FILTER (WHERE i > floor(n * 0.8)) AS BIGINT) AS test FROM (SELECT symbol, row_number() " + _O + " AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT *, lead(close, 6) " + _O + " AS t FROM bars) WHERE t IS NOT NULL) GROUP BY symbol", "bars"))(lambda m: _split(m))


def _split(m: Market) -> DataFrame:
    a, b = ml.ordered_split(ml.dataset(m.bars()))
    n = lambda d, c: d.groupBy("symbol").agg(F.count(F.lit(1)).alias(c))
    return n(a, "train").join(n(b, "test"), "symbol")


register("rf_train_predict")(lambda m: _forest(m))


def _forest(m: Market) -> DataFrame:
    features = ["tech_rsi", "tech_sma_dist", "tech_volatility"]
    train, test = ml.ordered_split(ml.dataset(m.bars()))
    return ml.Forest.fit(train, features).predict(test).select("symbol", "ts", F.round("prediction", 6).alias("prediction"))


_FC = f"""d AS (SELECT *, coalesce(greatest(close - lag(close) {_O}, 0), 0) AS up, coalesce(greatest(lag(close) {_O} - close, 0), 0) AS dn, ln(close / lag(close) {_O}) AS lr, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
g AS (SELECT *, {over(14, 'avg', 'up')} AS gain, {over(14, 'avg', 'dn')} AS loss, {over(20, 'avg')} AS s, coalesce({over(14, 'stddev_samp', 'lr')}, 0) AS vol, {_K} AS k FROM d),
f AS (SELECT *, 0.2::DOUBLE * coalesce((100 - 100 / (1 + gain / (CASE WHEN loss = 0 THEN 1e-9::DOUBLE ELSE loss END))) / 100, 0) + 0.2::DOUBLE * coalesce(close / s - 1, 0) AS sc FROM g WHERE k = 1 AND n >= 50)"""
register("oracle_forecast", sql(f"SELECT symbol, ts, {R('close')} AS close, {R('sc')} AS score, CASE WHEN sc > 0.1 THEN 'BULLISH' WHEN sc < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction, {R('least(2 * abs(sc), 1)')} AS confidence, {R('close * (1 + 2 * sc * vol)')} AS price_target FROM f", "bars", ctes=_FC))(
    lambda m: _rr(ml.forecast_latest(m.bars()), close=6, score=6, confidence=6, price_target=6)
)
_STOP = "('the', 'a', 'an', 'and', 'of', 'in', 'to', 'is', 'for', 'on')"
register(
    "tfidf_search",
    rf"""WITH w AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN {_STOP}) AS w FROM benchmark),
t AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)),
v AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS v FROM x),
s AS (SELECT a.item_id, sum(a.v * b.v) AS score FROM v a JOIN v b USING (term) WHERE b.item_id = '0' GROUP BY a.item_id)
SELECT item_id, round(score, 6) + 0.0::DOUBLE AS score FROM s WHERE score > 0.01 ORDER BY score DESC, item_id LIMIT 5""",
)(lambda m: _search(m))


def _search(m: Market) -> DataFrame:
    items = m.table("benchmark").select(F.col("item_id").cast("string").alias("item_id"), "text")
    index = ml.tfidf(items, "item_id")
    return ml.search(index, index.filter("item_id = '0'"), "item_id", 5, 0.01).withColumn("score", F.round("score", 6))


# ---- decisions

_DEC = "d AS (SELECT doc_id, lower(text) AS t, source, doc_id % 4 AS m FROM documents)"
register(
    "facilitator_rules",
    sql(
        """SELECT doc_id, decision, confidence, CASE WHEN decision = 'HOLD' THEN 0.0::DOUBLE WHEN decision = 'BUY' AND m = 2 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS allocation FROM (
SELECT doc_id, m, CASE WHEN m = 0 THEN 'SELL' WHEN contains(t, 'thing') THEN 'BUY' ELSE 'HOLD' END AS decision, CASE WHEN m = 0 THEN 0.85::DOUBLE WHEN contains(t, 'thing') THEN CASE WHEN m = 1 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END ELSE 0.5::DOUBLE END AS confidence FROM d)""",
        ctes=_DEC,
    ),
)(lambda m: _facilitate(m))


def _facilitate(m: Market) -> DataFrame:
    d = m.table("documents").select(
        "doc_id",
        F.lit("flat").alias("retail"),
        F.when(F.contains(F.lower("text"), F.lit("thing")), "accumulating").otherwise("waiting").alias("institution"),
        F.when(F.col("doc_id") % 4 == 0, "will distribute").otherwise("quiet").alias("whale"),
        F.when(F.col("doc_id") % 4 == 1, "high beta").otherwise("calm").alias("macro"),
        F.when(F.col("doc_id") % 4 == 0, "bull_trending").when(F.col("doc_id") % 4 == 2, "high_volatility").otherwise("sideways_compression").alias("regime"),
    )
    return decisions.size_by_regime(decisions.facilitate(d)).select("doc_id", "decision", "confidence", "allocation")


register("reflexion_critique", "SELECT o_orderkey, CASE WHEN abs(r) < 0.5 THEN 'noise' WHEN (d = 'BUY' AND r < -1) OR (d = 'SELL' AND r > 1) THEN 'wrong_direction' ELSE 'ok' END AS critique FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS d, (o_totalprice % 1000) / 100 - 5 AS r FROM orders)")(
    lambda m: m.table("orders").select("o_orderkey", decisions.critique(F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL"), (F.col("o_totalprice") % 1000) / 100 - 5).alias("critique"))
)
register("thinking_level", "SELECT p_partkey, CASE WHEN p_size * 2 < 30 THEN 'minimal' WHEN p_size * 2 < 60 THEN 'low' WHEN p_size * 2 < 90 THEN 'medium' ELSE 'high' END AS level FROM part")(lambda m: m.table("part").select("p_partkey", decisions.thinking_level(F.col("p_size") * 2).alias("level")))
register(
    "order_sizing",
    f"SELECT o_orderkey, {R('CASE WHEN v < 10 THEN 0.0::DOUBLE ELSE v / 50000 END')} AS quantity FROM (SELECT o_orderkey, o_totalprice * least(1.0::DOUBLE, 0.1::DOUBLE * CASE WHEN c > 0.8 THEN 1.5::DOUBLE WHEN c < 0.6 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS v FROM (SELECT o_orderkey, o_totalprice, (o_orderkey % 10) / 10.0::DOUBLE AS c FROM orders))",
)(lambda m: m.table("orders").select("o_orderkey", decisions.order_quantity(F.lit("BUY"), (F.col("o_orderkey") % 10) / 10.0, F.col("o_totalprice"), F.lit(0.0), F.lit(50000.0)).alias("quantity")))
register("opportunities", sql("SELECT symbol, CASE regime WHEN 'bull' THEN 'Trend Continuation' ELSE 'Range Trading' END AS opportunity, CASE regime WHEN 'bull' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM c WHERE regime IN ('bull', 'sideways')", "bars", ctes=_FEAT))(
    lambda m: decisions.regime_opportunities(regimes.classify(regimes.features(m.bars())))
)
register("flash_outlook")(lambda m: tail(ind.rsi(m.bars()).withColumn("r", change("close", 1)), 3).select("symbol", "ts", F.round("rsi_14", 4).alias("rsi_14"), F.round("r", 6).alias("r")))
register("last_close", sql(f"SELECT symbol, ts, {R('close')} AS close FROM (SELECT *, {_K} AS k FROM bars) WHERE k = 1", "bars"))(lambda m: last_row(m.bars()).select("symbol", "ts", F.round("close", 6).alias("close")))
