"""Bars, indicators and other windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rolling import centred, full, last_row, ratio, series, tail, zscore
from brindle.operators import indicators as ind
from brindle.operators import resample
from brindle.plans.registry import R, over, register, sql
from brindle.sources.views import Market

_O = "OVER (PARTITION BY symbol ORDER BY ts)"


def _r(*names: str, n: int = 6):
    return [F.round(F.col(c), n).alias(c) for c in names]


def _bars_sql(view: str) -> str:
    return sql(f"SELECT symbol, ts, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, {R('close')} AS close, volume FROM {view}", view)


def _bars(df: DataFrame) -> DataFrame:
    return df.select("symbol", "ts", *_r("open", "high", "low", "close"), "volume")


register("ohlcv_resample_4h", _bars_sql("bars"))(lambda m: _bars(m.bars()))
register("ohlcv_resample_1h_all", _bars_sql("bars_1h"))(lambda m: _bars(m.bars_1h()))
register("ohlcv_resample_1d", _bars_sql("bars_1d"))(lambda m: _bars(m.bars_1d()))
register("ohlcv_4h_to_1d", _bars_sql("bars_1d"))(lambda m: _bars(resample.resample_ohlcv(m.bars(), "1d")))

register("sma_20_50", sql(f"SELECT symbol, ts, {R(over(20, 'avg'))} AS sma_20, {R(over(50, 'avg'))} AS sma_50, {R(over(100, 'avg'))} AS sma_100 FROM bars", "bars"))(
    lambda m: ind.sma(m.bars(), 20, 50, 100).select("symbol", "ts", *_r("sma_20", "sma_50", "sma_100"))
)


def _rsi_sql(zero_first: bool, n: int = 14, out: str = "rsi_14") -> str:
    first = "0.0::DOUBLE" if zero_first else "NULL"
    ctes = f"""d AS (SELECT *, close - lag(close) {_O} AS d FROM bars),
u AS (SELECT *, CASE WHEN d IS NULL THEN {first} ELSE greatest(d, 0) END AS up, CASE WHEN d IS NULL THEN {first} ELSE greatest(-d, 0) END AS dn FROM d),
g AS (SELECT *, {over(n, 'avg', 'up')} AS gain, {over(n, 'avg', 'dn')} AS loss FROM u)"""
    return sql(f"SELECT symbol, ts, {R('CASE WHEN loss = 0 THEN CASE WHEN gain > 0 THEN 100.0::DOUBLE END ELSE 100 - 100 / (1 + gain / loss) END')} AS {out} FROM g", "bars", ctes=ctes)


register("rsi_14", _rsi_sql(True))(lambda m: ind.rsi(m.bars()).select("symbol", "ts", *_r("rsi_14")))
register("rsi_clip", _rsi_sql(False, out="rsi"))(lambda m: ind.rsi(m.bars(), out="rsi", first_is_zero=False).select("symbol", "ts", *_r("rsi")))

register(
    "ml_technical_features",
    sql(
        f"SELECT symbol, ts, {R('coalesce((100 - 100 / (1 + gain / (CASE WHEN loss = 0 THEN 1e-9::DOUBLE ELSE loss END))) / 100, 0)')} AS tech_rsi, {R('coalesce(close / s - 1, 0)')} AS tech_sma_dist, {R('coalesce(' + over(14, 'stddev_samp', 'lr') + ', 0)')} AS tech_volatility FROM g",
        "bars",
        ctes=f"""d AS (SELECT *, coalesce(greatest(close - lag(close) {_O}, 0), 0) AS up, coalesce(greatest(lag(close) {_O} - close, 0), 0) AS dn, CASE WHEN close / lag(close) {_O} > 0 THEN ln(close / lag(close) {_O}) END AS lr FROM bars),
g AS (SELECT *, {over(14, 'avg', 'up')} AS gain, {over(14, 'avg', 'dn')} AS loss, {over(20, 'avg')} AS s FROM d)""",
    ),
)(lambda m: ind.ml_features(m.bars()).select("symbol", "ts", *_r("tech_rsi", "tech_sma_dist", "tech_volatility")))

register(
    "macd_12_26_9",
    sql(
        f"SELECT symbol, ts, {R('l')} AS macd, {R('sg')} AS macd_signal, {R('l - sg')} AS macd_hist FROM e",
        "bars",
        recursive=True,
        ctes="""n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),
e AS (SELECT symbol, ts, i, close AS f, close AS s, 0.0::DOUBLE AS l, 0.0::DOUBLE AS sg FROM n WHERE i = 1
UNION ALL SELECT n.symbol, n.ts, n.i, n.close * (2.0::DOUBLE / 13) + e.f * (1 - 2.0::DOUBLE / 13), n.close * (2.0::DOUBLE / 27) + e.s * (1 - 2.0::DOUBLE / 27),
 (n.close * (2.0::DOUBLE / 13) + e.f * (1 - 2.0::DOUBLE / 13)) - (n.close * (2.0::DOUBLE / 27) + e.s * (1 - 2.0::DOUBLE / 27)),
 ((n.close * (2.0::DOUBLE / 13) + e.f * (1 - 2.0::DOUBLE / 13)) - (n.close * (2.0::DOUBLE / 27) + e.s * (1 - 2.0::DOUBLE / 27))) * 0.2::DOUBLE + e.sg * 0.8::DOUBLE
 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)""",
    ),
)(lambda m: ind.macd(m.bars()).select("symbol", "ts", *_r("macd", "macd_signal", "macd_hist")))

register("bollinger_20", sql(f"SELECT symbol, ts, {R('a + 2 * s')} AS bb_upper, {R('a - 2 * s')} AS bb_lower FROM b", "bars", ctes=f"b AS (SELECT *, {over(20, 'avg')} AS a, {over(20, 'stddev_samp')} AS s FROM bars)"))(
    lambda m: ind.bollinger(m.bars()).select("symbol", "ts", *_r("bb_upper", "bb_lower"))
)

_TR = f"p AS (SELECT *, lag(close) {_O} AS pc, lag(high) {_O} AS ph, lag(low) {_O} AS pl FROM bars), t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM p)"
register("atr_14", sql(f"SELECT symbol, ts, {R(over(14, 'avg', 'tr'))} AS atr_14 FROM t", "bars", ctes=_TR))(lambda m: ind.atr(m.bars()).select("symbol", "ts", *_r("atr_14")))
register("atr_pct", sql(f"SELECT symbol, ts, {R('(' + over(14, 'avg', 'tr2') + ') / close')} AS atr_pct FROM t2", "bars", ctes=_TR + ", t2 AS (SELECT *, CASE WHEN pc IS NULL THEN NULL ELSE tr END AS tr2 FROM t)"))(
    lambda m: ind.atr_pct(m.bars()).select("symbol", "ts", *_r("atr_pct"))
)
register(
    "adx_14",
    sql(
        f"SELECT symbol, ts, {R(over(14, 'avg', 'dx'))} AS adx FROM x",
        "bars",
        ctes=_TR
        + f""", m AS (SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dn FROM t),
a AS (SELECT *, {over(14, 'avg', 'tr')} AS atr, {over(14, 'sum', 'up')} AS su, {over(14, 'sum', 'dn')} AS sd FROM m),
i AS (SELECT *, 100 * su / nullif(atr, 0) AS pdi, 100 * sd / nullif(atr, 0) AS ndi FROM a),
x AS (SELECT *, 100 * abs(pdi - ndi) / nullif(pdi + ndi, 0) AS dx FROM i)""",
    ),
)(lambda m: ind.adx(m.bars()).select("symbol", "ts", *_r("adx")))
register("adx_proxy", sql(f"SELECT symbol, ts, {R('100 * (' + over(14, 'avg', 'c') + ')')} AS adx_proxy FROM c", "bars", ctes="c AS (SELECT *, abs(close / nullif(lag(close, 14) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1) AS c FROM bars)"))(
    lambda m: ind.adx_proxy(m.bars()).select("symbol", "ts", *_r("adx_proxy"))
)
register(
    "roc_1_5",
    sql("SELECT symbol, ts, " + ", ".join(f"{R(f'close / nullif(lag(close, {k}) {_O}, 0) - 1')} AS roc_{k}" for k in (1, 5, 7, 14, 30)) + f", {R(f'volume / nullif(lag(volume, 5) {_O}, 0) - 1')} AS vol_mom_5 FROM bars", "bars"),
)(lambda m: ind.momentum(ind.momentum(m.bars(), 1, 5, 7, 14, 30), 5, x="volume", prefix="vol_mom").select("symbol", "ts", *_r("roc_1", "roc_5", "roc_7", "roc_14", "roc_30", "vol_mom_5")))
_LR = f"l AS (SELECT *, CASE WHEN close / lag(close) {_O} > 0 THEN ln(close / lag(close) {_O}) END AS log_ret FROM bars)"
register("log_return_vol", sql(f"SELECT symbol, ts, {R('log_ret')} AS log_ret, {R('(' + over(20, 'stddev_samp', 'log_ret') + ') * sqrt(365)')} AS vol_20 FROM l", "bars", ctes=_LR))(
    lambda m: ind.volatility(m.bars()).select("symbol", "ts", *_r("log_ret", "vol_20"))
)
register(
    "technical_features",
    sql(
        f"SELECT symbol, ts, {R(over(20, 'avg'))} AS sma_20, {R(over(50, 'avg'))} AS sma_50, {R(over(14, 'avg', 'tr'))} AS atr_14, {R('(' + over(20, 'avg') + ') + 2 * (' + over(20, 'stddev_samp') + ')')} AS bb_upper, {R('close / pc - 1')} AS roc_1 FROM t",
        "bars",
        ctes=_TR,
    ),
)(lambda m: ind.technical_features(m.bars()).select("symbol", "ts", *_r("sma_20", "sma_50", "atr_14", "bb_upper", "roc_1")))
register("drawdown", sql(f"SELECT symbol, ts, {R('p')} AS peak, {R('(close - p) / nullif(p, 0)')} AS drawdown FROM d", "bars", ctes=f"d AS (SELECT *, max(close) {_O} AS p FROM bars)"))(
    lambda m: ind.drawdown(m.bars()).select("symbol", "ts", *_r("peak", "drawdown"))
)
register("max_drawdown", sql(f"SELECT symbol, {R('min((close - p) / nullif(p, 0))')} AS max_drawdown FROM d GROUP BY symbol", "bars", ctes=f"d AS (SELECT *, max(close) {_O} AS p FROM bars)"))(
    lambda m: ind.drawdown(m.bars()).groupBy("symbol").agg(F.round(F.min("drawdown"), 6).alias("max_drawdown"))
)

register("cum_flow", sql(f"SELECT ts, {R('net_flow', 2)} AS net_flow, {R('sum(net_flow) OVER (ORDER BY ts)', 2)} AS cumulative_flow FROM daily_flow", "daily_flow"))(
    lambda m: m.daily_flow().select("ts", F.round("net_flow", 2).alias("net_flow"), F.round(F.sum("net_flow").over(series().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("cumulative_flow"))
)
register("flow_rolling_7_30", sql(f"SELECT ts, {R(over(7, 'sum', 'net_flow'), 2)} AS flow_cum_7d, {R(over(30, 'sum', 'net_flow'), 2)} AS flow_cum_30d FROM daily_flow", "daily_flow"))(
    lambda m: m.daily_flow().select("ts", F.round(full(F.sum, "net_flow", 7), 2).alias("flow_cum_7d"), F.round(full(F.sum, "net_flow", 30), 2).alias("flow_cum_30d"))
)
register("flow_zscore", sql(f"SELECT ts, {R('(net_flow - (' + over(30, 'avg', 'net_flow') + ')) / nullif(' + over(30, 'stddev_samp', 'net_flow') + ', 0)')} AS flow_zscore FROM daily_flow", "daily_flow"))(
    lambda m: m.daily_flow().select("ts", F.round(zscore("net_flow", 30), 6).alias("flow_zscore"))
)
register(
    "funding_zscore",
    sql(f"SELECT symbol, ts, {R('(x - (' + over(30, 'avg', 'x') + ')) / nullif(' + over(30, 'stddev_samp', 'x') + ', 0)')} AS funding_zscore FROM f", "bars", ctes="f AS (SELECT symbol, ts, (close - open) / nullif(open, 0) AS x FROM bars)"),
)(lambda m: m.bars().withColumn("x", ratio(F.col("close") - F.col("open"), F.col("open"))).select("symbol", "ts", F.round(zscore("x", 30), 6).alias("funding_zscore")))

_C14 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING)"
register("centered_extrema_14", sql(f"SELECT symbol, ts, {R(f'CASE WHEN count(low) {_C14} = 14 THEN min(low) {_C14} END')} AS low_14, {R(f'CASE WHEN count(high) {_C14} = 14 THEN max(high) {_C14} END')} AS high_14 FROM bars", "bars"))(
    lambda m: m.bars().select("symbol", "ts", F.round(centred(F.min, "low", 14), 6).alias("low_14"), F.round(centred(F.max, "high", 14), 6).alias("high_14"))
)
register(
    "fractal_swings",
    sql(
        f"SELECT symbol, ts, high > lag(high, 1) {_O} AND high > lag(high, 2) {_O} AND high > lead(high, 1) {_O} AND high > lead(high, 2) {_O} IS TRUE AS swing_high, CASE WHEN low < lag(low, 1) {_O} AND low < lag(low, 2) {_O} AND low < lead(low, 1) {_O} AND low < lead(low, 2) {_O} THEN true ELSE false END AS swing_low FROM bars",
        "bars",
    ).replace(f"high > lag(high, 1) {_O} AND high > lag(high, 2) {_O} AND high > lead(high, 1) {_O} AND high > lead(high, 2) {_O} IS TRUE", f"CASE WHEN high > lag(high, 1) {_O} AND high > lag(high, 2) {_O} AND high > lead(high, 1) {_O} AND high > lead(high, 2) {_O} THEN true ELSE false END"),
)(lambda m: _swings(m.bars()).select("symbol", "ts", "swing_high", "swing_low"))


def _swings(bars: DataFrame) -> DataFrame:
    from brindle.operators.levels import swings

    return swings(bars)


register("gap_levels", sql(f"SELECT symbol, ts, CASE WHEN low > ph THEN 'up' ELSE 'down' END AS gap, {R('CASE WHEN low > ph THEN ph ELSE pl END')} AS level FROM p WHERE low > ph OR high < pl", "bars_15m", ctes=_TR.replace("FROM bars)", "FROM bars_15m)")))(
    lambda m: _gaps(m.bars("15m")).select("symbol", "ts", "gap", F.round("previous", 6).alias("level"))
)


def _gaps(bars: DataFrame) -> DataFrame:
    from brindle.operators.levels import gaps

    return gaps(bars)


register(
    "sma_cross",
    sql(
        "SELECT symbol, ts, CASE WHEN p20 <= p50 THEN 'golden' ELSE 'death' END AS cross_kind FROM q WHERE (p20 <= p50 AND s20 > s50) OR (p20 >= p50 AND s20 < s50)",
        "bars",
        ctes=f"s AS (SELECT *, {over(20, 'avg')} AS s20, {over(50, 'avg')} AS s50 FROM bars), q AS (SELECT *, lag(s20) {_O} AS p20, lag(s50) {_O} AS p50 FROM s)",
    ),
)(lambda m: _cross(m.bars()))


def _cross(bars: DataFrame) -> DataFrame:
    df = ind.sma(bars, 20, 50).withColumns({"p20": F.lag("sma_20").over(series()), "p50": F.lag("sma_50").over(series())})
    up, down = (F.col("p20") <= F.col("p50")) & (F.col("sma_20") > F.col("sma_50")), (F.col("p20") >= F.col("p50")) & (F.col("sma_20") < F.col("sma_50"))
    return df.filter(up | down).select("symbol", "ts", F.when(F.col("p20") <= F.col("p50"), "golden").otherwise("death").alias("cross_kind"))


register(
    "consecutive_run",
    sql("SELECT s.symbol, CAST(count(*) FILTER (WHERE ts > coalesce(stop, TIMESTAMP '1900-01-01')) AS BIGINT) AS run_length FROM s JOIN (SELECT symbol, max(ts) FILTER (WHERE NOT coalesce(close > s20, false)) AS stop FROM s GROUP BY symbol) USING (symbol) GROUP BY s.symbol", "bars", ctes=f"s AS (SELECT *, {over(20, 'avg')} AS s20 FROM bars)"),
)(lambda m: _run(m.bars()))


def _run(bars: DataFrame) -> DataFrame:
    from brindle.operators.regimes import run_length

    return run_length(ind.sma(bars, 20), F.col("close") > F.col("sma_20"))


register("lead_target", sql(f"SELECT symbol, ts, {R(f'lead(close, 6) {_O} / nullif(close, 0) - 1')} AS target_return FROM bars", "bars"))(
    lambda m: m.bars().select("symbol", "ts", F.round(ratio(F.lead("close", 6).over(series()), F.col("close")) - 1, 6).alias("target_return"))
)
register(
    "median_bar_delta",
    sql("SELECT symbol, CAST(greatest(1, round_even(86400 / median(d), 0)) AS BIGINT) AS bars_per_day FROM g WHERE d IS NOT NULL GROUP BY symbol", "bars_1h", ctes=f"g AS (SELECT symbol, epoch(ts) - lag(epoch(ts)) {_O} AS d FROM bars_1h)"),
)(lambda m: _per_day(m.bars_1h()))


def _per_day(bars: DataFrame) -> DataFrame:
    from brindle.operators.evaluation import bars_per_day

    return bars_per_day(bars)


register("depth_cumulative", sql(f"SELECT snapshot, side, price, {R('sum(qty) OVER (PARTITION BY snapshot, side ORDER BY price)')} AS cumulative FROM book", "book"))(
    lambda m: m.book().select("snapshot", "side", "price", F.round(F.sum("qty").over(Window.partitionBy("snapshot", "side").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)), 6).alias("cumulative"))
)
register("second_last_bar", sql(f"SELECT symbol, ts, {R('close')} AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k = 2", "bars"))(
    lambda m: last_row(m.bars(), k=2).select("symbol", "ts", *_r("close"))
)
register("change_over_last_7", sql(f"SELECT symbol, {R('max(close) FILTER (WHERE k = 1) / nullif(max(close) FILTER (WHERE k = 7), 0) - 1')} AS change_7 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) GROUP BY symbol", "bars"))(
    lambda m: _from_end(m.bars())
)


def _from_end(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    df = bars.withColumn("k", F.row_number().over(w))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("close")))
    return df.groupBy("symbol").agg(F.round(ratio(at(1), at(7)) - 1, 6).alias("change_7"))


register("tail_30_stats", sql(f"SELECT symbol, {R('max(high)')} AS high_30, {R('stddev_samp(close)')} AS std_30, {R('sum(volume)')} AS volume_30 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 30 GROUP BY symbol", "bars"))(
    lambda m: tail(m.bars(), 30).groupBy("symbol").agg(F.round(F.max("high"), 6).alias("high_30"), F.round(F.stddev_samp("close"), 6).alias("std_30"), F.round(F.sum("volume"), 6).alias("volume_30"))
)
register("up_bars_in_10", sql(f"SELECT symbol, ts, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS ups FROM d", "bars", ctes=f"d AS (SELECT *, high - lag(high) {_O} AS d FROM bars)"))(
    lambda m: m.bars().withColumn("d", F.col("high") - F.lag("high").over(series())).select("symbol", "ts", F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).over(series().rowsBetween(-9, 0)).alias("ups"))
)
register(
    "corr_rolling_30",
    sql(
        f"SELECT asset_id, date, {R('CASE WHEN count(price) ' + 'OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) = 30 THEN corr(net_flow, price) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END')} AS corr_30 FROM macro JOIN daily_flow ON ts = date",
        "macro",
        "daily_flow",
    ),
)(lambda m: _corr(m))


def _corr(m: Market) -> DataFrame:
    from brindle.operators.consensus import rolling_correlation

    return rolling_correlation(m.daily_flow().select(F.col("ts").alias("date"), F.col("net_flow").alias("base")), m.macro(), 30).select("asset_id", "date", F.round("corr_30", 6).alias("corr_30"))


register(
    "ewma_latency",
    sql(
        f"SELECT symbol, {R('arg_max(e, i)')} AS ewma FROM e GROUP BY symbol",
        recursive=True,
        ctes="""n AS (SELECT event_type AS symbol, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS i FROM events),
e AS (SELECT symbol, i, value AS e FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, e.e * 0.9::DOUBLE + n.value * (1 - 0.9::DOUBLE) FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)""",
    ),
)(lambda m: ind.ema_fold(m.ticks(), "price", 0.9, by="symbol").select("symbol", F.round("ewma", 6).alias("ewma")))
