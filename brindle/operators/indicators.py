"""Technical indicators. Each function adds columns to bars (symbol, ts, open, high, low, close, volume); all windows share one partitioning and order, so a chain of them costs one shuffle and one sort."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rolling import change, full, ratio, series



def sma(df: DataFrame, *periods: int, x: str = "close") -> DataFrame:
    """sma_n for each period."""
    return df.withColumns({f"sma_{n}": full(F.avg, x, n) for n in periods})


def _strength(gain: Column, loss: Column) -> Column:
    return F.when(loss == 0, F.when(gain > 0, 100.0)).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def rsi(df: DataFrame, n: int = 14, out: str | None = None, first_is_zero: bool = True) -> DataFrame:
    """Relative strength from simple means of gains and losses; 100 without losses, null without either.

    first_is_zero: the first row counts as no change, so the value starts one row earlier.
    """
    df = df.withColumn("_d", F.col("close") - F.lag("close").over(series()))
    up, down = F.greatest(F.col("_d"), F.lit(0.0)), F.greatest(-F.col("_d"), F.lit(0.0))
    if first_is_zero:
        up, down = F.when(F.col("_d").isNull(), 0.0).otherwise(up), F.when(F.col("_d").isNull(), 0.0).otherwise(down)
    else:
        up, down = F.when(F.col("_d").isNotNull(), up), F.when(F.col("_d").isNotNull(), down)
    df = df.withColumns({"_up": up, "_down": down})
    return df.withColumn(out or f"rsi_{n}", _strength(full(F.avg, "_up", n), full(F.avg, "_down", n))).drop("_d", "_up", "_down")


def true_range(df: DataFrame, first_is_null: bool = False) -> DataFrame:
    """tr: the largest of high - low and the distances to the previous close; the first row is high - low, or null."""
    prev = F.lag("close").over(series())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return df.withColumn("tr", F.when(prev.isNull(), None).otherwise(tr) if first_is_null else tr)


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """atr_n: mean true range."""
    return true_range(df).withColumn(f"atr_{n}", full(F.avg, "tr", n)).drop("tr")


def atr_pct(df: DataFrame, n: int = 14) -> DataFrame:
    """atr_pct: mean true range as a share of the close; the first true range is null here."""
    return true_range(df, first_is_null=True).withColumn("atr_pct", ratio(full(F.avg, "tr", n), F.col("close"))).drop("tr")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """bb_upper and bb_lower: mean and k sample deviations."""
    mean, dev = full(F.avg, "close", n), full(F.stddev_samp, "close", n)
    return df.withColumns({"bb_upper": mean + k * dev, "bb_lower": mean - k * dev})


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """adx: mean directional index; movements are summed and the range is averaged, which leaves the index unchanged."""
    up, down = F.col("high") - F.lag("high").over(series()), F.lag("low").over(series()) - F.col("low")
    df = df.withColumns({"_up": F.when((up > down) & (up > 0), up).otherwise(0.0), "_dn": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    df = true_range(df).withColumn("_atr", full(F.avg, "tr", n))
    df = df.withColumns({"_pdi": 100 * ratio(full(F.sum, "_up", n), F.col("_atr")), "_ndi": 100 * ratio(full(F.sum, "_dn", n), F.col("_atr"))})
    df = df.withColumn("_dx", 100 * ratio(F.abs(F.col("_pdi") - F.col("_ndi")), F.col("_pdi") + F.col("_ndi")))
    return df.withColumn("adx", full(F.avg, "_dx", n)).drop("_up", "_dn", "_atr", "_pdi", "_ndi", "_dx", "tr")


def adx_proxy(df: DataFrame, n: int = 14) -> DataFrame:
    """adx_proxy: mean absolute n-row change, in percent."""
    df = df.withColumn("_m", F.abs(change("close", n)))
    return df.withColumn("adx_proxy", 100 * full(F.avg, "_m", n)).drop("_m")


def momentum(df: DataFrame, *lags: int, x: str = "close", prefix: str = "roc") -> DataFrame:
    """prefix_k: relative change over k rows."""
    return df.withColumns({f"{prefix}_{k}": change(x, k) for k in lags})


def log_returns(df: DataFrame) -> DataFrame:
    """log_ret."""
    r = ratio(F.col("close"), F.lag("close").over(series()))
    return df.withColumn("log_ret", F.when(r > 0, F.ln(r)))


def volatility(df: DataFrame, n: int = 20, periods: int = 365) -> DataFrame:
    """vol_n: annualised deviation of the last n log returns."""
    df = log_returns(df)
    return df.withColumn(f"vol_{n}", full(F.stddev_samp, "log_ret", n) * math.sqrt(periods))


def drawdown(df: DataFrame) -> DataFrame:
    """peak and drawdown from the running maximum."""
    peak = F.max("close").over(series().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"peak": peak, "drawdown": ratio(F.col("close") - peak, peak)})


def ml_features(df: DataFrame) -> DataFrame:
    """tech_rsi (0 to 1), tech_sma_dist and tech_volatility; nulls become 0."""
    df = df.withColumn("_d", F.col("close") - F.lag("close").over(series()))
    df = df.withColumns({"_up": F.coalesce(F.greatest(F.col("_d"), F.lit(0.0)), F.lit(0.0)), "_dn": F.coalesce(F.greatest(-F.col("_d"), F.lit(0.0)), F.lit(0.0))})
    gain, loss = full(F.avg, "_up", 14), full(F.avg, "_dn", 14)
    rs = gain / F.when(loss == 0, 1e-9).otherwise(loss)
    df = log_returns(df)
    return df.withColumns(
        {
            "tech_rsi": F.coalesce((100 - 100 / (1 + rs)) / 100, F.lit(0.0)),
            "tech_sma_dist": F.coalesce(ratio(F.col("close"), full(F.avg, "close", 20)) - 1, F.lit(0.0)),
            "tech_volatility": F.coalesce(full(F.stddev_samp, "log_ret", 14), F.lit(0.0)),
        }
    ).drop("_d", "_up", "_dn", "log_ret")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, block: int = 4096) -> DataFrame:
    """symbol, ts, macd, macd_signal, macd_hist: exponential means, a recursion that no frame aggregate gives.

    A series is cut into blocks, and each is computed with the block before it as a run-up. What came earlier counts
    (1 - 2 / (slow + 1)) ** block at most, which is below the precision of a double by far.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        line = pdf["close"].ewm(span=fast, adjust=False).mean() - pdf["close"].ewm(span=slow, adjust=False).mean()
        sig = line.ewm(span=signal, adjust=False).mean()
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "macd": line, "macd_signal": sig, "macd_hist": line - sig})[pdf["_own"]]

    ts = dict(df.dtypes)["ts"]
    rows = df.select("symbol", "ts", "close").withColumn("_i", F.row_number().over(series()) - 1)
    own = F.floor(F.col("_i") / block)
    places = F.array(F.struct(own.alias("_block"), F.lit(True).alias("_own")), F.struct((own + 1).alias("_block"), F.lit(False).alias("_own")))
    rows = rows.select("*", F.inline(places))
    return rows.groupBy("symbol", "_block").applyInPandas(run, f"symbol string, ts {ts}, macd double, macd_signal double, macd_hist double")


def ema_fold(df: DataFrame, x: str, weight: float, by: str = "source", order: str = "ts") -> DataFrame:
    """by, ewma: value after folding weight of the old and the rest of the new through each series in order.

    That is a sum in which a value counts by its rank from the end, so nothing is gathered; equal times go by value.
    """
    back = Window.partitionBy(by).orderBy(F.col(order).desc(), F.col(x).desc())
    rows = df.select(by, x, order).withColumns({"_r": F.row_number().over(back) - 1, "_first": F.lead(order).over(back).isNull()})
    share = F.pow(F.lit(weight), F.col("_r")) * F.when(F.col("_first"), 1.0).otherwise(1 - weight)
    return rows.groupBy(by).agg(F.sum(F.col(x) * share).alias("ewma"))


def technical_features(df: DataFrame) -> DataFrame:
    """The standard set: SMA 20/50/100/200, RSI 14, Bollinger 20, ATR 14, momentum 1 and 5, volume momentum 5."""
    df = bollinger(atr(rsi(sma(df, 20, 50, 100, 200))))
    return momentum(momentum(df, 1, 5), 5, x="volume", prefix="vol_mom")
