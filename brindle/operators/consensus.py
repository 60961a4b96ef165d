"""Agreement between sources and between series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rolling import full, last_row, ratio, series
from brindle.functions.scalars import banded

#: Reliability of sources, 0.5 for others: fixed values.
RELIABILITY = {
    "binance": 0.98,
    "binance_us": 0.97,
    "coingecko": 0.95,
    "kraken": 0.95,
    "blockchain_info": 0.85,
    "blockchair": 0.90,
    "synthetic_mvrv": 0.70,
    "synthetic_sopr": 0.65,
}
CONFIDENCE = [(0.9, "High Confidence"), (0.7, "Moderate Confidence"), (0.5, "Low Confidence")]


def reliability(source: Column) -> Column:
    """The weight of a source."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RELIABILITY.items() for x in kv])[source], F.lit(0.5))


def price_consensus(quotes: DataFrame, key: str = "item", weight: Column | None = None) -> DataFrame:
    """key, price, spread_pct, confidence, label, n_sources, n_outliers of the positive quotes (key, source, value).

    Quotes over 2 % from the median are left out, unless all are. Medians are exact, per key; the medians meet the
    quotes in a join, so a key's quotes are never gathered in a window.
    """
    weight = reliability(F.col("source")) if weight is None else weight
    q = quotes.filter("value > 0").withColumn("_w", weight)
    mid = q.groupBy(key).agg(F.median("value").alias("_median"))
    q = q.join(mid, key).withColumn("_ok", F.abs(F.col("value") - F.col("_median")) / F.col("_median") <= 0.02)
    ok = lambda x: F.when(F.col("_ok"), x)
    sums = q.groupBy(key).agg(
        F.sum(ok(F.col("value") * F.col("_w"))).alias("_s"), F.sum(ok(F.col("_w"))).alias("_sw"), F.max(ok(F.col("value"))).alias("_hi"), F.min(ok(F.col("value"))).alias("_lo"), F.count_if("_ok").alias("_n"),
        F.sum(F.col("value") * F.col("_w")).alias("_as"), F.sum("_w").alias("_asw"), F.max("value").alias("_ahi"), F.min("value").alias("_alo"), F.count(F.lit(1)).alias("n_sources"),
    )
    none = F.col("_n") == 0
    pick = lambda a, b: F.when(none, F.col(a)).otherwise(F.col(b))
    price = ratio(pick("_as", "_s"), pick("_asw", "_sw"))
    spread = ratio(pick("_ahi", "_hi") - pick("_alo", "_lo"), price) * 100
    used = pick("n_sources", "_n")
    conf = F.greatest(F.lit(0.0), 1 - spread / 10) * F.when(used == 1, 0.8).otherwise(1.0)
    return sums.select(key, price.alias("price"), spread.alias("spread_pct"), conf.alias("confidence"), banded(conf, CONFIDENCE, "Unreliable").alias("label"), "n_sources", (F.col("n_sources") - used).alias("n_outliers"))


def metric_agreement(df: DataFrame, value: str = "value", confidence: str = "confidence", check: str = "validation") -> DataFrame:
    """df with final_value, final_confidence, deviation, agreement of a metric against its validation mean; unvalidated where that is null."""
    dev = ratio(F.abs(F.col(value) - F.col(check)), F.abs(F.when(F.col(check) == 0, 1.0).otherwise(F.col(check))))
    c = F.col(confidence)
    agreement = F.when(F.col(check).isNull(), "unvalidated").when(dev < 0.05, "strong").when(dev < 0.15, "moderate").otherwise("weak")
    final = F.when(dev < 0.05, 0.7 * F.col(value) + 0.3 * F.col(check)).when(dev < 0.15, 0.9 * F.col(value) + 0.1 * F.col(check)).otherwise(F.col(value))
    conf = F.when(F.col(check).isNull(), c).when(dev < 0.05, c + (1 - c) * 0.5).when(dev < 0.15, c).otherwise(c * 0.7)
    return df.withColumns({"deviation": dev, "agreement": agreement, "final_value": final, "final_confidence": conf})


def source_agreement(a: Column, b: Column) -> Column:
    """100, 85, 50 or 20 by the relative difference of b from a; 20 where a is zero."""
    diff = F.when(a == 0, 100.0).otherwise(F.abs(ratio(a - b, a)))
    return F.when(diff < 0.05, 100).when(diff < 0.15, 85).when(diff < 0.5, 50).otherwise(20)


def rolling_correlation(base: DataFrame, others: DataFrame, n: int = 30) -> DataFrame:
    """asset_id, date, corr_n of base (date, base) with every series of others (date, asset_id, price) over their common dates."""
    df = others.join(base, "date").filter(F.col("base").isNotNull() & F.col("price").isNotNull())
    w = series("asset_id", "date").rowsBetween(1 - n, 0)
    return df.withColumn(f"corr_{n}", F.when(F.count("price").over(w) == n, F.corr("base", "price").over(w)))


def correlation_status(corr: DataFrame, inverse: list[str], direct: list[str], n: int = 30) -> DataFrame:
    """asset_id, correlation, status from the last rolling correlation; under n common rows the overlap is insufficient.

    inverse assets are judged like a currency index, direct ones like a share index.
    """
    last = last_row(corr, by="asset_id", order="date")
    v, a = F.col(f"corr_{n}"), F.col("asset_id")
    status = (
        F.when(v.isNull(), "insufficient_overlap")
        .when(a.isin(inverse) & (v > 0.2), "decoupling_bullish")
        .when(a.isin(inverse) & (v < -0.8), "tightly_coupled")
        .when(a.isin(direct) & (v < -0.2), "divergence_warning")
        .when(a.isin(direct) & (v > 0.9), "high_beta")
        .otherwise("normal")
    )
    return last.select("asset_id", v.alias("correlation"), status.alias("status"))


def macro_vote(status: DataFrame) -> DataFrame:
    """One row: regime and confidence from the statuses; UNKNOWN and 0 without any."""
    any_ = lambda s: F.coalesce(F.bool_or(F.col("status").contains(s)), F.lit(False))
    out = status.agg(any_("decoupling").alias("_d"), any_("divergence").alias("_v"), F.count(F.lit(1)).alias("_n"))
    regime = F.when(F.col("_n") == 0, "UNKNOWN").when(F.col("_d"), "DECOUPLING_BULLISH").when(F.col("_v"), "DIVERGENCE").otherwise("COUPLED")
    return out.select(regime.alias("macro_regime"), F.when(F.col("_n") == 0, 0.0).otherwise(0.75).alias("confidence"))


def latest_change(df: DataFrame) -> DataFrame:
    """asset_id, price, change_pct, trend of the last row against the one before."""
    w = series("asset_id", "date")
    df = df.withColumn("_p", F.lag("price").over(w))
    last = last_row(df, by="asset_id", order="date")
    change = ratio(F.col("price") - F.col("_p"), F.col("_p")) * 100
    return last.select("asset_id", "price", change.alias("change_pct"), F.when(change > 0, "up").when(change < 0, "down").otherwise("flat").alias("trend"))


def rolling_mean(df: DataFrame, x: str, n: int, by: str, order: str) -> DataFrame:
    """df with the mean of the last n rows of each series."""
    return df.withColumn(f"{x}_mean_{n}", full(F.avg, x, n, Window.partitionBy(by).orderBy(order)))
