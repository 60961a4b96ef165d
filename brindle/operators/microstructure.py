"""Order books and derivatives. A book is rows (snapshot, side bid or ask, price, qty); levels count from the best price."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rolling import ratio
from brindle.functions.scalars import banded


def levels(book: DataFrame) -> DataFrame:
    """book with level (1 is best), cum (quantity up to it) and best (price): bids from the highest price, asks from the lowest."""
    order = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("snapshot", "side").orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return book.withColumns({"level": F.row_number().over(w), "cum": F.sum("qty").over(upto), "best": F.first("price").over(upto)})


def imbalance(book: DataFrame, top: int = 5) -> DataFrame:
    """snapshot, imbalance, reading of the best levels."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("qty"))), F.lit(0.0))
    out = levels(book).filter(F.col("level") <= top).groupBy("snapshot").agg(side("bid").alias("_b"), side("ask").alias("_a"))
    x = F.coalesce(ratio(F.col("_b") - F.col("_a"), F.col("_b") + F.col("_a")), F.lit(0.0))
    reading = F.when(x > 0.2, "strong_bid").when(x > 0.05, "mild_bid").when(x < -0.2, "strong_ask").when(x < -0.05, "mild_ask").otherwise("balanced")
    return out.select("snapshot", x.alias("imbalance"), reading.alias("reading"))


def depth_weighted_price(book: DataFrame, target: float = 5.0) -> DataFrame:
    """snapshot, side, dwp: mean price at which an order of the target size would fill."""
    df = levels(book)
    fill = F.greatest(F.lit(0.0), F.least(F.col("qty"), target - (F.col("cum") - F.col("qty"))))
    return df.withColumn("_f", fill).groupBy("snapshot", "side").agg(F.coalesce(ratio(F.sum(F.col("price") * F.col("_f")), F.sum("_f")), F.lit(0.0)).alias("dwp"))


def gradient(book: DataFrame) -> DataFrame:
    """snapshot, side, gradient: slope of cumulated quantity over percent distance on the best 10 levels; 0 for under 5."""
    df = levels(book).withColumn("_d", F.abs(ratio(F.col("price") - F.col("best"), F.col("best"))) * 100).filter("level <= 10")
    slope = F.when((F.count(F.lit(1)) < 5) | (F.sum("_d") == 0), 0.0).otherwise(F.regr_slope("cum", "_d"))
    return df.groupBy("snapshot", "side").agg(slope.alias("gradient"))


def walls(book: DataFrame, times: float = 3.0) -> DataFrame:
    """snapshot, side, walls, nearest_wall: levels with over `times` the mean quantity of the snapshot."""
    mean = book.groupBy("snapshot").agg(F.avg("qty").alias("_m"))
    df = book.join(mean, "snapshot").filter(F.col("qty") > times * F.col("_m"))
    nearest = F.when(F.first("side") == "bid", F.max("price")).otherwise(F.min("price"))
    return df.groupBy("snapshot", "side").agg(F.count(F.lit(1)).alias("walls"), nearest.alias("nearest_wall"))


def spread(book: DataFrame) -> DataFrame:
    """snapshot, best_bid, best_ask, spread_pct, liquidity."""
    out = book.groupBy("snapshot").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("best_ask")).dropna()
    pct = ratio(F.col("best_ask") - F.col("best_bid"), F.col("best_bid")) * 100
    return out.select("snapshot", "best_bid", "best_ask", pct.alias("spread_pct"), F.when(pct < 0.01, "High").otherwise("Low").alias("liquidity"))


def flow_delta(book: DataFrame, within: float = 0.01) -> DataFrame:
    """snapshot, delta, bias: balance of the quantities within a share of the mid price."""
    best = book.groupBy("snapshot").agg(((F.max(F.when(F.col("side") == "bid", F.col("price"))) + F.min(F.when(F.col("side") == "ask", F.col("price")))) / 2).alias("_mid"))
    df = book.join(best, "snapshot").filter(F.abs(F.col("price") - F.col("_mid")) <= within * F.col("_mid"))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("qty"))), F.lit(0.0))
    out = df.groupBy("snapshot").agg(side("bid").alias("_b"), side("ask").alias("_a"))
    x = F.coalesce(ratio(F.col("_b") - F.col("_a"), F.col("_b") + F.col("_a")), F.lit(0.0))
    return out.select("snapshot", x.alias("delta"), F.when(x > 0.1, "bullish").when(x < -0.1, "bearish").otherwise("neutral").alias("bias"))


def liquidity_density(book: DataFrame, within: float = 0.005) -> DataFrame:
    """snapshot, density: mean of the two sides' quantity near their best price."""
    df = levels(book).filter(F.abs(F.col("price") - F.col("best")) <= within * F.col("best"))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("qty"))), F.lit(0.0))
    return df.groupBy("snapshot").agg(((side("bid") + side("ask")) / 2).alias("density"))


def heatmap(book: DataFrame, digits: int = -1, top: int | None = 5) -> DataFrame:
    """bucket, qty over all snapshots; the largest `top`, ties by bucket."""
    out = book.groupBy(F.bround("price", digits).alias("bucket")).agg(F.sum("qty").alias("qty"))
    return out if top is None else out.orderBy(F.col("qty").desc(), "bucket").limit(top)


def funding_proxy(df: DataFrame, spot: str = "spot", mark: str = "mark") -> DataFrame:
    """df with funding: annualised percent from the distance of mark to spot, 0 for no spot."""
    return df.withColumn("funding", F.when(F.col(spot) <= 0, 0.0).otherwise((F.col(mark) - F.col(spot)) / F.col(spot) * 3 * 365 * 100))


def rate_summary(df: DataFrame, x: str, by: str = "symbol", order: str = "ts", recent: int = 21, extreme: float = 0.001) -> DataFrame:
    """by, current, avg_recent, avg_all, trend, extreme of a rate history."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    out = df.withColumn("_k", F.row_number().over(w)).groupBy(by).agg(F.max(F.when(F.col("_k") == 1, F.col(x))).alias("current"), F.avg(F.when(F.col("_k") <= recent, F.col(x))).alias("avg_recent"), F.avg(x).alias("avg_all"))
    return out.withColumns({"trend": F.when(F.col("current") > F.col("avg_recent"), "increasing").otherwise("decreasing"), "extreme": F.abs("current") > extreme})


def first_last_change(df: DataFrame, x: str, by: str = "symbol", order: str = "ts") -> DataFrame:
    """by, change_pct from the first to the last value."""
    first, last = F.min_by(x, order), F.max_by(x, order)
    return df.groupBy(by).agg((ratio(last - first, first) * 100).alias("change_pct"))


def long_short(df: DataFrame, x: str, by: str = "symbol", order: str = "ts") -> DataFrame:
    """by, current, average, extreme, contrarian of a ratio of longs to shorts."""
    out = df.groupBy(by).agg(F.max_by(x, order).alias("current"), F.avg(x).alias("average"))
    c = F.col("current")
    return out.withColumns({"extreme": (c > 2) | (c < 0.5), "contrarian": F.when(c > 3, "bearish").when(c < 0.33, "bullish").otherwise("none")})


def taker_ratio(df: DataFrame, x: str, by: str = "symbol", order: str = "ts") -> DataFrame:
    """by, current, average, buyers_lead, pressure of a ratio of taker buys to sells."""
    out = df.groupBy(by).agg(F.max_by(x, order).alias("current"), F.avg(x).alias("average"))
    return out.withColumns({"buyers_lead": F.col("current") > 1, "pressure": F.when(F.col("current") > 1.5, "strong_buy").when(F.col("current") < 0.5, "strong_sell").otherwise("neutral")})


def magnets(df: DataFrame, price: str = "close") -> DataFrame:
    """df's keys with price_level, intensity, kind: five levels around the price."""
    base = F.bround(F.col(price) / 1000, 0) * 1000
    rows = [(base + 1000, 80), (base - 1000, 80), (base, 60), (F.col(price) * 1.05, 95), (F.col(price) * 0.95, 95)]
    arr = F.array(*[F.struct(p.alias("price_level"), F.lit(i).alias("intensity")) for p, i in rows])
    df = df.withColumn("_m", F.explode(arr))
    return df.select(*[c for c in df.columns if c != "_m"], "_m.price_level", "_m.intensity").withColumn("kind", F.when(F.col("price_level") > F.col(price), "above").otherwise("below"))


def cascade_risk(levels_: DataFrame, by: str = "symbol", price: str = "close", volatility: float = 0.02) -> DataFrame:
    """by, nearest, distance, probability, risk of the nearest magnet."""
    d = F.abs(F.col("price_level") - F.col(price)) / F.col(price)
    out = levels_.withColumn("_d", d).groupBy(by).agg(F.min(F.struct("_d", "price_level")).alias("_n"))
    p = F.when(F.col("_n._d") < volatility / 2, 0.9).when(F.col("_n._d") < volatility, 0.6).otherwise(0.2)
    return out.select(by, F.col("_n.price_level").alias("nearest"), F.col("_n._d").alias("distance"), p.alias("probability"), banded(p, [(0.7, "HIGH"), (0.4, "MEDIUM")], "LOW", strict=True).alias("risk"))
