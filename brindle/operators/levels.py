"""Support and resistance factors.

Every detector takes bars and gives rows (symbol, price, factor_type, strength, direction). Levels meet bars
by price bucket; the other detectors use windows and aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.ranks import Bounds, counted
from brindle.functions.rolling import full, last_row, ratio, series, tail
from brindle.operators.kernels import peaks

FACTOR = ["symbol", "price", "factor_type", "strength", "direction"]
#: Weights of the factor types in a zone's score: fixed values.
WEIGHTS = {
    "historical_sr": 0.18,
    "volume_profile": 0.15,
    "fibonacci": 0.12,
    "moving_average": 0.10,
    "round_number": 0.08,
    "etf_flow_pivot": 0.12,
    "open_interest": 0.10,
    "pivot_point": 0.08,
    "gap_level": 0.04,
    "swing_point": 0.03,
}
#: Retracement levels and their strengths: fixed values.
FIBONACCI = {0.0: 0.5, 0.236: 0.5, 0.382: 0.7, 0.5: 0.9, 0.618: 0.9, 0.786: 0.7, 1.0: 0.5}


def current(bars: DataFrame) -> DataFrame:
    """symbol, cur: the last close."""
    return bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("cur"))


def swings(bars: DataFrame) -> DataFrame:
    """swing_high and swing_low: strictly beyond two bars on either side."""

    def beyond(x: str, up: bool) -> Column:
        others = [F.lag(x, k).over(series()) for k in (1, 2)] + [F.lead(x, k).over(series()) for k in (1, 2)]
        tests = [F.col(x) > o if up else F.col(x) < o for o in others]
        return F.coalesce(tests[0] & tests[1] & tests[2] & tests[3], F.lit(False))

    return bars.withColumns({"swing_high": beyond("high", True), "swing_low": beyond("low", False)})


def gaps(bars: DataFrame, mode: str = "previous_bar") -> DataFrame:
    """Bars that gap away from the one before: gap (up, down), previous (its high or low), and the bar.

    mode `gap_rows` takes the level from the previous gap of the same direction instead.
    """
    df = bars.withColumns({"_ph": F.lag("high").over(series()), "_pl": F.lag("low").over(series())})
    df = df.withColumn("gap", F.when(F.col("low") > F.col("_ph"), "up").when(F.col("high") < F.col("_pl"), "down")).filter(F.col("gap").isNotNull())
    if mode == "gap_rows":
        own = Window.partitionBy("symbol", "gap").orderBy("ts")
        df = df.withColumns({"_ph": F.lag("high").over(own), "_pl": F.lag("low").over(own)})
    return df.withColumn("previous", F.when(F.col("gap") == "up", F.col("_ph")).otherwise(F.col("_pl"))).drop("_ph", "_pl")


def touches(levels: DataFrame, bars: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """levels (symbol, price) with touches: bars whose high or low lies within the tolerance of the price.

    Nothing is matched: the levels of a symbol are numbered by price, and what a high or a low touches is a run of those
    numbers, since both bounds rise with the price. The ends of the runs come from counting the bounds below each value,
    the touches from adding up where runs begin and end; a bar's two runs are taken together where they meet. Equal bars
    are one row with their number. So work grows with bars and levels, not with their pairs. Levels under 0 touch nothing.
    """
    own = levels.select("symbol", "price").distinct().filter("price >= 0").withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy("price")))
    same = bars.groupBy("symbol", "low", "high").agg(F.count(F.lit(1)).alias("_n"))
    values = same.select("*", F.explode(F.array("low", "high")).alias("_v")).filter("_v is not null")
    low, high = (own.select("symbol", (F.col("price") * (1 + t)).alias("_bound")) for t in (-tolerance, tolerance))
    values = counted(values, "_v", Bounds(low, "_bound", "_to", True), Bounds(high, "_bound", "_from", False))
    runs = values.groupBy("symbol", "low", "high", "_n").agg(F.min(F.struct("_v", "_from", "_to")).alias("a"), F.max(F.struct("_v", "_from", "_to")).alias("b"))
    ends = lambda a, b: F.array(F.struct((a + 1).alias("_k"), F.col("_n").alias("d")), F.struct((b + 1).alias("_k"), (-F.col("_n")).alias("d")))
    meet = F.col("b._from") <= F.col("a._to")
    steps = F.when(meet, ends(F.col("a._from"), F.col("b._to"))).otherwise(F.concat(ends(F.col("a._from"), F.col("a._to")), ends(F.col("b._from"), F.col("b._to"))))
    steps = runs.select("symbol", F.explode(steps).alias("_e")).groupBy("symbol", F.col("_e._k").alias("_k")).agg(F.sum("_e.d").alias("_d"))
    ahead = Window.partitionBy("symbol").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    hit = own.join(steps, ["symbol", "_k"], "full").select("symbol", "price", F.sum(F.coalesce("_d", F.lit(0))).over(ahead).alias("touches")).filter("price is not null")
    return levels.join(hit, ["symbol", "price"], "left").withColumn("touches", F.coalesce("touches", F.lit(0)))


def historical_sr(bars: DataFrame) -> DataFrame:
    """Fractal swings, stronger with touches and with recency of the last bar at that price."""
    df = swings(bars).withColumns({"_i": F.row_number().over(series()), "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    recency = lambda x: F.max("_i").over(Window.partitionBy("symbol", x))
    highs = df.withColumn("_last", recency("high")).filter("swing_high").select("symbol", F.col("high").alias("price"), "_last", "_n", F.lit("resistance").alias("direction"))
    lows = df.withColumn("_last", recency("low")).filter("swing_low").select("symbol", F.col("low").alias("price"), "_last", "_n", F.lit("support").alias("direction"))
    found = touches(highs.unionByName(lows), bars)
    weight = 0.5 + 0.5 * F.col("_last") / F.col("_n")
    return found.select("symbol", "price", F.lit("historical_sr").alias("factor_type"), F.least(F.lit(1.0), F.col("touches") / 5 * weight).alias("strength"), "direction")


def swing_points(bars: DataFrame, half: int = 10) -> DataFrame:
    """Extremes of the bars on both sides."""
    frame = series().rowsBetween(-half, half)
    df = bars.withColumns({"_hi": F.max("high").over(frame), "_lo": F.min("low").over(frame), "_n": F.count("high").over(frame)}).filter(F.col("_n") == 2 * half + 1)
    make = lambda x, d: df.filter(F.col(x) == F.col("_hi" if x == "high" else "_lo")).select("symbol", F.col(x).alias("price"), F.lit("swing_point").alias("factor_type"), F.lit(0.6).alias("strength"), F.lit(d).alias("direction"))
    return make("high", "resistance").unionByName(make("low", "support"))


def volume_profile(bars: DataFrame) -> DataFrame:
    """symbol, first_bin, last_bin, price (middle), volume: runs of neighbouring bins that the same bars overlap, each bar's volume counted in every bin.

    Bins are half a percent of the lowest price wide, at least ten (ten where that price is 0 or less). However many they
    are, a bar only adds its volume at its first bin and takes it away after its last; sums between are exact decimals.
    A symbol whose price never moves has no profile, and neither has one without volume.
    """
    b = bars.groupBy("symbol").agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"), F.sum("volume").alias("_all")).filter("_hi > _lo and _all > 0").drop("_all")
    b = b.withColumn("_edges", F.greatest(F.lit(10), F.floor(ratio(F.col("_hi") - F.col("_lo"), F.col("_lo") * 0.005))))
    b = b.withColumn("_step", (F.col("_hi") - F.col("_lo")) / (F.col("_edges") - 1))
    place = lambda x: F.least(F.greatest(F.floor((F.col(x) - F.col("_lo")) / F.col("_step")) + 1, F.lit(1)), F.col("_edges"))
    df = bars.join(b, "symbol").withColumns({"_from": place("low") - 1, "_to": place("high") - 1}).filter(F.col("_from") <= F.col("_edges") - 2)
    stop = F.least(F.greatest("_to", "_from"), F.col("_edges") - 2) + 1
    amount = F.col("volume").cast("decimal(28,8)")
    ends = F.explode(F.array(F.struct(F.col("_from").alias("bin"), amount.alias("v"), F.lit(1).alias("n")), F.struct(stop.alias("bin"), (-amount).alias("v"), F.lit(-1).alias("n"))))
    df = df.select("symbol", "_lo", "_step", ends.alias("_e")).groupBy("symbol", "_lo", "_step", F.col("_e.bin").alias("first_bin")).agg(F.sum("_e.v").alias("_v"), F.sum("_e.n").alias("_c"))
    runs = Window.partitionBy("symbol").orderBy("first_bin")
    df = df.withColumns({"last_bin": F.lead("first_bin").over(runs) - 1, "volume": F.sum("_v").over(runs).cast("double"), "_c": F.sum("_c").over(runs)}).filter("_c > 0")
    return df.select("symbol", "first_bin", "last_bin", (F.col("_lo") + ((F.col("first_bin") + F.col("last_bin")) / 2 + 0.5) * F.col("_step")).alias("price"), "volume")


def volume_peaks(bars: DataFrame) -> DataFrame:
    """Peaks of the volume profile with a prominence of one population deviation over all bins.

    A symbol's profile is one group: it has no more runs than bins, 200 for each time that its highest price is its lowest, however many bars fill them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_bin")
        first, last, volume, price = (pdf[c].to_numpy() for c in ("first_bin", "last_bin", "volume", "price"))
        gap = np.flatnonzero(np.concatenate([[first[0] > 0], first[1:] > last[:-1] + 1]))  # bins without bars are runs of 0
        before = np.concatenate([[-1], last[:-1]])
        size = np.concatenate([last - first + 1, first[gap] - before[gap] - 1])
        order = np.argsort(np.concatenate([first, before[gap] + 1]), kind="stable")
        first, size = np.concatenate([first, before[gap] + 1])[order], size[order]
        y, at = np.concatenate([volume, np.zeros(len(gap))])[order], np.concatenate([price, np.full(len(gap), np.nan)])[order]
        new = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))  # equal neighbours are one plateau
        share = np.add.reduceat(size, new)
        middle = np.add.reduceat(at * size, new) / share
        heights = y[new]
        mean = (heights * share).sum() / share.sum()
        found = peaks(heights, float(np.sqrt((share * np.square(heights - mean)).sum() / share.sum())))
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "price": middle[found], "factor_type": "volume_profile", "strength": heights[found] / heights.max(), "direction": "pivot"})

    return volume_profile(bars).groupBy("symbol").applyInPandas(run, "symbol string, price double, factor_type string, strength double, direction string")


def fibonacci(bars: DataFrame, n: int = 60) -> DataFrame:
    """Retracements of the range of the last n bars."""
    last = tail(bars, n).groupBy("symbol").agg(F.max("high").alias("_hi"), F.min("low").alias("_lo"), F.max_by("close", "ts").alias("cur"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(s).alias("strength")) for k, s in FIBONACCI.items()]))
    df = last.select("symbol", "cur", "_hi", "_lo", levels.alias("_f")).withColumn("price", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (1 - F.col("_f.level")))
    return df.select("symbol", "price", F.lit("fibonacci").alias("factor_type"), F.col("_f.strength").alias("strength"), F.when(F.col("price") < F.col("cur"), "support").otherwise("resistance").alias("direction"))


def moving_averages(bars: DataFrame) -> DataFrame:
    """The last 20, 50, 100 and 200 bar means, stronger near the close and for long periods."""
    periods = (20, 50, 100, 200)
    df = last_row(bars.withColumns({f"_{n}": full(F.avg, "close", n) for n in periods}))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_{n}").alias("price")) for n in periods]))
    df = df.select("symbol", F.col("close").alias("cur"), rows.alias("_m")).select("symbol", "cur", "_m.*").filter(F.col("price").isNotNull())
    base = F.greatest(F.lit(0.3), 1 - 2 * ratio(F.abs(F.col("price") - F.col("cur")), F.col("cur")))
    strength = F.least(F.lit(1.0), base * F.when(F.col("n") >= 200, 1.2).when(F.col("n") >= 100, 1.1).otherwise(1.0))
    return df.select("symbol", "price", F.lit("moving_average").alias("factor_type"), strength.alias("strength"), F.when(F.col("price") < F.col("cur"), "support").otherwise("resistance").alias("direction"))


def round_numbers(bars: DataFrame, interval: float | None = None) -> DataFrame:
    """Multiples of an interval that fits the price, inside the range of the bars."""
    df = bars.groupBy("symbol").agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"), F.max_by("close", "ts").alias("cur"))
    step = F.lit(interval) if interval else F.when(F.col("cur") >= 100000, 10000.0).when(F.col("cur") >= 10000, 1000.0).otherwise(100.0)
    df = df.withColumn("_step", step)
    first, last = F.ceil(F.col("_lo") / F.col("_step")), F.floor(F.col("_hi") / F.col("_step"))
    df = df.filter(first <= last).select("symbol", "cur", "_step", F.explode(F.sequence(first, last)).alias("_k"))
    strength = F.when(F.col("_k") % 10 == 0, 0.8).when(F.col("_k") % 5 == 0, 0.6).otherwise(0.4)
    price = F.col("_k") * F.col("_step")
    return df.select("symbol", price.alias("price"), F.lit("round_number").alias("factor_type"), strength.alias("strength"), F.when(price < F.col("cur"), "support").otherwise("resistance").alias("direction"))


def pivot_points(bars: DataFrame) -> DataFrame:
    """Floor pivots of the last finished bar, which is the one before the last."""
    b = last_row(bars, k=2)
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    p = (h + lo + c) / 3
    points = [("pivot", p, 0.8), ("resistance", 2 * p - lo, 0.6), ("resistance", p + (h - lo), 0.5), ("support", 2 * p - h, 0.6), ("support", p - (h - lo), 0.5)]
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), x.alias("price"), F.lit(s).alias("strength")) for d, x, s in points]))
    return b.select("symbol", rows.alias("_p")).select("symbol", "_p.price", F.lit("pivot_point").alias("factor_type"), "_p.strength", "_p.direction")


def gap_levels(bars: DataFrame, mode: str = "gap_rows") -> DataFrame:
    """Gaps as support (up) or resistance (down)."""
    df = gaps(bars, mode).filter(F.col("previous").isNotNull())
    return df.select("symbol", F.col("previous").alias("price"), F.lit("gap_level").alias("factor_type"), F.lit(0.7).alias("strength"), F.when(F.col("gap") == "up", "support").otherwise("resistance").alias("direction"))


def flow_pivots(bars: DataFrame, flows: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Levels of the days whose net flow (symbol, date, flow) is far from its mean: the middle of the day's mean high and low."""
    spread = flows.groupBy("symbol").agg(F.avg("flow").alias("_mean"), F.stddev_samp("flow").alias("_std"))
    spikes = flows.join(spread, "symbol").withColumn("_z", ratio(F.col("flow") - F.col("_mean"), F.col("_std"))).filter(F.abs("_z") > threshold)
    days = bars.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.avg("high").alias("_h"), F.avg("low").alias("_l"))
    df = spikes.join(days, ["symbol", "date"])
    return df.select("symbol", ((F.col("_h") + F.col("_l")) / 2).alias("price"), F.lit("etf_flow_pivot").alias("factor_type"), F.least(F.lit(1.0), F.abs("_z") / 3).alias("strength"), F.when(F.col("flow") > 0, "support").otherwise("resistance").alias("direction"))


def open_interest_levels(oi: DataFrame, cur: Column, many: bool = True) -> DataFrame:
    """Prices with open interest two deviations above the mean; within 1 % of the current price they are magnets. many: bin to tens first."""
    if many:
        oi = oi.groupBy(F.bround("price", -1).alias("price")).agg(F.sum("open_interest").alias("open_interest"))
    stats = oi.agg(F.avg("open_interest").alias("_m"), F.stddev_samp("open_interest").alias("_s"), F.max("open_interest").alias("_top"))
    df = oi.join(F.broadcast(stats)).filter(F.col("open_interest") >= F.col("_m") + 2 * F.col("_s"))  # one row of statistics
    near = ratio(F.abs(F.col("price") - cur), cur) <= 0.01
    direction = F.when(near, "magnet").when(F.col("price") < cur, "support").otherwise("resistance")
    return df.select("price", F.lit("open_interest").alias("factor_type"), ratio(F.col("open_interest"), F.col("_top")).alias("strength"), direction.alias("direction"))


def all_factors(bars: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """The rows of every detector."""
    out = historical_sr(bars)
    for more in (swing_points(bars), volume_peaks(bars), fibonacci(bars), moving_averages(bars), round_numbers(bars), pivot_points(bars), gap_levels(bars)):
        out = out.unionByName(more)
    return out if flows is None else out.unionByName(flow_pivots(bars, flows))


def support_resistance(bars: DataFrame, window: int = 14, digits: int = -2) -> DataFrame:
    """symbol, cur, support, support_count, resistance, resistance_count: nearest rounded pivots below and above the close."""
    frame = series().rowsBetween(-(window // 2), (window - 1) // 2)
    df = bars.withColumns({"_lo": F.min("low").over(frame), "_hi": F.max("high").over(frame), "_n": F.count("low").over(frame)}).filter(F.col("_n") == window)
    lows = df.filter(F.col("low") == F.col("_lo")).select("symbol", F.bround("low", digits).alias("level"))
    highs = df.filter(F.col("high") == F.col("_hi")).select("symbol", F.bround("high", digits).alias("level"))
    counts = lows.unionByName(highs).groupBy("symbol", "level").agg(F.count(F.lit(1)).alias("n")).join(current(bars), "symbol")
    below, above = F.col("level") < F.col("cur"), F.col("level") > F.col("cur")
    pick = lambda f, c, x: f(F.when(c, F.col(x)))
    return counts.groupBy("symbol", "cur").agg(
        pick(F.max, below, "level").alias("support"),
        F.max_by(F.when(below, F.col("n")), F.when(below, F.col("level"))).alias("support_count"),
        pick(F.min, above, "level").alias("resistance"),
        F.min_by(F.when(above, F.col("n")), F.when(above, F.col("level"))).alias("resistance_count"),
    )
