"""As-of joins and forecast evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rolling import ratio, series


def asof(left: DataFrame, right: DataFrame, value: str, on: str = "ts", by: str | None = None, direction: str = "backward", tolerance: str | None = None, span: str = "1 day") -> DataFrame:
    """left with the value of right's last row at or before each row (backward), or first row after it (forward), however far away.

    Both sides are put in one order and the value is carried over by a window. The order is cut into spans, so a single
    long series is many groups; what is carried from one span to the next is one row a span, filled forward. A match
    further away than the tolerance, if one is given, is null. Rows of right with a null value are skipped.
    """
    keys = [by] if by else []
    after = direction == "forward"
    in_span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / _micros(span))
    r = right.filter(F.col(value).isNotNull()).select(*keys, F.col(on).cast("timestamp_ntz").alias("_t"), F.col(value).alias("_v")).withColumn("_g", in_span("_t"))
    seen = r.withColumn("_m", F.struct("_t", "_v"))
    rows = left.withColumns({"_row": F.struct(*left.columns), "_t": F.col(on).cast("timestamp_ntz"), "_g": in_span(on)}).select(*keys, "_t", "_g", "_row", F.lit(None).cast(seen.schema["_m"].dataType).alias("_m"), F.lit(0 if after else 1).alias("_side"))
    marks = seen.select(*keys, "_t", "_g", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_m", F.lit(1 if after else 0).alias("_side"))
    # at equal times a mark comes before the row when looking back, and after it when looking ahead
    order = [F.col("_t").desc(), F.col("_side")] if after else [F.col("_t"), F.col("_side")]
    inside = Window.partitionBy(*keys, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(marks).withColumn("_m", F.last("_m", True).over(inside)).filter(F.col("_row").isNotNull())
    # one row for each span: the mark that it hands on, and what it is handed
    edge = (F.min if after else F.max)("_m")
    spans = seen.select(*keys, "_g", "_m").unionByName(rows.select(*keys, "_g", "_m")).groupBy(*keys, "_g").agg(edge.alias("_edge"))
    others = Window.partitionBy(*keys).orderBy(F.col("_g").desc() if after else F.col("_g")).rowsBetween(Window.unboundedPreceding, -1)
    handed = spans.select(*[F.col(k).alias(f"_by_{k}") for k in keys], F.col("_g").alias("_span"), F.last("_edge", True).over(others).alias("_handed"))
    same = F.col("_g") == F.col("_span")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    out = out.join(handed, same, "left").withColumn("_m", F.coalesce("_m", "_handed"))
    got = F.col("_m._v")
    if tolerance:
        away = F.abs(F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_m._t").cast("timestamp")))
        got = F.when(away <= _micros(tolerance), got)
    return out.select("_row.*", got.alias(f"{'next' if after else 'asof'}_{value}"))


def _micros(length: str) -> int:
    n, unit = length.split()
    return int(n) * {"minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def evaluate_predictions(predictions: DataFrame, closes: DataFrame, tolerance: str | None = None) -> DataFrame:
    """predictions (ts, direction, price_target) with current, next, hit, error and edge.

    A return of 0 or less counts as BEARISH; NEUTRAL never hits and its edge is that of a short.
    """
    df = asof(asof(predictions, closes, "close", tolerance=tolerance), closes, "close", direction="forward", tolerance=tolerance)
    move = ratio(F.col("next_close") - F.col("asof_close"), F.col("asof_close"))
    hit = F.col("direction") == F.when(move > 0, "BULLISH").otherwise("BEARISH")
    df = df.filter(F.col("asof_close").isNotNull() & F.col("next_close").isNotNull())
    return df.withColumns({"hit": hit, "error": F.col("price_target") - F.col("next_close"), "edge": F.when(F.col("direction") == "BULLISH", move).otherwise(-move)})


def summarize_predictions(evaluated: DataFrame) -> DataFrame:
    """One row: n, accuracy, rmse, mean_edge_pct."""
    return evaluated.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), (F.avg("edge") * 100).alias("mean_edge_pct"))


def bars_per_day(bars: DataFrame) -> DataFrame:
    """symbol, bars_per_day: a day over the median step, rounded half to even, 1 at least."""
    step = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(series()).cast("timestamp"))
    out = bars.withColumn("_s", step).groupBy("symbol").agg(F.median("_s").alias("_m"))
    return out.select("symbol", F.greatest(F.lit(1), F.bround(ratio(F.lit(86400.0), F.col("_m")), 0)).cast("long").alias("bars_per_day"))
