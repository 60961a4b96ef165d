"""Exact percentiles without a buffer of all values: a sketch brackets the ranks, and only what lies between is sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A sketch of this accuracy errs by one rank in so many; the bracket is five times as wide to both sides.
_ACCURACY = 10_000


def percentiles(df: DataFrame, x: str, shares: list[float], names: list[str], by: str = "symbol", whole: int = _ACCURACY) -> DataFrame:
    """by and a column for each share: the percentile of x, interpolated between ranks; null where x has no value.

    The values below the bracket are only counted. Those inside it, about a thousandth, are grouped before they are
    sorted, so equal values are one row. Series of up to `whole` values are sorted whole.
    """
    rows = df.select(by, F.col(x).cast("double").alias("_x")).filter("_x is not null")
    wide = 5 / _ACCURACY
    edges = [e for s in shares for e in (max(0.0, s - wide), min(1.0, s + wide))]
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", F.array(*map(F.lit, edges)), F.lit(_ACCURACY)).alias("_e"))
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("share"), F.get("_e", F.lit(2 * k)).alias("low"), F.get("_e", F.lit(2 * k + 1)).alias("high")) for k, s in enumerate(shares)])
    want = sizes.select(by, "_n", F.explode(parts).alias("_p")).select(by, "_n", "_p.*")
    want = want.withColumns({"low": F.when(F.col("_n") > whole, F.col("low")), "_rank": F.col("share") * (F.col("_n") - 1)})
    near = rows.join(want.select(by, "k", "low", F.when(F.col("_n") > whole, F.col("high")).alias("high")), by).filter("high is null or _x <= high")
    value = F.when(F.col("low").isNull() | (F.col("_x") >= F.col("low")), F.col("_x"))
    counts = near.groupBy(by, "k", value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))  # what lies below the bracket is the null value
    upto = F.sum("_c").over(Window.partitionBy(by, "k").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).join(want.select(by, "k", "_rank"), [by, "k"])
    first, second = F.floor("_rank"), F.ceil("_rank")
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    found = placed.groupBy(by, "k", "_rank").agg(at(first).alias("_a"), at(second).alias("_b"))
    exact = F.when(first == second, F.col("_a")).otherwise((second - F.col("_rank")) * F.col("_a") + (F.col("_rank") - first) * F.col("_b"))
    picked = found.withColumn("_y", exact).groupBy(by).agg(*[F.max(F.when(F.col("k") == k, F.col("_y"))).alias(n) for k, n in enumerate(names)])
    return df.select(by).distinct().join(picked, by, "left")
