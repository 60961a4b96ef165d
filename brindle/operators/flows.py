"""Normalising prices, flows and macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rolling import ratio, series


def normalize_prices(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Lower-case columns, dates and doubles (null where they can't be read), the first row of each date."""
    df = df.toDF(*[c.lower() for c in df.columns])
    df = df.withColumns({"date": F.col("date").cast("string").try_cast("date"), **{c: F.col(c).cast("string").try_cast("double") for c in ("open", "high", "low", "close", "volume") if c in df.columns}})
    keys = [ordinal.lower()] if ordinal else [c for c in ("open", "high", "low", "close") if c in df.columns]
    w = Window.partitionBy("date").orderBy(*keys)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", *([ordinal.lower()] if ordinal else []))


def pivot_flows(long: DataFrame, fields: list[str]) -> DataFrame:
    """date, ticker and one mean for each field; the fields are given, so no scan is needed to find them."""
    return long.groupBy("date", "ticker").pivot("field", fields).agg(F.avg("value"))


def flow_delta(long: DataFrame) -> DataFrame:
    """long (one row for each date, ticker and field) with delta: change from the row before, 0 for the first."""
    w = Window.partitionBy("ticker", "field").orderBy("date")
    return long.withColumn("delta", F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)))


def normalize_macro(df: DataFrame) -> DataFrame:
    """date, asset_id, price, change_pct: percent change, 0 for the first."""
    w = series("asset_id", "date")
    return df.select("date", "asset_id", "price", F.coalesce((ratio(F.col("price"), F.lag("price").over(w)) - 1) * 100, F.lit(0.0)).alias("change_pct"))


def lowered(df: DataFrame) -> DataFrame:
    """df with its column names in lower case."""
    return df.toDF(*[c.lower() for c in df.columns])


def resolve_column(columns: list[str], wanted: list[str]) -> str | None:
    """The first of the wanted names that columns has, whatever the case."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[w.lower()] for w in wanted if w.lower() in by_lower), None)


def select_flows(flows: DataFrame, start: str | None = None, end: str | None = None, ticker: str | None = None) -> DataFrame:
    """Rows between two dates, both included, of one ticker in any case. All three reach the scan."""
    if start:
        flows = flows.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        flows = flows.filter(F.col("date") <= F.lit(end).cast("date"))
    return flows.filter(F.col("ticker") == ticker.upper()) if ticker else flows


def top_flows(flows: DataFrame, n: int = 3, largest: bool = True) -> DataFrame:
    """ticker, total of the n largest or smallest totals, ties by ticker."""
    totals = flows.groupBy("ticker").agg(F.sum("flow_usd").alias("total"))
    return totals.orderBy(F.col("total").desc() if largest else F.col("total"), "ticker").limit(n)


def date_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: common (dates in both), only_a, overlap, divergence_days between the last dates. Counts per side meet in one aggregation by date."""
    both = a.select("date", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select("date", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = both.groupBy("date").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    last = lambda c: F.max(F.when(F.col(c) == 1, F.col("date")))
    return per.agg(F.count_if(F.col("_a") + F.col("_b") == 2).alias("common"), F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("only_a"), F.abs(F.datediff(last("_a"), last("_b"))).alias("divergence_days")).withColumn("overlap", F.col("common") > 0)
