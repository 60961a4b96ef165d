"""Rolling windows with the null rules of fixed-length series: a value appears once the window holds n non-null rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(by: str | list[str] = "symbol", order: str = "ts") -> WindowSpec:
    """Rows of one series in time order."""
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def full(agg: Callable, x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    """agg over the last n rows, null until n of them are not null."""
    frame = (w if w is not None else series()).rowsBetween(1 - n, 0)
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def centred(agg: Callable, x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    """agg over n rows around each row (an even n looks back one row more); null at the ends."""
    w = w if w is not None else series()
    frame = w.rowsBetween(-(n // 2), (n - 1) // 2)
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles; where b is zero, infinite with the sign of a, or NaN if a is zero too."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def change(x: str, k: int, w: WindowSpec | None = None) -> Column:
    """Relative change over k rows. Use filled() first where nulls shall carry the last value."""
    w = w if w is not None else series()
    return ratio(F.col(x), F.lag(x, k).over(w)) - 1


def filled(x: str, w: WindowSpec | None = None) -> Column:
    """The last non-null value up to each row."""
    w = w if w is not None else series()
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def zscore(x: str, n: int, w: WindowSpec | None = None) -> Column:
    """Distance from the rolling mean in rolling sample deviations; null where there is no deviation."""
    return ratio(F.col(x) - full(F.avg, x, n, w), full(F.stddev_samp, x, n, w))


def clip(x: Column, low: float, high: float) -> Column:
    """x between low and high."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def last_row(df: DataFrame, by: str = "symbol", order: str = "ts", k: int = 1) -> DataFrame:
    """The k-th row from the end of every series."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return df.withColumn("_from_end", F.row_number().over(w)).filter(F.col("_from_end") == k).drop("_from_end")


def tail(df: DataFrame, n: int, by: str = "symbol", order: str = "ts") -> DataFrame:
    """The last n rows of every series."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return df.withColumn("_from_end", F.row_number().over(w)).filter(F.col("_from_end") <= n).drop("_from_end")
