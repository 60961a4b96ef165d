"""Counting by rank: how many bounds lie below a value, without matching any."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Bounds(NamedTuple):
    """A column of bounds, the name that their number gets, and whether a bound at a value counts."""

    rows: DataFrame
    column: str
    name: str
    at: bool


def counted(points: DataFrame, x: str, *bounds: Bounds, by: str = "symbol") -> DataFrame:
    """points with a column for each of the bounds: how many of their series lie below x, or at it too. A null x counts none.

    Points and bounds are sorted together, once, so work grows with their number and never with their pairs.
    """
    rows = points.withColumns({"_x": F.col(x), "_side": F.lit(1), "_of": F.lit(-1)})
    for i, b in enumerate(bounds):
        own = b.rows.filter(F.col(b.column).isNotNull()).select(by, F.col(b.column).alias("_x"), F.lit(0 if b.at else 2).alias("_side"), F.lit(i).alias("_of"))
        rows = rows.unionByName(own, allowMissingColumns=True)
    ahead = Window.partitionBy(by).orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({b.name: F.count_if(F.col("_of") == i).over(ahead) for i, b in enumerate(bounds)}).filter("_of = -1").drop("_x", "_side", "_of")
