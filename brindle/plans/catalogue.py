"""All registered queries with their SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.rolling import last_row
from brindle.operators import indicators as ind
from brindle.plans import briefing, checks, confluence, domain, metadata, reading, relational, reports, stateful, streams, windows  # noqa: F401
from brindle.plans.registry import ORACLES, QUERIES
from brindle.sources.views import Market


def flagship(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ts, close, indicators and signal of each symbol's last 4-hour bar."""
    df = last_row(ind.technical_features(Market(spark, path).bars()))
    signal = F.when(F.col("rsi_14") < 30, "oversold").when(F.col("rsi_14") > 70, "overbought").when(F.col("close") > F.col("sma_20"), "above_mean").otherwise("below_mean")
    return df.select("symbol", "ts", "close", "sma_20", "rsi_14", "atr_14", "bb_upper", "bb_lower", signal.alias("signal"))


def queries() -> dict:
    """Name -> query over (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL giving the same rows."""
    return dict(ORACLES)
