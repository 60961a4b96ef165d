"""The library's endpoints as functions: each takes tables and gives a DataFrame, or a small dict where it renders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import catalogue as catalogues
from brindle.operators import decisions, flows, levels, ml, quality, regimes, risk, signals, zones
from brindle.plans import report


def price_history(bars: DataFrame, days: int = 30, as_of: str | None = None) -> DataFrame:
    """Bars of the last days before as_of (the last bar's time by default)."""
    if as_of is None:
        last = bars.agg(F.max("ts").alias("_end"))
        return bars.join(F.broadcast(last), F.col("ts") >= F.col("_end") - F.make_dt_interval(F.lit(days))).drop("_end")  # one row
    return bars.filter(F.col("ts") >= F.expr(f"cast('{as_of}' as timestamp_ntz) - interval {int(days)} days"))


def etf_flows(table: DataFrame, start: str | None = None, end: str | None = None, ticker: str | None = None) -> DataFrame:
    """Flows between two dates, of one ticker."""
    return flows.select_flows(table, start, end, ticker)


def confluence_zones(bars: DataFrame, min_score: float = 0.6, max_distance_pct: float = 10.0) -> DataFrame:
    """Zones by score and distance."""
    found = zones.confluence_zones(levels.all_factors(bars), bars, min_score)
    return found.filter(F.abs("distance_pct") <= max_distance_pct).orderBy(F.col("score").desc(), "symbol", "cluster")


def near_price(bars: DataFrame, count: int = 5, direction: str = "both") -> DataFrame:
    """The zones nearest to the price."""
    return zones.nearest(zones.confluence_zones(levels.all_factors(bars), bars, 0.0), count, direction)


def context(bars: DataFrame, symbol: str, output: str = "json") -> str:
    """One symbol's context, rendered."""
    return report.render(report.market_context(bars), symbol, output)


def action_plan(bars: DataFrame) -> DataFrame:
    """symbol, action, priority."""
    ctx = report.market_context(bars)
    return decisions.actions(ctx.select("symbol", "regime", "risk_level", "support"))


def opportunity_list(bars: DataFrame) -> DataFrame:
    """symbol, opportunity, confidence."""
    r = regimes.classify(regimes.features(bars))
    return decisions.opportunities(r, signals.library_signals(bars), risk.assess(bars, r))


def catalogue(tables: dict[str, DataFrame], as_of: str | None = None, ts: str | None = None) -> DataFrame:
    """table, column, type, n, nulls, mean, low, high, distinct, median of every table, one pass over each; with ts, also the latest time of that column, its age in hours at as_of, and fresh (under a day)."""
    out = None
    for name, df in tables.items():
        part = catalogues.merged(catalogues.profile(df)).withColumn("table", F.lit(name))
        if ts is not None:
            last = quality.freshness(df, ts, as_of).withColumn("table", F.lit(name)) if ts in df.columns else None
            part = part.join(last, "table") if last is not None else part.withColumns({"last": F.lit(None).cast("timestamp_ntz"), "age_hours": F.lit(None).cast("double"), "fresh": F.lit(None).cast("boolean")})
        out = part if out is None else out.unionByName(part)
    first = ["table", "column", "type", "n", "nulls", "mean", "low", "high", "distinct", "median"]
    return out.select(*first, *[c for c in ("last", "age_hours", "fresh") if c in out.columns])


def search_catalogue(descriptions: DataFrame, words: str, top: int = 5) -> DataFrame:
    """name, score of the descriptions (name, text) nearest to the words."""
    index = ml.tfidf(descriptions, "name")
    query = ml.terms(descriptions.sparkSession.createDataFrame([("q", words)], "name string, text string"), "name").groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    norm = query.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))
    return ml.search(index, query.join(F.broadcast(norm)).select("term", (F.col("weight") / F.col("_n")).alias("weight")), "name", top)  # one row


def lineage(events: DataFrame, dataset: str) -> DataFrame:
    """The recorded steps of a data set, latest first."""
    return events.filter(F.col("dataset") == dataset).orderBy(F.col("at").desc())


def upstream(events: DataFrame) -> DataFrame:
    """id, ancestor, depth: all that the recorded steps (dataset, sources) were made from."""
    return catalogues.ancestors(events.select(F.col("dataset").alias("id"), F.explode("sources").alias("parent")))
