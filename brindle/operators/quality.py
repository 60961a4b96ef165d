"""Data quality: required fields, ranges, outliers, completeness, freshness, schema drift, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.rolling import ratio

#: Rules by kind of data: fixed values.
RULES = {
    "price": {"required": ["open", "high", "low", "close"], "max_age_hours": 6, "z": 4.0},
    "derivatives": {"required": ["symbol"], "max_age_hours": 1, "z": 3.0},
    "default": {"required": [], "max_age_hours": 24, "z": 3.0},
}


def rule(kind: str, name: str):
    """A rule of a kind of data, or the default's."""
    return RULES.get(kind, RULES["default"]).get(name, RULES["default"][name])


def missing_fields(df: DataFrame, kind: str) -> list[str]:
    """Required columns that df lacks."""
    return [c for c in rule(kind, "required") if c not in df.columns]


def outliers(df: DataFrame, x: str, kind: str = "default", by: list[str] | None = None) -> DataFrame:
    """df with z and outlier: distance from the mean in sample deviations. Statistics come from one aggregation and are joined back."""
    by = by or []
    stats = df.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    df = df.join(stats, by) if by else df.join(F.broadcast(stats))  # one row where there is no key
    z = ratio(F.abs(F.col(x) - F.col("_m")), F.col("_s"))
    return df.withColumns({"z": z, "outlier": F.coalesce(z > rule(kind, "z"), F.lit(False))}).drop("_m", "_s")


def column_stats(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """column, n, nulls, distinct, mean (of numbers): one pass over the table. exact=False estimates distinct counts."""
    numeric = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")}
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        aggs += [F.count(c).alias(f"{c}#n"), distinct(F.col(c)).alias(f"{c}#d"), (F.avg(c) if c in numeric else F.lit(None).cast("double")).alias(f"{c}#m")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("n"), (F.col("_n") - F.col(f"`{c}#n`")).alias("nulls"), F.col(f"`{c}#d`").alias("distinct"), F.col(f"`{c}#m`").alias("mean")) for c in columns])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: completeness, the share of cells that aren't null."""
    filled = sum(F.count(c) for c in columns)
    return df.agg(ratio(filled, F.count(F.lit(1)) * len(columns)).alias("completeness"))


def freshness(df: DataFrame, ts: str, as_of: str, kind: str = "default") -> DataFrame:
    """One row: last, age_hours, fresh."""
    age = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))) / 3600.0
    return df.agg(F.max(ts).alias("last")).select("last", age.alias("age_hours"), (age <= rule(kind, "max_age_hours")).alias("fresh"))


def validation_suite(df: DataFrame, kind: str = "default", ts: str | None = None, as_of: str | None = None, rules: dict | None = None) -> DataFrame:
    """One row: status (valid, stale, invalid), n, missing (required columns that df lacks), age_hours, and outliers (a map of numeric columns that have some to their number).

    Two passes, whatever the number of columns: means and deviations of all of them, then the rows beyond the rule's
    distance. A kind without a rule of its own has the default's. An empty table is valid.
    """
    given = RULES | (rules or {})
    look = lambda name: given.get(kind, {}).get(name, given["default"][name])
    lacking = [c for c in look("required") if c not in df.columns]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    stats = df.agg(*[x for i, c in enumerate(numbers) for x in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))], F.count(F.lit(1)).alias("_rows")).drop("_rows") if numbers else None
    rows = df.join(F.broadcast(stats)) if numbers else df  # one row of statistics
    beyond = [F.count_if(ratio(F.abs(F.col(c) - F.col(f"m{i}")), F.col(f"s{i}")) > look("z")).alias(f"o{i}") for i, c in enumerate(numbers)]
    last = F.max(F.col(ts).cast("timestamp")) if ts in df.columns else F.lit(None).cast("timestamp")
    out = rows.agg(F.count(F.lit(1)).alias("n"), last.alias("_last"), *beyond)
    age = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("_last")) / 3600.0
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"o{i}").alias("v")) for i, c in enumerate(numbers)]), lambda p: p["v"] > 0)) if numbers else F.create_map().cast("map<string,bigint>")
    status = F.lit("invalid") if lacking else F.when(age > look("max_age_hours"), "stale").otherwise("valid")
    return out.select(status.alias("status"), "n", F.lit(lacking).cast("array<string>").alias("missing"), age.alias("age_hours"), pairs.alias("outliers"))


def validate_dataset(df: DataFrame, kind: str, columns: list[str], ts: str | None = None, as_of: str | None = None) -> dict:
    """status (valid, stale, invalid) and warnings of the given columns, as a small dict."""
    row = validation_suite(df, kind, ts, as_of).first()
    warnings = [f"missing {c}" for c in row["missing"]] + [f"{c}: {n} outliers" for c, n in sorted(row["outliers"].items()) if c in columns]
    return {"status": row["status"], "warnings": warnings if row["missing"] == [] else [w for w in warnings if w.startswith("missing")]}


def validate_bars(df: DataFrame) -> DataFrame:
    """Bars that break high >= open, close, low or low <= open, close, or lack a value."""
    h, lo, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    ok = (h >= lo) & (h >= o) & (h >= c) & (lo <= o) & (lo <= c)
    return df.filter(~F.coalesce(ok, F.lit(False)))


def schema_drift(df: DataFrame, declared: dict[str, str]) -> list[str]:
    """Differences of df from declared column types; integers fit where doubles are declared."""
    have = dict(df.dtypes)
    out = [f"missing {c}" for c in declared if c not in have]
    out += [f"{c}: {have[c]} instead of {t}" for c, t in declared.items() if c in have and have[c] != t and not (t == "double" and have[c] in ("int", "bigint", "float"))]
    return out + [f"new {c}" for c in have if c not in declared]


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def lineage_event(df: DataFrame, dataset: str, sources: list[str], step: str, at: str) -> DataFrame:
    """One row to append to a lineage table."""
    return df.sparkSession.createDataFrame([(dataset, sources, step, at)], "dataset string, sources array<string>, step string, at string")
