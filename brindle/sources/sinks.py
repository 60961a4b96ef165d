"""Writing tables: merges by key into versioned Parquet, latest-per-key views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(existing: DataFrame, new: DataFrame, keys: list[str], mode: str = "upsert", columns: list[str] | None = None) -> DataFrame:
    """existing after a merge of new by keys.

    upsert: new rows replace those with their keys. insert_only: new rows are added where the key is absent. update:
    only the given columns of existing rows change, and absent keys are added.
    """
    if mode == "upsert":
        return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)
    if mode == "insert_only":
        return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    changed = existing.join(fresh, keys, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*existing.columns)
    return changed.unionByName(new.select(*existing.columns).join(existing.select(*keys), keys, "left_anti"))


def write_version(df: DataFrame, path: str, version: int, partition_by: list[str] | None = None) -> str:
    """Writes df as a version of the table at path. Readers take the version they were told, so a failed write leaves the old one."""
    out = f"{path}/v{version}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)
    return out


def upsert_prices(existing: DataFrame, new: DataFrame, interval: str) -> DataFrame:
    """Merges bars: daily ones by day, others by time and interval."""
    if interval == "1d":
        new = new.withColumn("ts", F.date_trunc("day", "ts").cast(dict(new.dtypes)["ts"]))
    return merged(existing, new.withColumn("interval", F.lit(interval)).select(*existing.columns), ["symbol", "ts", "interval"])


def last_rows(df: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """The n last rows of a table in ascending order: a top-n, not a full sort."""
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def by_priority(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of several tables with the same columns; on equal keys the later table wins."""
    all_ = None
    for i, p in enumerate(parts):
        p = p.withColumn("_priority", F.lit(i))
        all_ = p if all_ is None else all_.unionByName(p)
    w = Window.partitionBy(*keys).orderBy(F.col("_priority").desc())
    return all_.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_priority")


def first_non_empty(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """primary, or fallback where primary has no row."""
    return fallback if primary.isEmpty() else primary


def write_json(df: DataFrame, path: str) -> None:
    """Writes one JSON object a row and line; null fields are left out."""
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Writes CSV with a header, in as many files as df has partitions."""
    df.write.option("header", True).mode("overwrite").csv(path)


def split_rows(df: DataFrame) -> DataFrame:
    """data: each row as a JSON array, in the order of df's columns: the split orientation without gathering a frame in one document."""
    one = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *map(one, df.columns)), F.lit("]")).alias("data"))


def with_outcomes(log: DataFrame, updates: DataFrame) -> DataFrame:
    """A decision log (id, made_at, context, outcome, reflection) after point updates (id, at, outcome, reflection): the last non-null values of each id win."""
    last = updates.groupBy("id").agg(F.max_by("outcome", F.when(F.col("outcome").isNotNull(), F.col("at"))).alias("_o"), F.max_by("reflection", F.when(F.col("reflection").isNotNull(), F.col("at"))).alias("_r"))
    return log.join(last, "id", "left").withColumns({"outcome": F.coalesce("_o", "outcome"), "reflection": F.coalesce("_r", "reflection")}).drop("_o", "_r")


def appended(log: DataFrame, decisions: DataFrame, context: list[str]) -> DataFrame:
    """log with new decisions (id, made_at and the context columns, kept as JSON); outcomes are open."""
    none = F.lit(None).cast("string")
    new = decisions.select("id", "made_at", F.to_json(F.struct(*context)).alias("context"), F.lit(None).cast("double").alias("outcome"), none.alias("reflection"))
    return log.unionByName(new)
