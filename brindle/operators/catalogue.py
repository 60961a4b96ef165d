"""Catalogues and lineage: profiles that can be merged, drift between versions, and ancestors of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.tables import discard, written

_HLL = 14  # log2 of the registers: a standard error of 0.8 %


def profile(df: DataFrame, version: str | None = None) -> DataFrame:
    """version, column, type, n, nulls, mean, low, high and sketches of the distinct values and of numbers, for each column (and each version, if a column holds one): one pass over the rows.

    Sketches have a fixed size, so profiles of days or shards are kept and merged instead of reading the rows again.
    """
    fields = [f for f in df.schema.fields if f.name != version]
    numeric = lambda f: isinstance(f.dataType, T.NumericType)
    number = lambda f: F.col(f.name).cast("double") if numeric(f) else F.lit(None).cast("double")

    def stats(f: T.StructField):
        return F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(f.name).isNull()).alias("nulls"),
            F.sum(number(f)).alias("total"),
            F.min(number(f)).alias("low"),
            F.max(number(f)).alias("high"),
            F.hll_sketch_agg(F.coalesce(F.col(f.name).cast("string"), F.lit("")), _HLL).alias("values"),
            (F.kll_sketch_agg_double(number(f)) if numeric(f) else F.lit(None).cast("binary")).alias("numbers"),
        )

    key = F.col(version).cast("string") if version else F.lit(None).cast("string")
    rows = df.groupBy(key.alias("version")).agg(F.array(*[stats(f) for f in fields]).alias("_s"))
    return rows.select("version", F.inline("_s"))


def merged(profiles: DataFrame) -> DataFrame:
    """column, type, n, nulls, mean, low, high, distinct (estimated, a null counts as one empty value), median (estimated) over all versions."""
    out = profiles.groupBy("column", "type").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("total").alias("_t"), F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("values", F.lit(False)).alias("_v"), F.kll_merge_agg_double("numbers").alias("_q"))
    median = F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("_q", F.lit(0.5)))
    return out.select("column", "type", "n", "nulls", F.try_divide("_t", F.col("n") - F.col("nulls")).alias("mean"), "low", "high", F.hll_sketch_estimate("_v").alias("distinct"), median.alias("median"))


def columns(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """column, type of a schema; of a file's, which its footer holds, no row is read."""
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema.fields], "column string, type string")


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """column, change (added, removed, retyped, same), old_type, new_type and the share of nulls before and after, between two merged profiles."""
    side = lambda df, p: df.select("column", F.col("type").alias(f"{p}_type"), F.try_divide("nulls", "n").alias(f"{p}_nulls"))
    both = side(old, "old").join(side(new, "new"), "column", "full")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "retyped").otherwise("same")
    return both.select("column", change.alias("change"), "old_type", "new_type", "old_nulls", "new_nulls")


def ancestors(edges: DataFrame) -> DataFrame:
    """id, ancestor, depth (of the shortest way) for edges (id, parent): everything upstream of every data set.

    Each round doubles the depth: beyond the depth that is known, every shortest way leads through a data set at just
    that depth, so the pairs of that depth meet all known pairs, and those not known yet are kept. A diamond is followed
    once, not once for each way through it. A data set that is its own ancestor is refused.
    """
    spark = edges.sparkSession
    edges = edges.select("id", F.col("parent").alias("ancestor")).filter("id is not null and ancestor is not null").distinct()
    found, path = written(edges.withColumn("depth", F.lit(1)), "ancestors")
    depth, paths = 1, [path]
    while True:
        loop = found.filter(F.col("id") == F.col("ancestor")).orderBy("depth").first()
        if loop is not None:
            discard(spark, *paths)
            raise ValueError(f"a cycle of depth {loop['depth']} leads back to {loop['id']}")
        last = found.filter(F.col("depth") == depth)
        if last.isEmpty():
            return found
        up = found.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("depth").alias("_more"))
        further = last.join(up, "ancestor").groupBy("id", F.col("_up").alias("ancestor")).agg(F.min(F.lit(depth) + F.col("_more")).alias("depth"))
        further = further.join(found, ["id", "ancestor"], "left_anti")
        depth *= 2
        _, path = written(further, "ancestors")
        paths.append(path)
        found = spark.read.schema(found.schema).parquet(*paths)
