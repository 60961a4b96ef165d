"""Proportional stratified interleaving: shards that all hold the sources in the corpus's mixture.

Rows are shuffled by a seeded hash of id and text within their source and ranked; the fractional rank (rank - 1/2) / size of the
source orders all rows, and equal runs of that order are the shards. No source is ever ranked in one task: hash ranges
of about per_range rows are counted, their counts summed up in order (in blocks, then over blocks), and rows are ranked inside their range only.

The law is `rows`: shard sizes differ by one row at most. Defined results: a null source is a source of its own, a
null id and a null text are allowed (size 8, crc32 of nothing), ties in the hash are broken by size and crc32,
repeated rows each get a slot, an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import written

_RANGES = 1024  # ranges that are summed up in one block


def _ranked(rows: DataFrame, strata: list[str], range_of: Column, order: list[str], rank: str, total: str) -> DataFrame:
    """rows with their rank (from 1) within the strata in the given order, which ascends with range_of, and the strata's sizes."""
    rows = rows.withColumn("_range", range_of)
    counts = rows.groupBy(*strata, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col("_range") / _RANGES))
    # what stands before a range: the blocks of ranges before its own, and the ranges before it in its block
    blocks = counts.groupBy(*strata, "_block").agg(F.sum("_n").alias("_b"))
    ordered, whole = Window.partitionBy(*strata).orderBy("_block"), Window.partitionBy(*strata)
    blocks = blocks.select(*strata, "_block", (F.sum("_b").over(ordered) - F.col("_b")).alias("_ahead"), F.sum("_b").over(whole).alias(total))
    within = Window.partitionBy(*strata, "_block").orderBy("_range")
    before = counts.withColumn("_before", F.sum("_n").over(within) - F.col("_n")).join(blocks, [*strata, "_block"])
    before = before.select(*strata, "_range", (F.col("_before") + F.col("_ahead")).alias("_before"), total)
    inside = Window.partitionBy(*strata, "_range").orderBy(*order)
    numbered = rows.withColumn("_at", F.row_number().over(inside).cast("long"))
    return numbered.join(before, [*strata, "_range"]).withColumn(rank, F.col("_before") + F.col("_at")).drop("_range", "_before", "_at")


def interleave(docs: DataFrame, shards: int = 24, seed: str = "brindle", *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", per_range: int = 10_000) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes + 8), text_crc32, shard, slot (from 0 in every shard)."""
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    # the text counts too, so that rows without an id, or with one id, are shuffled as well
    parts = [F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.octet_length(text).cast("string"), F.lit(":"), F.crc32(text).cast("string")]
    key = F.md5(F.concat(*parts).cast("binary"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col))).alias("_stratum"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        key.alias("_key"),
    )
    rows = written(rows, "shard-rows")
    n = rows.count()
    ranges = max(1, -(-n // per_range))
    place = F.conv(F.substring("_key", 1, 12), 16, 10).cast("double") / float(16**12)
    ranked = _ranked(rows, ["_stratum"], F.floor(place * ranges), ["_key", "size", "text_crc32", "doc_id"], "_rank", "_of")
    ranked = ranked.withColumn("_part", (F.col("_rank") - 0.5) / F.col("_of"))
    ranked = written(ranked.select("doc_id", "source", "size", "text_crc32", "_stratum", "_rank", "_part"), "shard-ranks")
    placed = _ranked(ranked.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("_part") * ranges), ["_part", "_stratum", "_rank"], "_place", "_total")
    out = placed.withColumn("shard", F.expr(f"cast(((_place - 1) * {shards}L) div _total as int)"))
    return out.select("doc_id", "source", "size", "text_crc32", "shard", F.expr(f"_place - 1 - ((shard * _total + {shards - 1}L) div {shards}L)").alias("slot"))
