"""Streams in several batches, with a restart between them: what was late, and what is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keyed state of any kind is kept by this provider; aggregations work with it as well.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _instant(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)


def run_batches(arrivals: Iterable[DataFrame], plan: Callable[[DataFrame], DataFrame], folder: str, mode: str = "update", partitions: int | None = None) -> tuple[DataFrame, list[tuple[DataFrame, datetime | None]]]:
    """Feeds tables one after the other to one stream, which stops and starts again from its checkpoint in between.

    Gives the rows that the plan put out with _batch (rising in time), and each table as it was read with the watermark
    that held for it (None before the first). Rows go through Parquet: what a repeated batch wrote is overwritten.
    partitions: of the state, which stay for the life of the checkpoint; as many as the cluster runs tasks, if not given.
    """
    spark, runs = None, []
    for k, table in enumerate(arrivals):
        spark = table.sparkSession
        table.write.mode("overwrite").parquet(f"{folder}/in/arrival={k}")
        source = spark.readStream.schema(table.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")

        def write(rows: DataFrame, number: int) -> None:
            rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/_of={number}")

        held_for = {_STORE[0]: _STORE[1], "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism)}
        before = {name: spark.conf.get(name) for name in held_for}
        for name, value in held_for.items():
            spark.conf.set(name, value)
        try:
            query = plan(source).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for name, value in before.items():
                spark.conf.set(name, value)
        progress = next((p for p in query.recentProgress if p.numInputRows), None)
        held = (progress.eventTime or {}).get("watermark") if progress else None
        held = _instant(held) if held else None
        runs.append((spark.read.schema(table.schema).parquet(f"{folder}/in/arrival={k}"), held if held and held.timestamp() > 0 else None))
    if spark is None:
        raise ValueError("a stream needs one table at least")
    return spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/rows"), runs


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of run_batches() the last of each key."""
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, *[f"_v.{c}" for c in values])


def late_rows(runs: list[tuple[DataFrame, datetime | None]], width: str, ts: str = "ts") -> DataFrame:
    """The side output of a windowed stream: rows whose window had closed when they came, that is, ended at the watermark or before it."""
    out = None
    for table, held in runs:
        end = F.window(F.col(ts).cast("timestamp"), width)["end"]
        late = table.withColumn("_end", end).filter(F.col("_end") <= F.lit(held)).select(*table.columns) if held else table.filter(F.lit(False))
        out = late if out is None else out.unionByName(late)
    return out
