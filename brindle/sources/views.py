"""Market tables derived from the star-schema Parquet files: every view reads only the columns it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.resample import resample_ohlcv
from brindle.sources.tables import written


class Market:
    """Views over one directory of Parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def ticks(self) -> DataFrame:
        """symbol, ts, price, qty."""
        return self.table("events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("qty"))

    def bars(self, rule: str = "4 hours") -> DataFrame:
        """OHLCV bars of every symbol."""
        return resample_ohlcv(self.ticks(), rule)

    def stored_bars(self, rule: str = "4 hours") -> DataFrame:
        """bars(), written once: for plans that read them many times, so that the ticks are aggregated once."""
        return written(self.bars(rule), "bars")[0]

    def bars_1h(self) -> DataFrame:
        """Hourly bars over all ticks, as one symbol ALL."""
        return resample_ohlcv(self.ticks().withColumn("symbol", F.lit("ALL")), "1 hour")

    def bars_1d(self) -> DataFrame:
        """Daily bars of every symbol."""
        return resample_ohlcv(self.ticks(), "1 day")

    def flows(self) -> DataFrame:
        """date, ticker, flow_usd: signed order totals."""
        sign = F.when(F.col("o_orderstatus") == "F", -1.0).otherwise(1.0)
        return self.table("orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("ticker")).agg(F.sum(sign * F.col("o_totalprice")).alias("flow_usd"))

    def daily_flow(self) -> DataFrame:
        """symbol (ALL), ts (date), net_flow."""
        sign = F.when(F.col("o_orderstatus") == "F", -1.0).otherwise(1.0)
        return self.table("orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.sum(sign * F.col("o_totalprice")).alias("net_flow")).withColumn("symbol", F.lit("ALL"))

    def flow_long(self) -> DataFrame:
        """date, ticker, field, value."""
        return self.table("orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("ticker"), F.col("o_orderstatus").alias("field"), F.col("o_totalprice").alias("value"))

    def macro(self) -> DataFrame:
        """date, asset_id, price: mean order total by market segment."""
        orders = self.table("orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
        segments = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("asset_id"))
        return orders.join(segments, "o_custkey").groupBy("date", "asset_id").agg(F.avg("o_totalprice").alias("price"))

    def open_interest(self) -> DataFrame:
        """price, open_interest."""
        return self.table("part").groupBy(F.col("p_retailprice").alias("price")).agg(F.sum("p_size").cast("double").alias("open_interest"))

    def quotes(self) -> DataFrame:
        """item, source, value: unit price of a part at a supplier."""
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        lines = self.table("lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("s_suppkey")).agg(F.avg(unit).alias("value"))
        names = self.table("supplier").select("s_suppkey", F.col("s_name").alias("source"))
        return lines.join(names, "s_suppkey").select("item", "source", "value")

    def book(self) -> DataFrame:
        """snapshot, side, price, qty: levels of an order book a day."""
        return (
            self.table("lineitem")
            .select(F.to_date("l_shipdate").alias("snapshot"), F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"), (F.bround(F.col("l_extendedprice") / F.col("l_quantity") / 100, 0) + 1).alias("price"), F.col("l_quantity").alias("qty"))
            .groupBy("snapshot", "side", "price")
            .agg(F.sum("qty").alias("qty"))
        )

    def outputs(self) -> DataFrame:
        """tx, address, value: outputs of transactions."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("tx"), F.col("l_suppkey").alias("address"), F.col("l_extendedprice").alias("value"))

    def utxo(self) -> DataFrame:
        """time, coins."""
        return self.table("lineitem").select(F.to_date("l_shipdate").alias("time"), F.col("l_quantity").alias("coins"))

    def predictions(self) -> DataFrame:
        """ts, direction, price_target: one for each signup event."""
        up = F.col("value") > 35
        rows = self.table("events").filter(F.col("event_type") == "signup")
        return rows.select("ts", F.when(up, "BULLISH").when(F.col("value") > 20, "BEARISH").otherwise("NEUTRAL").alias("direction"), (F.col("value") * 1.02).alias("price_target"))
