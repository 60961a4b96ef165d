"""Queries of the readers: pages, feeds and books are put together from the tables by Spark and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.plans.registry import R, register, sql
from brindle.sources import readers
from brindle.sources.views import Market


def _number(c: str, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c))


def _joined(df: DataFrame, key: list[str], order: str, text: Column, sep: str = "") -> DataFrame:
    """The texts of each key in order: keys are days, months or symbols' days, so a group is small."""
    rows = df.select(*key, F.struct(F.col(order).alias("o"), text.alias("t")).alias("_s"))
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["t"]), sep).alias("body"))


def _klines(m: Market) -> DataFrame:
    """A JSON document a symbol and day."""
    bar = F.concat(F.lit("["), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), *[x for c in ("open", "high", "low", "close", "volume") for x in (F.lit(',"'), _number(c), F.lit('"'))], F.lit("]"))
    docs = _joined(m.bars().withColumn("day", F.to_date("ts")), ["symbol", "day"], "ts", bar, ",")
    return readers.klines(docs.select(F.concat(F.lit("["), "body", F.lit("]")).alias("value"))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_BAR4 = ", ".join(f"round({c}, 4) + 0.0::DOUBLE AS {c}" for c in ("open", "high", "low", "close"))
register("klines_read", sql(f"SELECT ts, {_BAR4}, volume FROM bars", "bars"))(lambda m: _klines(m).select("ts", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")], "volume"))


def _book(m: Market) -> DataFrame:
    """A JSON book a snapshot; every third has no asks."""
    level = F.concat(F.lit('["'), _number("price", 1), F.lit('","'), _number("qty", 2), F.lit('"]'))
    side = lambda s: _joined(m.book().filter(F.col("side") == s), ["snapshot"], "price", level, ",").withColumnRenamed("body", s)
    both = side("bid").join(side("ask"), "snapshot", "full")
    text = F.concat(F.lit('{"bids":['), F.coalesce("bid", F.lit("")), F.lit("]"), F.when(F.dayofyear("snapshot") % 3 != 0, F.concat(F.lit(',"asks":['), F.coalesce("ask", F.lit("")), F.lit("]"))).otherwise(""), F.lit("}"))
    return readers.order_book(both.select(text.alias("value")))


register("order_book_read", sql("SELECT price, round(qty, 2) + 0.0::DOUBLE AS quantity, side FROM book WHERE side = 'bid' OR dayofyear(snapshot) % 3 <> 0", "book"))(lambda m: _book(m))


def _feeds(m: Market) -> DataFrame:
    """A feed a market segment and nation: RSS or Atom."""
    c = m.table("customer").select("c_mktsegment", "c_nationkey", "c_custkey", F.col("c_name").alias("n"))
    atom = F.col("c_nationkey") % 2 == 0
    title = F.concat(F.lit("<title>"), "n", F.lit(" &amp; sons</title>"))
    item = F.when(atom, F.concat(F.lit("<entry>"), title, F.lit("</entry>"))).otherwise(F.concat(F.lit("<item>"), title, F.lit("</item>")))
    pages = _joined(c, ["c_mktsegment", "c_nationkey"], "c_custkey", item)
    xml = F.when(atom, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>no item</title>'), "body", F.lit("</feed>"))).otherwise(F.concat(F.lit("<rss><channel><title>no item</title>"), "body", F.lit("</channel></rss>")))
    return readers.feed_titles(pages.select(xml.alias("xml")))


register("feed_titles_read", "SELECT c_name || ' & sons' AS title FROM customer")(_feeds)

# ---- tables in pages


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>"))


def _price_pages(m: Market) -> DataFrame:
    """A page a symbol and month: a table of no interest, then daily prices; dates in two spellings, and a row without a date."""
    bars = m.bars_1d().withColumn("month", F.date_trunc("month", "ts"))
    day = F.when(F.dayofmonth("ts") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "dd-MM-yyyy"))
    body = _joined(bars, ["symbol", "month"], "ts", _row(day, *[F.concat(F.lit("$"), _number(c)) for c in ("open", "high", "low", "close")]))
    head = "<html><table><tr><td>menu</td></tr></table><table><tr><th>Date</th><th>Open</th><th>High</th><th>Low</th><th>Close</th></tr>"
    return body.select(F.concat_ws("/", "symbol", F.col("month").cast("string")).alias("path"), F.concat(F.lit(head), "body", F.lit("<tr><td>no date</td><td>1</td><td>1</td><td>1</td><td>1</td></tr></table></html>")).alias("html"))


register("price_table_read", sql(f"SELECT CAST(ts AS DATE) AS date, {_BAR4} FROM bars_1d", "bars_1d"))(lambda m: readers.price_table(_price_pages(m)).select("date", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")]))

_TICKERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _flow_pages(m: Market) -> DataFrame:
    """A page a month, a column a ticker and their total; a day without a flow says -."""
    cells = [F.sum(F.when(F.col("ticker") == t, F.col("flow_usd"))).alias(f"f{k}") for k, t in enumerate(_TICKERS)]
    days = m.flows().groupBy("date").agg(*cells, F.sum("flow_usd").alias("total")).withColumn("month", F.trunc("date", "month"))
    names = [*[f"f{k}" for k in range(len(_TICKERS))], "total"]
    body = _joined(days, ["month"], "date", _row(F.date_format("date", "yyyy-MM-dd"), *[F.coalesce(_number(c, 2), F.lit("-")) for c in names]))
    head = "<table><tr><th>Date</th>" + "".join(f"<th>{t}</th>" for t in [*_TICKERS, "Total"]) + "</tr>"
    return body.select(F.col("month").cast("string").alias("path"), F.concat(F.lit(head), "body", F.lit("</table>")).alias("html"))


_DAYS = "(SELECT DISTINCT date FROM flows)"
register(
    "flow_table_read",
    sql(f"SELECT date, ticker, round(coalesce(flow_usd, 0), 2) + 0.0::DOUBLE AS value FROM {_DAYS} CROSS JOIN (SELECT DISTINCT ticker FROM flows) LEFT JOIN flows USING (date, ticker)", "flows"),
)(lambda m: readers.flow_table(_flow_pages(m)).filter("ticker <> 'Total'").withColumn("value", F.round("value", 2)))
register("net_flows_read", sql("SELECT date, round(sum(flow_usd), 2) + 0.0::DOUBLE AS net_flow FROM flows GROUP BY date", "flows"))(
    lambda m: readers.net_flows(readers.flow_table(_flow_pages(m))).withColumn("net_flow", F.round("net_flow", 2))
)


def _provider_pages(m: Market) -> DataFrame:
    """A page a month with its document in a script: providers by key, and rows keyed by provider."""
    flows = m.flows().withColumns({"k": F.substring("ticker", 1, 1), "month": F.trunc("date", "month"), "v": F.when(F.abs("flow_usd") > 200000, F.round(F.col("flow_usd") * 100)).otherwise(F.round("flow_usd"))})
    days = flows.groupBy("month", "date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("p"), "k").alias("k"), F.format_string("%.0f", "v").alias("v"))))).alias("r"))
    day = F.to_json(F.map_concat("r", F.create_map(F.lit("time"), F.unix_seconds(F.col("date").cast("timestamp")).cast("string"))))
    body = _joined(days, ["month"], "date", day, ",")
    names = ",".join(f'"p{t[0]}":"{t}"' for t in _TICKERS)
    doc = F.concat(F.lit('{"props":{"pageProps":{"dehydratedState":{"queries":[{"state":{"data":{"providers":{' + names + '},"chart1":['), "body", F.lit("]}}}]}}}}"))
    return body.select(F.col("month").cast("string").alias("path"), F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), doc, F.lit("</script></html>")).alias("html"))


register(
    "provider_flows_read",
    sql(
        "SELECT date, ticker, CASE WHEN abs(v) > 1e6 THEN 'Flow (USD)' WHEN abs(v) > 0 THEN 'Flow (BTC)' ELSE 'Flow' END AS field, v AS value FROM (SELECT date, ticker, CASE WHEN abs(flow_usd) > 200000 THEN round(flow_usd * 100) ELSE round(flow_usd) END + 0.0::DOUBLE AS v FROM flows)",
        "flows",
    ),
)(lambda m: readers.provider_flows(_provider_pages(m)))

# ---- small texts

register("open_interest_read", "SELECT p_partkey, round(p_retailprice * 1e9, 0) + 0.0::DOUBLE AS open_interest FROM part")(
    lambda m: m.table("part").select("p_partkey", F.round(readers.open_interest_text(F.concat(F.lit("<b>Open interest</b> <span>$"), _number("p_retailprice", 2), F.lit("B</span> of <i>$7</i>"))), 0).alias("open_interest"))
)
register("labelled_number_read", "SELECT p_partkey, round(p_retailprice, 2) + 0.0::DOUBLE AS price FROM part")(
    lambda m: m.table("part").select("p_partkey", F.round(readers.labelled_number(F.concat(F.lit('<p>Price</p><span class="x"> '), _number("p_retailprice", 2), F.lit(" </span><span>5</span>")), "Price"), 2).alias("price"))
)
register(
    "intervals_read",
    "SELECT interval, max(path) AS path FROM (SELECT c_mktsegment || '/' || c_name || '_' || (c_custkey % 5 + 1) || 'h.csv' AS path, (c_custkey % 5 + 1) || 'h' AS interval FROM customer WHERE c_custkey % 7 <> 0) GROUP BY interval",
)(lambda m: readers.intervals(m.table("customer").select(F.concat("c_mktsegment", F.lit("/"), "c_name", F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("_"), (F.col("c_custkey") % 5 + 1).cast("string"), F.lit("h"))).otherwise(""), F.lit(".csv")).alias("path"))))
