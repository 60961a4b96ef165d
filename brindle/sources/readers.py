"""Readers of pages and documents: HTML tables, embedded JSON, feeds, books. Files are read by Spark, so any store works."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scalars import parse_day, parse_number


class _Tables(HTMLParser):
    """Cells of all tables of a page, row by row."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self._cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self._cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None:
            self.tables[-1][-1].append("".join(self._cell).strip())
            self._cell = None

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)


def html_rows(pages: DataFrame, key: str = "path", html: str = "html") -> DataFrame:
    """key, table, row, cells: one row for each table row of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["key"], pdf["html"]):
                p = _Tables()
                p.feed(text or "")
                out += [(k, t, r, cells) for t, rows in enumerate(p.tables) for r, cells in enumerate(rows)]
            yield pd.DataFrame(out, columns=["key", "table", "row", "cells"])

    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html"))
    return rows.mapInPandas(run, "key string, table int, row int, cells array<string>")


def _headed(pages: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the first table of each page whose header holds all the wanted words, with that header."""
    rows = html_rows(pages)
    has = [F.contains(F.lower(F.array_join("cells", "\n")), F.lit(w)) for w in wanted]
    test = has[0]
    for h in has[1:]:
        test = test & h
    heads = rows.filter((F.col("row") == 0) & test).groupBy("key").agg(F.min(F.struct("table", F.col("cells").alias("header"))).alias("_h"))
    return rows.filter("row > 0").join(heads, "key").filter(F.col("table") == F.col("_h.table")).select("key", "row", "cells", F.col("_h.header").alias("header"))


def price_table(pages: DataFrame) -> DataFrame:
    """date, open, high, low, close of a page's price table: five cells a row, unreadable numbers 0, rows without a date dropped."""
    rows = _headed(pages, ["open", "close"]).filter(F.size("cells") >= 5)
    number = lambda i: parse_number(F.get("cells", F.lit(i)))
    return rows.select(parse_day(F.get("cells", F.lit(0))).alias("date"), *[number(i + 1).alias(c) for i, c in enumerate(("open", "high", "low", "close"))]).filter(F.col("date").isNotNull())


def flow_table(pages: DataFrame) -> DataFrame:
    """date, ticker, value in long form: the tickers are the header's cells, unreadable numbers are 0."""
    rows = _headed(pages, ["date"]).withColumn("date", parse_day(F.get("cells", F.lit(0)))).filter(F.col("date").isNotNull())
    cells = F.posexplode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))).alias("_i", "_c")
    long = rows.select("date", "header", cells)
    return long.select("date", F.get("header", F.col("_i") + 1).alias("ticker"), parse_number(F.col("_c")).alias("value"))


def funding_table(pages: DataFrame) -> DataFrame:
    """exchange, current, predicted as texts: the first three cells of the rows of a page's funding table that have as many."""
    rows = _headed(pages, ["exchange", "predicted"]).filter(F.size("cells") >= 3)
    return rows.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(("exchange", "current", "predicted"))])


def net_flows(long: DataFrame) -> DataFrame:
    """date, net_flow: the value of the column named like Total, 0 without one."""
    total = F.when(F.lower("ticker").contains("total"), F.col("value"))
    return long.groupBy("date").agg(F.coalesce(F.max(total), F.lit(0.0)).alias("net_flow"))


def embedded_json(pages: DataFrame, html: str = "html", element: str = "__NEXT_DATA__") -> Column:
    """The JSON text inside the page's script element of that id."""
    return F.regexp_extract(F.col(html), rf'<script[^>]*id="{element}"[^>]*>(.*?)</script>', 1)


def provider_flows(pages: DataFrame, html: str = "html") -> DataFrame:
    """date, ticker, field, value from an embedded document: a map of providers and a series of rows keyed by provider.

    Values over a million are dollars, other non-zero ones coins.
    """
    schema = "struct<providers:map<string,string>,chart1:array<map<string,string>>>"
    doc = pages.select(F.from_json(F.get_json_object(embedded_json(pages, html), "$.props.pageProps.dehydratedState.queries[0].state.data"), schema).alias("d"))
    rows = doc.select("d.providers", F.explode("d.chart1").alias("r"))
    long = rows.select("r", F.explode(F.map_entries("providers")).alias("p"))
    value = F.element_at("r", F.col("p.key")).try_cast("double")
    size = F.abs(value)
    field = F.when(size > 1e6, "Flow (USD)").when(size > 0, "Flow (BTC)").otherwise("Flow")
    return long.select(F.timestamp_seconds(F.element_at("r", F.lit("time")).try_cast("long")).cast("date").alias("date"), F.col("p.value").alias("ticker"), field.alias("field"), value.alias("value")).filter("value is not null")


def open_interest_text(html: Column) -> Column:
    """`$10.5B` as a number."""
    return parse_number(F.regexp_extract(html, r"\$([0-9.,]+B)", 1), None)


def labelled_number(html: Column, label: str) -> Column:
    """The first number in the span after a label."""
    return parse_number(F.regexp_extract(html, rf"{label}.*?<span[^>]*>\s*([^<]+)<", 1), None)


def json_number(text: Column, path: str, default: float = 0.0) -> Column:
    """The number at a JSON path, or default."""
    return F.coalesce(F.get_json_object(text, path).try_cast("double"), F.lit(default))


def feed_titles(df: DataFrame, xml: str = "xml") -> DataFrame:
    """title: the items of RSS and Atom feeds."""
    paths = ("//item/title/text()", "//*[local-name()='entry']/*[local-name()='title']/text()")
    return df.select(F.explode(F.concat(*[F.xpath(F.col(xml), F.lit(p)) for p in paths])).alias("title"))


def klines(df: DataFrame, text: str = "value") -> DataFrame:
    """ts, open, high, low, close, volume of JSON arrays of arrays with epoch milliseconds."""
    rows = df.select(F.explode(F.from_json(text, "array<array<string>>")).alias("k"))
    number = lambda i: F.get("k", F.lit(i)).try_cast("double")
    return rows.select(F.timestamp_millis(F.get("k", F.lit(0)).try_cast("long")).alias("ts"), *[number(i + 1).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))])


def order_book(df: DataFrame, text: str = "value") -> DataFrame:
    """price, quantity, side of a JSON book with bids and asks."""
    book = df.select(F.from_json(text, "struct<bids:array<array<string>>,asks:array<array<string>>>").alias("b"))
    side = lambda s: book.select(F.explode(f"b.{s}s").alias("l")).select(F.get("l", F.lit(0)).try_cast("double").alias("price"), F.get("l", F.lit(1)).try_cast("double").alias("quantity"), F.lit(s).alias("side"))
    return side("bid").unionByName(side("ask"))


def csv_prices(spark: SparkSession, path: str, lookback_days: int | None = None, as_of: str | None = None) -> DataFrame:
    """date, open, high, low, close of a CSV with a declared schema, from lookback_days before as_of."""
    df = spark.read.option("header", True).schema("date timestamp_ntz, open double, high double, low double, close double").csv(path)
    return df if lookback_days is None else df.filter(F.col("date") >= F.expr(f"cast('{as_of}' as timestamp_ntz) - interval {int(lookback_days)} days"))


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links, n_items of raw pages."""
    links = F.size(F.regexp_extract_all("html", F.lit(r"<a href="), 0))
    return pages.select("page_id", F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"), links.cast("long").alias("n_links"), F.size(F.regexp_extract_all("html", F.lit("<li>"), 0)).cast("long").alias("n_items"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modified, size of the files below a folder of any store; nothing is read of their content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def newest_file(found: DataFrame) -> DataFrame:
    """The file changed last, of rows of files(): what to fall back on."""
    return found.orderBy(F.col("modified").desc(), F.col("path").desc()).limit(1)


def pipeline_status(found: DataFrame, as_of: Column) -> DataFrame:
    """name, modified, lag_hours, stale (a day or more) of rows of files()."""
    lag = (as_of.cast("timestamp").cast("double") - F.col("modified").cast("double")) / 3600
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "modified", lag.alias("lag_hours"), (lag >= 24).alias("stale"))


def intervals(found: DataFrame) -> DataFrame:
    """interval, path of files named <anything>_<interval>.<ending>; of several the last by name."""
    interval = F.regexp_extract("path", r"_([0-9]+[mhdw])\.[A-Za-z]+$", 1)
    return found.withColumn("interval", interval).filter(F.col("interval") != "").groupBy("interval").agg(F.max("path").alias("path"))


def extracted(df: DataFrame, rules: list[dict], text: str = "text") -> DataFrame:
    """df with one column a rule. A rule has name, strategy and what it needs: label_regex (pattern, group), json_path (path), text_block_contains (words), stat_label_value (label: the number after it)."""
    for r in rules:
        c = F.col(text)
        if r["strategy"] == "label_regex":
            got = F.nullif(F.regexp_extract(c, r["pattern"], r.get("group", 1)), F.lit(""))
        elif r["strategy"] == "json_path":
            got = F.get_json_object(c, r["path"])
        elif r["strategy"] == "text_block_contains":
            got = F.forall(F.array(*map(F.lit, r["words"])), lambda w: F.contains(c, w))
        elif r["strategy"] == "stat_label_value":
            got = F.nullif(F.regexp_extract(c, re.escape(r["label"]) + r"\D{0,40}?(-?[0-9][0-9,]*\.?[0-9]*)", 1), F.lit("")).cast("string")
        else:
            raise ValueError(f"unknown strategy {r['strategy']}")
        df = df.withColumn(r["name"], got)
    return df
