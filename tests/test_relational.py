import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.functions import scalars
from brindle.operators import consensus, decisions, evaluation, flows, ml, quality, sentiment
from brindle.sources import readers, sinks


def one(df):
    return df.collect()[0]


def test_html_price_table(spark):
    html = "<table><tr><th>Date</th><th>Open</th><th>High</th><th>Low</th><th>Close</th></tr><tr><td>01/01/2023</td><td>100</td><td>105</td><td>95</td><td>1.5K</td></tr><tr><td>soon</td><td>1</td><td>1</td><td>1</td><td>1</td></tr></table>"
    rows = readers.price_table(spark.createDataFrame([("p", html)], "path string, html string")).collect()
    assert len(rows) == 1 and rows[0]["date"] == dt.date(2023, 1, 1) and rows[0]["close"] == 1500 and rows[0]["high"] == 105


def test_flow_table_and_total(spark):
    html = "<table><tr><th>Date</th><th>IBIT</th><th>Total</th></tr><tr><td>2024-01-02</td><td>-</td><td>1,234.5</td></tr></table>"
    long = readers.flow_table(spark.createDataFrame([("p", html)], "path string, html string"))
    assert {(r["ticker"], r["value"]) for r in long.collect()} == {("IBIT", 0.0), ("Total", 1234.5)}
    assert one(readers.net_flows(long))["net_flow"] == 1234.5


def test_open_interest_and_feed(spark):
    df = spark.createDataFrame([("<div>Open Interest All: $10.5B</div>", "<rss><channel><item><title>Big rally</title></item></channel></rss>")], "html string, xml string")
    assert one(df.select(readers.open_interest_text(F.col("html"))))[0] == pytest.approx(1.05e10)
    assert one(readers.feed_titles(df))["title"] == "Big rally"


def test_klines_and_book(spark):
    k = one(readers.klines(spark.createDataFrame([('[[1704067200000,"1","2","0.5","1.5","10"]]',)], "value string")))
    assert k["close"] == 1.5 and k["volume"] == 10
    b = readers.order_book(spark.createDataFrame([('{"bids":[["9","1"]],"asks":[["10","2"]]}',)], "value string")).collect()
    assert {(r["side"], r["price"]) for r in b} == {("bid", 9.0), ("ask", 10.0)}


def test_large_number(spark):
    df = spark.createDataFrame([(1.5e9,), (2e6,), (3250.0,), (12.0,), (None,)], "x double")
    assert [r[0] for r in df.select(scalars.large_number(F.col("x"))).collect()] == ["$1.50B", "$2.00M", "$3.25K", "$12.00", "N/A"]


def test_flow_normalising(spark):
    long = spark.createDataFrame([("2024-01-01", "IBIT", "USD", 1000.0), ("2024-01-01", "IBIT", "BTC", 0.1), ("2024-01-02", "IBIT", "USD", 2000.0)], "date string, ticker string, field string, value double")
    rows = {r["date"]: r for r in flows.pivot_flows(long, ["USD", "BTC"]).collect()}
    assert rows["2024-01-01"]["BTC"] == 0.1 and rows["2024-01-02"]["BTC"] is None and len(rows) == 2


def test_price_normalising(spark):
    raw = spark.createDataFrame([("2024-01-01", "100", "x"), ("2024-01-01", "200", "2"), ("bad", "1", "1")], "Date string, OPEN string, Close string")
    rows = {r["date"]: r for r in flows.normalize_prices(raw).collect()}
    assert rows[dt.date(2024, 1, 1)]["open"] == 100 and rows[dt.date(2024, 1, 1)]["close"] is None


def test_consensus(spark):
    q = spark.createDataFrame([(1, "binance", 43000.0), (1, "coingecko", 43010.0), (1, "kraken", 43005.0), (1, "bad_feed", 45000.0), (2, "binance", 10.0)], "item int, source string, value double")
    rows = {r["item"]: r for r in consensus.price_consensus(q).collect()}
    assert rows[1]["price"] == pytest.approx(43005, abs=1) and rows[1]["n_outliers"] == 1 and rows[1]["confidence"] > 0.95
    assert rows[2]["confidence"] == pytest.approx(0.8)


def test_asof_both_ways(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([(t(5), "a"), (t(7), "b"), (t(1), "c")], "ts timestamp_ntz, k string")
    right = spark.createDataFrame([(t(5), 1.0), (t(6), None), (t(8), 2.0)], "ts timestamp_ntz, close double")
    assert {r["k"]: r["asof_close"] for r in evaluation.asof(left, right, "close").collect()} == {"a": 1.0, "b": 1.0, "c": None}
    assert {r["k"]: r["next_close"] for r in evaluation.asof(left, right, "close", direction="forward").collect()} == {"a": 2.0, "b": 2.0, "c": 1.0}


def test_prediction_accuracy(spark):
    closes = [100, 105, 103, 108, 110, 108, 112, 115, 113, 118]
    t = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    bars = spark.createDataFrame([(t(i), float(c)) for i, c in enumerate(closes)], "ts timestamp_ntz, close double")
    p = [(t(i), "BULLISH" if closes[i + 1] > closes[i] else "BEARISH", float(closes[i + 1])) for i in range(9)]
    got = one(evaluation.summarize_predictions(evaluation.evaluate_predictions(spark.createDataFrame(p, "ts timestamp_ntz, direction string, price_target double"), bars)))
    assert got["accuracy"] == 1.0 and got["n"] == 9 and got["mean_edge_pct"] > 0 and got["rmse"] == 0


def test_merge_modes(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    read = lambda df: {r["k"]: r["v"] for r in df.collect()}
    assert read(sinks.merged(old, new, ["k"])) == {1: "a", 2: "B", 3: "C"}
    assert read(sinks.merged(old, new, ["k"], "insert_only")) == {1: "a", 2: "b", 3: "C"}
    assert read(sinks.merged(old, new, ["k"], "update", ["v"])) == {1: "a", 2: "B", 3: "C"}


def test_outliers_and_drift(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(99)] + [(500.0,)], "x double")
    assert quality.outliers(df, "x", "price").filter("outlier").count() == 1
    assert quality.schema_drift(df, {"x": "double"}) == [] and quality.schema_drift(df, {"x": "string", "y": "int"}) == ["missing y", "x: double instead of string"]
    assert quality.validate_dataset(df, "price", ["x"])["status"] == "invalid"


def test_sentiment(spark):
    t = spark.createDataFrame([("s", "To the moon"), ("s", "Rally"), ("s", "buy now"), ("q", "nothing")], "source string, text string")
    got = {r["source"]: r["score"] for r in sentiment.title_score(t, "source").collect()}
    assert got == {"s": 100.0, "q": 50.0}


def test_facilitator(spark):
    v = spark.createDataFrame([("fly", "waiting", "will distribute", "calm", "bull_trending"), ("x", "accumulating", "x", "high beta", "sideways"), ("x", "x", "x", "decoupling, bullish", "high_volatility")], "retail string, institution string, whale string, macro string, regime string")
    got = [(r["decision"], r["confidence"], r["allocation"]) for r in decisions.size_by_regime(decisions.facilitate(v)).collect()]
    assert got == [("SELL", 0.85, 0.5), ("BUY", 0.6, 0.5), ("BUY", 0.85, 0.25)]


def test_forest_and_gate(spark):
    import random

    random.seed(1)
    rows = [(r := random.random(), s := random.random(), 2 * r - 1.5 * s) for _ in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, target double")
    f = ml.Forest.fit(df, ["a", "b"], trees=20)
    assert f.rmse(df) < 0.5
    assert 0 < f.predict_with_confidence([[0.9, 0.1]])[0][1] <= 1
    assert ml.promote(1.0, None, True) and not ml.promote(0.99, 1.0, True) and ml.promote(0.9, 1.0, True)


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())
