import datetime as dt

from pyspark.sql import functions as F

from brindle.operators import quality
from brindle.plans import api, report
from brindle.sources.views import Market

DATA = "/root/testdata/sf0.001"


def test_context_and_actions(spark):
    bars = Market(spark, DATA).bars()
    assert "regime" in api.context(bars, "click") and api.context(bars, "nobody") == ""
    assert "# click" in report.render(report.market_context(bars), "click", "markdown")
    assert api.action_plan(bars).filter(F.col("action").startswith("Monitor")).count() == 5
    assert api.opportunity_list(bars).columns == ["symbol", "opportunity", "confidence"]


def test_zones_and_history(spark):
    bars = Market(spark, DATA).bars()
    assert api.near_price(bars, 2).groupBy("symbol").count().filter("count > 2").count() == 0
    assert api.confluence_zones(bars, 0.3, 50.0).filter("score < 0.3 or abs(distance_pct) > 50").count() == 0
    last = api.price_history(bars, 2).agg(F.min("ts"), F.max("ts")).first()
    assert last[1] - last[0] <= dt.timedelta(days=2)


def test_catalogue_search_and_lineage(spark):
    m = Market(spark, DATA)
    stats = api.catalogue({"part": m.table("part"), "nation": m.table("nation")})
    assert stats.filter("table = 'nation' and column = 'n_name' and n = 25").count() == 1
    d = spark.createDataFrame([("prices", "daily price bars of bitcoin"), ("flows", "net flows of funds by ticker")], "name string, text string")
    assert api.search_catalogue(d, "price bars").first()["name"] == "prices"
    e = quality.lineage_event(d, "prices", ["raw"], "normalise", "2024-01-01").unionByName(quality.lineage_event(d, "prices", ["raw"], "merge", "2024-01-02"))
    assert [r["step"] for r in api.lineage(e, "prices").collect()] == ["merge", "normalise"]
