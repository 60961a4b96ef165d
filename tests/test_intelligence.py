"""Reports in words and validation, on small tables with gaps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.operators import decisions, intelligence, ml, quality
from brindle.sources import readers

CTX = "symbol string, regime string, confidence double, label string, duration long, traits array<string>, n_signals long, signal string, direction string, signal_confidence double, risk_level string, risk_score double, risks array<string>, support double, mean_confidence double, trend string, flow string, divergence double"


def context(spark):
    return spark.createDataFrame(
        [
            ("a", "bull", 0.75, "very_bullish", 12, ["Sustained uptrend", "x"], 2, "Golden Cross", "bullish", 0.9, "high", 0.8, ["Extreme Volatility", "Significant Drawdown", "Third"], 41234.6, 0.75, "bullish", "inflow", 0.4),
            ("b", "volatile", 0.5, None, None, [], 0, None, None, None, None, None, [], None, None, None, None, None),
        ],
        CTX,
    )


def test_narratives(spark):
    a, b = sorted(intelligence.narratives(context(spark)).collect(), key=lambda r: r["symbol"])
    assert a["summary"] == "The market is currently in a **BULL** regime with 75% confidence. Sentiment is **very bullish**. Caution is advised due to elevated risk levels. "
    assert a["regime_text"].endswith("approx. 12 days. Characteristics suggest structure is sustained uptrend.")
    assert a["signal_text"] == "Detected 2 active signals. Primary signal is **Golden Cross** (bullish) with 90% confidence."
    assert a["risk_text"] == "Risk environment is rated **HIGH** (Score: 80/100). Primary concerns include: Extreme Volatility, Significant Drawdown."
    assert b["summary"] == "The market is currently in a **VOLATILE** regime with 50% confidence. " and "approx. 0 days" in b["regime_text"] and b["regime_text"].endswith("undefined.")
    assert b["signal_text"] == intelligence.NO_SIGNALS and b["risk_text"].startswith("Risk environment is rated **UNKNOWN** (Score: 0/100)")


def test_actions_are_ranked(spark):
    got = [(r["symbol"], r["place"], r["action"], r["priority"]) for r in intelligence.ranked_actions(context(spark)).orderBy("symbol", "place").collect()]
    assert got == [("a", 1, "Tighten Stop Losses", "critical"), ("a", 2, "Reduce Position Size", "high"), ("a", 3, "Accumulate Spot", "high"), ("a", 4, "Monitor Support at $41,235", "medium"), ("b", 1, "Monitor Support at $0", "medium")]


def test_reasoning_of_known_and_unknown_parts(spark):
    a, b = sorted(intelligence.reasoning(context(spark)).collect(), key=lambda r: r["symbol"])
    assert a["branch"]["action"] == "seek_long_setups" and list(a["workflows"]) == [] and a["claims"][0]["validity"] == "current" and a["uncertainties"]["cross_source_divergence"] == 0.4
    assert b["branch"] is None and b["workflows"] == ["regime_transition_audit", "tail_risk_scrub"] and b["uncertainties"]["signal_reliability"] == 1.0 and b["uncertainties"]["cross_source_divergence"] == 0.2
    assert b["checks"][1] == "Do ETF flows support unknown bias?" and "Price momentum: unknown" in b["claims"][0]["evidence"]


def test_daily_report(spark):
    rows = [(dt.date(2024, 1, d), o, 9.0, 1.0, c, t, f, h, oi) for d, o, c, t, f, h, oi in [(1, 5.0, 6.0, 2e10, 100.0, 98.0, 3e9), (2, 5.0, 6.0, 1e9, 100.0, 90.0, 0.0), (3, 6.0, 5.0, None, 100.0, None, None), (4, None, None, None, 0.0, 5.0, 1e9), (5, 1.0, 1.0, 1.0, -100.0, -140.0, None)]]
    df = spark.createDataFrame(rows, "date date, open double, high double, low double, close double, turnover double, net_flow double, holdings_flow double, open_interest double")
    out = {r["date"].day: r for r in intelligence.daily_report(df).collect()}
    assert [out[d]["confidence"] for d in range(1, 6)] == [100, 85, 20, 20, 50] and out[2]["status"] == "Verified" and out[5]["status"] == "Caution"
    assert out[1]["thoughts"] == ["Price closed UP at $6.00. High volume proxy ($20.0B) suggests sustained accumulation.", "Open Interest at $3.0B. High OI with positive funding suggests heavy long positioning."]
    assert "potential exhaustion" in out[2]["thoughts"][0] and len(out[2]["thoughts"]) == 1 and "DOWN" in out[3]["thoughts"][0] and len(out[4]["thoughts"]) == 1
    assert out[3]["check"].startswith("CONSENSUS [Caution]: 20% confidence. primary ($100.0M) vs Holdings-Derived ($0.0M).")


def test_market_summary_without_flows(spark):
    daily = spark.createDataFrame([("a", dt.datetime(2024, 1, d), float(d)) for d in range(1, 4)] + [("late", dt.datetime(2025, 1, 1), 1.0)], "symbol string, ts timestamp_ntz, close double")
    none = spark.createDataFrame([], "date date, ticker string, flow_usd double")
    (r,) = intelligence.market_summary(daily, none, "2024-01-04 00:00:00").collect()
    assert (r["symbol"], r["current"], r["change_1d"], r["change_7d"], r["net_flow_7d"], r["top_inflows"], r["freshness_hours"]) == ("a", 3.0, 50.0, 0.0, 0.0, [], 24.0)


def test_patterns_of_critiques(spark):
    rows = [("g", "misread RSI"), ("g", "FOMO and leverage"), ("g", "tends to chase pumps"), ("h", "fine"), ("h", None), ("t", "leverage"), ("t", "RSI")]
    out = {r["k"]: (r["pattern"], r["frequency"], r["status"]) for r in decisions.critique_patterns(spark.createDataFrame(rows, "k string, critique string"), "k").collect()}
    assert out["g"][:2] == ("FOMO_behavior", 2) and out["t"][:2] == ("RSI_misinterpretation", 1) and out["h"] == (None, None, "No systemic patterns found")


def test_validation_suite(spark):
    df = spark.createDataFrame([(1.0, 5, "x", dt.datetime(2024, 1, 1))] * 30 + [(99.0, 5, None, dt.datetime(2024, 1, 2)), (None, None, None, None)], "open double, k int, s string, ts timestamp_ntz")
    (r,) = quality.validation_suite(df, "other", "ts", "2024-01-02 12:00:00").collect()
    assert (r["status"], r["n"], r["missing"], r["age_hours"], r["outliers"]) == ("valid", 32, [], 12.0, {"open": 1})
    (r,) = quality.validation_suite(df, "price", "ts", "2024-01-02 12:00:00").collect()
    assert r["status"] == "invalid" and r["missing"] == ["high", "low", "close"]
    (r,) = quality.validation_suite(df.select("s", "ts"), "other", "ts", "2024-01-04").collect()
    assert r["status"] == "stale" and r["outliers"] == {}
    (r,) = quality.validation_suite(df.limit(0), "other", "ts", "2024-01-04").collect()
    assert r["status"] == "valid" and r["n"] == 0
    assert quality.validate_dataset(df, "other", ["open"], "ts", "2024-01-02 12:00:00") == {"status": "valid", "warnings": ["open: 1 outliers"]}


def test_gate_of_tables_equals_the_function(spark):
    cases = [(1.0, None, True), (0.99, 1.0, True), (0.97, 1.0, True), (2.0, 1.0, False), (1.0, 0.0, True)]
    got = [r["p"] for r in spark.createDataFrame(cases, "a double, b double, c boolean").select(ml.promoted(F.col("a"), F.col("b"), F.col("c")).alias("p")).collect()]
    assert got == [ml.promote(*c) for c in cases]


def test_funding_rows_need_three_cells(spark):
    html = "<table><tr><th>Exchange</th><th>Now</th><th>Predicted</th></tr><tr><td>x</td><td>1%</td><td>2%</td></tr><tr><td>y</td><td>1%</td></tr></table>"
    df = spark.createDataFrame([("p", html), ("q", "<p>nothing</p>"), ("r", None)], "path string, html string")
    assert [tuple(r) for r in readers.funding_table(df).collect()] == [("x", "1%", "2%")]


def test_forest_is_kept(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 7 - i % 3)) for i in range(60)], "a double, b double, target double")
    forest = ml.Forest.fit(df, ["a", "b"], trees=5, depth=4)
    forest.save(str(tmp_path / "f"))
    again = ml.Forest.load(spark, str(tmp_path / "f"))
    assert again.features == ["a", "b"] and again.rmse(df) == pytest.approx(forest.rmse(df))
