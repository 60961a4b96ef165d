"""Sparse series, prices near zero, levels by bucket, clusters by run, folds by rank, briefings, logs and scalars, against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import scalars
from brindle.operators import briefing, evaluation, indicators, kernels, levels, risk, zones
from brindle.sources import readers, sinks

T0 = dt.datetime(2024, 1, 1)


def bars(spark, rows):
    """rows: symbol, high, low, close, volume, an hour apart."""
    data = [(s, T0 + dt.timedelta(hours=i), float(c), float(h), float(lo), float(c), float(v)) for i, (s, h, lo, c, v) in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_of_sparse_series(spark, direction):
    rng = random.Random(1)
    marks = sorted(rng.sample(range(400), 6))
    right = spark.createDataFrame([(k, T0 + dt.timedelta(hours=h), float(h)) for k in ("a", None) for h in marks] + [("a", T0, None)], "k string, ts timestamp_ntz, v double")
    left = spark.createDataFrame([(k, T0 + dt.timedelta(hours=h)) for k in ("a", None, "b") for h in range(0, 420, 7)], "k string, ts timestamp_ntz")
    name = "asof_v" if direction == "backward" else "next_v"
    for tolerance, most in ((None, 10**9), ("2 days", 48)):
        got = {(r["k"], r["ts"]): r[name] for r in evaluation.asof(left, right, "v", by="k", direction=direction, tolerance=tolerance).collect()}
        assert len(got) == 180
        for (k, ts), v in got.items():
            h = (ts - T0).total_seconds() / 3600
            fits = [m for m in marks if (m <= h if direction == "backward" else m > h)]
            want = (max(fits) if direction == "backward" else min(fits)) if fits and k != "b" else None
            assert v == (want if want is not None and abs(want - h) <= most else None)


def test_profile_of_prices_near_zero(spark):
    rng = random.Random(2)
    rows = [("x", p * 1.5, p, p * 1.2, rng.randint(1, 9)) for p in [0.001, *(rng.uniform(1, 60) for _ in range(40))]]
    out = levels.volume_profile(bars(spark, rows)).orderBy("first_bin").collect()
    lo, hi = 0.001, max(r[1] for r in rows)
    edges = math.floor((hi - lo) / (lo * 0.005))
    assert edges > 1_000_000 and out[-1]["last_bin"] == edges - 2 and len(out) < 2 * len(rows) + 1
    step = (hi - lo) / (edges - 1)
    place = lambda x: min(max(math.floor((x - lo) / step) + 1, 1), edges) - 1
    for r in out:
        want = sum(v for _, h, low, _, v in rows if place(low) <= r["first_bin"] <= min(max(place(h), place(low)), edges - 2))
        assert r["volume"] == want
    assert levels.volume_peaks(bars(spark, rows)).filter("strength > 1 or strength <= 0").count() == 0
    flat = levels.volume_profile(bars(spark, [("z", 5, 0, 2, 1), ("z", 4, -1, 2, 1)])).collect()
    assert max(r["last_bin"] for r in flat) == 8


def test_touches_match_brute_force(spark):
    rng = random.Random(3)
    rows = [("x", h, h - rng.uniform(0, 3), h, 1) for h in (rng.uniform(0.5, 60) for _ in range(120))] + [("x", 0.0, 0.0, 0, 1)]
    prices = [r[1] for r in rows[::4]] + [0.0, -2.0, 1e6]
    got = {r["price"]: r["touches"] for r in levels.touches(spark.createDataFrame([("x", p) for p in prices], "symbol string, price double"), bars(spark, rows)).collect()}
    for p in prices:
        near = lambda x: p * 0.99 <= x <= p * 1.01  # noqa: E731, B023
        assert got[p] == sum(near(h) or near(lo) for _, h, lo, _, _ in rows)


def test_runs_give_the_clusters_of_the_whole(spark):
    rng = random.Random(4)
    prices = [round(rng.uniform(50, 150), 3) for _ in range(150)]
    factors = spark.createDataFrame([("x", p, "round_number", 0.5, "support") for p in prices], "symbol string, price double, factor_type string, strength double, direction string")
    cur = spark.createDataFrame([("x", 100.0)], "symbol string, cur double")
    mine = {}
    for r in zones.clustered(factors, cur, 0.004).collect():
        mine.setdefault(r["cluster"], set()).add(r["price"])
    whole = kernels.linkage_1d(np.array(prices), 0.4)
    want = {frozenset(p for p, c in zip(prices, whole) if c == k) for k in set(whole.tolist())}
    assert {frozenset(v) for v in mine.values()} == want and len(want) > 20


def test_fold_by_rank(spark):
    xs = [random.Random(5).uniform(0, 9) for _ in range(70)]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=i), x) for i, x in enumerate(xs)] + [("b", T0, 4.0)], "source string, ts timestamp_ntz, x double")
    want = xs[0]
    for x in xs[1:]:
        want = want * 0.9 + x * 0.1
    got = {r["source"]: r["ewma"] for r in indicators.ema_fold(df, "x", 0.9).collect()}
    assert got["a"] == pytest.approx(want) and got["b"] == 4.0


def test_macd_of_blocks_is_that_of_the_whole(spark):
    rng = random.Random(7)
    rows = [("x", c, c, c, 1) for c in (rng.uniform(10, 20) for _ in range(1300))]
    a, b = ({r["ts"]: r["macd_signal"] for r in indicators.macd(bars(spark, rows), block=n).collect()} for n in (400, 10**6))
    assert len(a) == 1300 and all(a[t] == pytest.approx(b[t], abs=1e-9) for t in b)


def test_garch_recovers_its_parameters():
    rng = np.random.default_rng(6)
    h, out = 1.0, []
    for _ in range(3000):
        x = rng.normal() * math.sqrt(h)
        out.append(x)
        h = 0.1 + 0.15 * x * x + 0.75 * h
    assert kernels.garch_next_variance(np.array(out)) == pytest.approx(h, rel=0.15)
    assert kernels.garch_next_variance(np.zeros(5)) == 0.0


def test_history_over_a_low_of_zero(spark):
    """As doubles divide in SQL: infinite over zero, NaN for zero over zero, null only without values."""
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at, 4.0, 0.0, 1.0), ("a", at + dt.timedelta(hours=1), 5.0, 2.0, 3.0), ("b", at, 0.0, 0.0, 0.0), ("c", at, 4.0, 1.0, 2.0), ("d", at, None, None, None)]
    got = {r["symbol"]: (r["from_high_pct"], r["from_low_pct"]) for r in risk.history_position(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, high double, low double, close double")).collect()}
    assert got["a"] == (-40.0, math.inf) and got["c"] == (-50.0, 100.0) and got["d"] == (None, None)
    assert all(map(math.isnan, got["b"]))


def test_zone_at_a_price_of_zero(spark):
    """As the SQL of zone_scores_on_grid has it: 0 / 0 is NaN, above all numbers, so the score is 1; without strength there is no zone, and the score is 0."""
    rows = [("a", 0, 0.0, 0.6, "support", "swing_point", 50.0)] * 2 + [("a", 1, 2.0, 0.6, "support", "swing_point", 50.0)] * 2 + [("a", 2, 4.0, 0.0, "support", "swing_point", 50.0)] * 2
    df = spark.createDataFrame(rows, "symbol string, cluster long, price double, strength double, direction string, factor_type string, cur double")
    got = {r["cluster"]: (r["zone_price"], r["score"], r["strength"]) for r in zones.scored(df).collect()}
    assert got[0] == (0.0, 1.0, "critical") and got[2] == (None, 0.0, "weak")
    assert got[1][0] == 2.0 and math.isclose(got[1][1], 0.6 + 0.015 + 0.06 - 0.15)


def test_bias_and_guidance(spark):
    rows = [("a", "bull", 3.0, 2e9, "normal", 0.8, 90.0, 100.0), ("b", "bear", -2.0, -1.0, "extreme", 0.6, None, 100.0), ("c", "odd", None, None, None, 0.1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, regime string, return_7d double, net_flow_7d double, volatility_class string, risk_score double, support double, close double")
    got = {r["symbol"]: r for r in briefing.guidance(briefing.bias(df)).collect()}
    assert got["a"]["net_bias"] == "bullish" and got["a"]["bullish"] == ["Bullish regime: bull", "Positive 7-day momentum: 3.0%", "Positive ETF flows: $2.00B"]
    assert got["b"]["net_bias"] == "bearish" and got["b"]["horizon"] == "intraday_scalping" and got["b"]["stop_distance_pct"] is None
    assert got["c"]["net_bias"] == "neutral" and got["c"]["timing"] is None and got["a"]["stop_distance_pct"] == pytest.approx(10)
    names = briefing.instructions(briefing.characteristics(df)).collect()
    assert names[2]["traits"] == [] and names[2]["expected"] == briefing.OTHERWISE and names[0]["synthesizer"] is None


def test_decision_log(spark):
    empty = spark.createDataFrame([], "id long, made_at timestamp_ntz, context string, outcome double, reflection string")
    log = sinks.appended(empty, spark.createDataFrame([(1, T0, "up"), (2, T0, None)], "id long, made_at timestamp_ntz, mood string"), ["mood"])
    updates = spark.createDataFrame([(1, T0, 0.5, None), (1, T0 + dt.timedelta(1), None, "late"), (1, T0 + dt.timedelta(2), 0.7, None)], "id long, at timestamp_ntz, outcome double, reflection string")
    got = {r["id"]: r for r in sinks.with_outcomes(log, updates).collect()}
    assert (got[1]["outcome"], got[1]["reflection"], got[2]["outcome"]) == (0.7, "late", None) and got[1]["context"] == '{"mood":"up"}'


def test_scalars_and_files(spark, tmp_path):
    df = spark.createDataFrame([('```json\n{"k": 3}\n```', "2024-02-03T04:05:06Z", "BTCUSDT"), ("oops", "2024-02-03", None)], "a string, b string, c string")
    got = df.select(scalars.fenced_json(F.col("a"), "k long")["k"].alias("a"), scalars.parse_instant(F.col("b")).alias("b"), scalars.pair_base(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(3, dt.datetime(2024, 2, 3, 4, 5, 6), "BTC"), (None, dt.datetime(2024, 2, 3), None)]
    for name in ("prices_4h.csv", "prices_1d.csv", "old_1d.csv", "notes.txt"):
        (tmp_path / name).write_text("x")
    found = readers.files(spark, str(tmp_path))
    assert {r["interval"]: r["path"].split("/")[-1] for r in readers.intervals(found).collect()} == {"4h": "prices_4h.csv", "1d": "prices_1d.csv"}
    assert readers.newest_file(found).count() == 1 and readers.pipeline_status(found, F.current_timestamp()).filter("stale").count() == 0
    page = spark.createDataFrame([("Total Supply: 19,500 BTC <b>ok</b>", '{"a":{"b":7}}')], "text string, js string")
    rules = [{"name": "n", "strategy": "stat_label_value", "label": "Total Supply"}, {"name": "has", "strategy": "text_block_contains", "words": ["BTC", "ok"]}]
    row = readers.extracted(readers.extracted(page, rules), [{"name": "j", "strategy": "json_path", "path": "$.a.b"}], "js").first()
    assert (row["n"], row["has"], row["j"]) == ("19,500", True, "7")
    assert [r["data"] for r in sinks.split_rows(spark.createDataFrame([(1, "a\"b", None)], "i int, s string, n double")).collect()] == ['[1,"a\\"b",null]']
