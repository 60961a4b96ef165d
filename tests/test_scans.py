"""Rank counting, clustering and recursions in blocks, against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.operators import garch, levels, risk, zones
from brindle.operators.kernels import decayed, garch_next_variance, linkage_1d

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, rows):
    """Rows of (symbol, low, high), a day each."""
    days = pd.date_range("2024-01-01", periods=max(1, len(rows)), freq="D")
    return spark.createDataFrame([(s, d.to_pydatetime(), lo, hi, lo, hi, 1.0) for d, (s, lo, hi) in zip(days, rows)], BAR)


def test_touches_on_ties_nulls_and_wide_bars(spark):
    rng = np.random.default_rng(4)
    rows = [(s, float(lo), float(lo + w)) for s in "ab" for lo, w in zip(rng.integers(90, 112, 150) / 1.0, rng.choice([0, 0.5, 1, 2, 20], 150))]
    rows += [("a", 99.0, None), ("a", None, 101.0), ("a", None, None), ("c", 5.0, 5.0), ("a", 101.0, 99.0), ("a", 0.0, 0.0)]
    prices = [0.0, -3.0, 100.0, 101.0, 99.0, 100.5, 102.01, 97.0, 1e9]
    own = spark.createDataFrame([(s, p) for s in ("a", "b", "d") for p in prices] + [("a", 100.0)], "symbol string, price double")
    got = sorted((r["symbol"], r["price"], r["touches"]) for r in levels.touches(own, bars(spark, rows)).collect())

    def brute(s, p):
        near = lambda x: x is not None and p >= 0 and p * (1 - 0.01) <= x <= p * (1 + 0.01)
        return sum(1 for t, lo, hi in rows if t == s and (near(lo) or near(hi)))

    assert got == sorted((s, p, brute(s, p)) for s, p in [(s, p) for s in ("a", "b", "d") for p in prices] + [("a", 100.0)])


def test_no_operator_of_touches_puts_out_pairs(spark):
    """A thousand bars at one price and a hundred levels there: the rows of the plan stay a few times their sum."""
    one = bars(spark, [("a", 100.0, 100.5)] * 1000)
    own = spark.createDataFrame([("a", 100 + k / 1000) for k in range(100)], "symbol string, price double")
    df = levels.touches(own, one)
    assert df.agg(F.sum("touches")).first()[0] == 100_000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_zone_tests_match_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(s, float(lo), float(lo + w)) for s in "ab" for lo, w in zip(rng.integers(80, 130, 300), rng.integers(0, 9, 300))]
    found = [("a", 1, 90.0, 88.0, 92.0), ("a", 2, 101.0, 101.0, 101.0), ("a", 3, 110.0, 95.0, 120.0), ("a", 4, 500.0, 500.0, 500.0), ("b", 1, 85.0, 84.0, 85.5), ("b", 2, 129.0, 128.0, 131.0)]
    df = bars(spark, rows)
    z = spark.createDataFrame(found, "symbol string, cluster long, zone_price double, low double, high double")
    got = {(r["symbol"], r["cluster"]): (r["tests"], r["last_test"]) for r in zones.tested(z, df).collect()}
    table = df.toPandas()
    for s, c, p, lo, hi in found:
        tol = max((hi - lo) / 2, p * 0.001)
        hit = table[(table.symbol == s) & (table.low <= p + tol) & (table.high >= p - tol)]
        assert got[s, c] == (len(hit), hit.ts.max() if len(hit) else None)


def test_a_flat_symbol_has_no_profile(spark):
    """Neither a price that never moves nor a series without volume stops the others."""
    moving = [("b", 100.0 + k % 7, 103.0 + k % 7) for k in range(60)]
    df = bars(spark, [("a", 5.0, 5.0)] * 60 + moving + [("z", 0.0, 0.0)] * 60)
    silent = bars(spark, [("c", 1.0 + k, 2.0 + k) for k in range(60)]).withColumn("volume", F.lit(0.0))
    both = df.unionByName(silent)
    assert {r["symbol"] for r in levels.volume_profile(both).collect()} == {"b"}
    assert {r["symbol"] for r in levels.volume_peaks(both).collect()} <= {"b"}
    assert {r["symbol"] for r in levels.all_factors(both).filter("factor_type = 'volume_profile'").collect()} <= {"b"}
    assert zones.confluence_zones(levels.all_factors(both), both, 0.0).filter("symbol = 'b'").count() > 0


def linkage_by_rescanning(values, threshold):
    order = np.argsort(values, kind="stable")
    groups = [[float(values[i]), 1, [int(i)]] for i in order]
    while len(groups) > 1:
        gaps = [b[0] / b[1] - a[0] / a[1] for a, b in zip(groups, groups[1:])]
        at = int(np.argmin(gaps))
        if gaps[at] >= threshold:
            break
        a, b = groups[at], groups.pop(at + 1)
        groups[at] = [a[0] + b[0], a[1] + b[1], a[2] + b[2]]
    out = np.zeros(len(values), np.int64)
    for k, (_, _, rows) in enumerate(groups):
        out[rows] = k
    return out


@pytest.mark.parametrize("seed", range(12))
def test_linkage_by_heap_equals_rescanning(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 120))
    values = [rng.normal(0, 3, n), rng.integers(0, 30, n).astype(float), rng.exponential(1, n).cumsum(), np.full(n, 2.0)][seed % 4]
    for threshold in (0.0, 0.3, 1.0, 1e9):
        assert (linkage_1d(values, threshold) == linkage_by_rescanning(values, threshold)).all()


def test_linkage_of_a_hundred_thousand():
    values = np.random.default_rng(0).normal(100, 5, 100_000)
    out = linkage_1d(values, 0.5)
    means = np.bincount(out, values) / np.bincount(out)
    assert (np.diff(means) >= 0.5).all() and len(means) > 20


def test_decayed_sums():
    x = np.random.default_rng(3).exponential(1, 77)
    for rate, got in zip((0.0, 0.3, 0.99, 1.0), decayed(x, np.array([0.0, 0.3, 0.99, 1.0]))):
        s, want = 0.0, [0.0]
        for v in x:
            s = v + rate * s
            want.append(s)
        assert got == pytest.approx(want, rel=1e-12)


def returns(seed, n):
    rng, h, out = np.random.default_rng(seed), 1.0, []
    for _ in range(n):
        out.append(math.sqrt(h) * rng.normal())
        h = 0.05 + 0.12 * out[-1] ** 2 + 0.83 * h
    return np.array(out)


def test_garch_in_blocks_equals_the_serial_fit(spark):
    series = {"a": returns(1, 2500), "b": 3 * returns(2, 1300), "c": np.random.default_rng(5).normal(0, 1, 257), "d": returns(6, 65)}
    rows = [(s, i, float(v * v)) for s, r in series.items() for i, v in enumerate(r)]
    df = spark.createDataFrame(rows, "symbol string, ts long, r2 double").repartition(5)
    got = {r["symbol"]: r["variance"] for r in garch.next_variances(df, 64).collect()}
    for s, r in series.items():
        assert got[s] == pytest.approx(garch_next_variance(r), rel=1e-9)


def test_garch_of_short_long_flat_and_scarce_series(spark):
    rows = []
    for s, r in {"long": returns(3, 300) / 100, "short": returns(4, 50) / 100, "flat": np.zeros(40), "few": returns(5, 8) / 100, "none": np.zeros(0)}.items():
        close = 100 * np.exp(np.concatenate([[0], np.cumsum(r)]))
        rows += [(s, d.to_pydatetime(), c, c, c, c, 1.0) for d, c in zip(pd.date_range("2024-01-01", periods=len(close), freq="D"), close.tolist())]
    df = spark.createDataFrame(rows, BAR)
    cut = {r["symbol"]: r["garch_vol"] for r in risk.garch_volatility(df, block=100).collect()}
    whole = {r["symbol"]: r["garch_vol"] for r in risk.garch_volatility(df).collect()}
    assert cut.keys() == whole.keys() == {"long", "short", "flat", "few", "none"} and cut["few"] is None and cut["none"] is None and cut["flat"] == 0.0
    assert cut["long"] == pytest.approx(whole["long"], rel=1e-9) and cut["short"] == whole["short"]
