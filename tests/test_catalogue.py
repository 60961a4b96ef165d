"""Catalogues, lineage and exact selection against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions.selection import percentiles
from brindle.operators import catalogue
from brindle.operators.kernels import peaks


def test_merged_profiles_equal_one_pass(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice([None, 1, 2, 3]), rng.random() * 100) for _ in range(500)]
    df = spark.createDataFrame(rows, "day string, k int, v double")
    key = lambda d: {r["column"]: (r["type"], r["n"], r["nulls"], r["low"], r["high"], round(r["mean"], 9) if r["mean"] is not None else None) for r in d.collect()}
    parts = catalogue.merged(catalogue.profile(df, "day"))
    assert key(parts) == key(catalogue.merged(catalogue.profile(df.drop("day"))))
    got = {r["column"]: r for r in parts.collect()}
    assert got["k"]["nulls"] == sum(k is None for _, k, _ in rows) and abs(got["v"]["distinct"] - 500) <= 15
    assert abs(got["v"]["median"] - sorted(v for _, _, v in rows)[250]) < 5
    assert catalogue.merged(catalogue.profile(df.limit(0).drop("day"))).filter("n > 0").count() == 0


def test_drift_names_every_change(spark, tmp_path):
    spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double").write.parquet(str(tmp_path / "v1"))
    spark.createDataFrame([(1, None, 5)], "a long, b string, d int").write.parquet(str(tmp_path / "v2"))
    v1, v2 = (spark.read.parquet(str(tmp_path / v)) for v in ("v1", "v2"))
    out = {r["column"]: (r["change"], r["old_type"], r["new_type"], r["old_nulls"], r["new_nulls"]) for r in catalogue.drift(catalogue.merged(catalogue.profile(v1)), catalogue.merged(catalogue.profile(v2))).collect()}
    assert out == {"a": ("retyped", "int", "bigint", 0.0, 0.0), "b": ("same", "string", "string", 0.0, 1.0), "c": ("removed", "double", None, 0.0, None), "d": ("added", None, "int", None, 0.0)}
    assert catalogue.columns(spark, v2.schema).count() == 3


def test_ancestors_of_diamonds_and_cycles(spark):
    edges = [("report", "clean"), ("report", "raw2"), ("clean", "raw"), ("raw2", "raw"), ("raw", "feed"), ("feed", None), ("report", "clean")]
    df = spark.createDataFrame(edges, "id string, parent string")
    got = {(r["id"], r["ancestor"]): r["depth"] for r in catalogue.ancestors(df).collect()}
    assert got == {("report", "clean"): 1, ("report", "raw2"): 1, ("report", "raw"): 2, ("report", "feed"): 3, ("clean", "raw"): 1, ("clean", "feed"): 2, ("raw2", "raw"): 1, ("raw2", "feed"): 2, ("raw", "feed"): 1}
    with pytest.raises(ValueError, match="cycle"):
        catalogue.ancestors(df.unionByName(spark.createDataFrame([("feed", "report")], "id string, parent string")))
    with pytest.raises(ValueError, match="cycle"):
        catalogue.ancestors(spark.createDataFrame([("a", "a")], "id string, parent string"))
    assert catalogue.ancestors(df.limit(0)).count() == 0


def test_rounds_of_ancestors_double(spark, monkeypatch):
    edges = [(i, i - k) for i in range(24) for k in (1, 2) if i >= k]
    tables, inner = [], catalogue.written
    monkeypatch.setattr(catalogue, "written", lambda df, name: tables.append(name) or inner(df, name))
    got = {(r["id"], r["ancestor"]): r["depth"] for r in catalogue.ancestors(spark.createDataFrame(edges, "id long, parent long")).collect()}
    assert got == {(i, j): (i - j + 1) // 2 for i in range(24) for j in range(i)}
    assert len(tables) <= 5  # a table for each depth before: 14


@pytest.mark.parametrize("whole", [0, 10_000])
def test_percentiles_are_exact(spark, whole):
    """Also where every series goes through the bracket of its sketch."""
    rng = np.random.default_rng(3)
    series = {"normal": rng.normal(0, 1, 30_000), "ties": rng.integers(0, 4, 30_000).astype(float), "tail": rng.pareto(0.7, 30_000), "one": np.array([5.0]), "two": np.array([1.0, 2.0])}
    if whole == 0:
        series = {k: v for k, v in series.items() if len(v) > 2}
    rows = [(s, float(v)) for s, x in series.items() for v in x] + [("normal", None), ("empty", None)]
    out = {r["symbol"]: r for r in percentiles(spark.createDataFrame(rows, "symbol string, x double").repartition(5), "x", [0.0, 0.01, 0.05, 0.5, 1.0], list("abcde"), whole=whole).collect()}
    for s, x in series.items():
        assert [out[s][c] for c in "abcde"] == pytest.approx(np.percentile(x, [0, 1, 5, 50, 100]).tolist(), rel=1e-12)
    assert out["empty"]["a"] is None


def peaks_by_walking(y, least):
    n, out, i = len(y), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and y[j + 1] == y[i]:
            j += 1
        if j < n - 1 and y[i - 1] < y[i] and y[j + 1] < y[i]:
            at = (i + j) // 2
            left = right = at
            a = b = y[at]
            while left >= 0 and y[left] <= y[at]:
                a, left = min(a, y[left]), left - 1
            while right < n and y[right] <= y[at]:
                b, right = min(b, y[right]), right + 1
            if y[at] - max(a, b) >= least:
                out.append(at)
        i = j + 1
    return out


@pytest.mark.parametrize("seed", range(20))
def test_peaks_equal_walking(seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, int(rng.integers(2, 9)), int(rng.integers(0, 80))).astype(float)
    for least in (0.0, 1.0, 2.5):
        assert peaks(y, least).tolist() == peaks_by_walking(y, least)


def test_a_catalogue_tells_freshness(spark):
    from brindle.plans import api

    df = spark.createDataFrame([("2024-01-01 00:00:00", 1)], "t string, k int").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    out = {(r["table"], r["column"]): (r["n"], r["fresh"]) for r in api.catalogue({"a": df, "b": df.drop("ts")}, "2024-01-03", "ts").collect()}
    assert out["a", "k"] == (1, False) and out["b", "k"] == (1, None)
