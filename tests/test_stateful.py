"""Streams of several batches with restarts in between, against plain loops over all rows."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.streaming import bars as sb
from brindle.streaming import batches, keyed

T0 = datetime(2024, 3, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_last_rows_over_a_shuffled_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), at(rng.randrange(5000)), k, float(rng.randrange(100))) for k in range(300)]
    rng.shuffle(rows)
    tables = [spark.createDataFrame(rows[k::3], "symbol string, at timestamp, seq long, value double") for k in range(3)]
    out, _ = batches.run_batches(tables, lambda s: keyed.stream_last_rows(s, 40), str(tmp_path))
    got = {r["symbol"]: (r["n"], r["first"], r["last"], round(r["mean"], 9), r["low"], r["high"]) for r in batches.latest(out, ["symbol"]).collect()}
    for s in "ab":
        own = sorted((t, k, v) for x, t, k, v in rows if x == s)[-40:]
        values = [v for _, _, v in own]
        assert got[s] == (40, own[0][0], own[-1][0], round(sum(values) / 40, 9), min(values), max(values))


def test_kept_and_late_rows_are_all_rows(spark, tmp_path):
    """Rows behind the watermark are dropped only when their window has closed, and come out on the side."""
    rows = [[("a", at(m), 1.0 * m, 1.0) for m in range(0, 300, 10)], [("a", at(5), 2.0, 1.0), ("a", at(235), 3.0, 1.0), ("b", at(700), 4.0, 1.0)], [("a", at(250), 5.0, 1.0), ("b", at(710), 6.0, 1.0), ("a", at(601), 7.0, 1.0)]]
    tables = [spark.createDataFrame(r, "symbol string, ts timestamp, price double, qty double") for r in rows]
    out, runs = batches.run_batches(tables, lambda s: sb.stream_bars(sb.with_watermark(s, "1 hour"), "1 hour"), str(tmp_path))
    kept = {(r["symbol"], r["ts"]): r["volume"] for r in batches.latest(out, ["symbol", "ts"]).collect()}
    late = sorted(r["price"] for r in batches.late_rows(runs, "1 hour").collect())
    assert [w for _, w in runs][0] is None and late == [2.0, 5.0]
    assert sum(kept.values()) + len(late) == sum(map(len, rows))
    assert kept["a", at(180)] == 7 and kept["a", at(600)] == 1


def brute_moves(events, failures, pause, held):
    out, state = [], {}
    for key, t, _, failed in sorted(events, key=lambda e: (e[1], e[2])):
        n, last = state.get(key, (0, None))
        if n >= failures:
            if t - last <= pause:
                continue
            out.append((key, last + pause, "closed"))
            n = 0
        n, last = (n + 1, t) if failed else (0, last)
        state[key] = (n, last)
        if n >= failures:
            out.append((key, t, "open"))
    return sorted(out + [(k, last + pause, "closed") for k, (n, last) in state.items() if n >= failures and last + pause <= held])


@pytest.mark.parametrize("seed", [1, 5])
def test_breaker_opens_and_closes_once(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(rng.choice("abc"), at(m) + timedelta(seconds=rng.randrange(50)), m, rng.random() < 0.6) for m in range(0, 240)]
    tables = [spark.createDataFrame(events[k : k + 80], "key string, at timestamp, seq long, failed boolean").repartition(3) for k in (0, 80, 160)]
    out, _ = batches.run_batches(tables, lambda s: keyed.stream_breaker(s.withWatermark("at", "1 minute"), 3, 300.0), str(tmp_path), "append")
    want = brute_moves(events, 3, timedelta(seconds=300), max(e[1] for e in events) - timedelta(minutes=1))
    assert sorted((r["key"], r["at"], r["state"]) for r in out.collect()) == want and len(want) > 10


def test_breaker_calls_the_store_for_changes_only():
    calls = []

    class Store:
        value = None

        def __getattr__(self, name):
            return lambda *a: calls.append(name) or []

        def getValueState(self, *a):
            return self

        def get(self):
            return calls.append("get") or self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    breaker = keyed.Breaker(3, 300.0)
    breaker.init(Store())
    run = lambda *rows: list(breaker.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["at", "seq", "failed"])]), None))
    assert run((at(1), 1, False), (at(0), 0, True)) == [] and calls == ["get", "update"]
    calls.clear()
    assert run((at(2), 2, False)) == [] and calls == ["get"]
    calls.clear()
    opened = run((at(5), 5, True), (at(4), 4, True), (at(3), 3, True))[0]
    assert opened["state"].tolist() == ["open"] and calls == ["get", "registerTimer", "update"]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    rows = [[(1, at(0)), (1, at(30)), (2, at(10))], [(1, at(200)), (2, at(100))], [(3, at(900))]]
    tables = [spark.createDataFrame(r, "user_id long, ts timestamp") for r in rows]
    out, _ = batches.run_batches(tables, lambda s: sb.stream_sessions(sb.with_watermark(s, "2 hours")), str(tmp_path), "append")
    assert sorted((r["user_id"], r["start"], r["n"]) for r in out.select("user_id", "start", "n").collect()) == [(1, at(0), 2), (1, at(200), 1), (2, at(10), 2)]
    with pytest.raises(ValueError):
        batches.run_batches([], lambda s: s, str(tmp_path / "none"))
