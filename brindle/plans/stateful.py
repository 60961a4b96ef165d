"""Queries that run streams in several batches with restarts, and the batch SQL that they must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.plans import windows  # noqa: F401  (its SQL is used below)
from brindle.plans.registry import ORACLES, register
from brindle.sources.tables import shared_folder
from brindle.sources.views import Market
from brindle.streaming import bars as sb
from brindle.streaming import batches, keyed

#: Events come in the order of their days, eight days a batch; one in 50 comes a batch late, one in 50 two batches.
_ARRIVAL = "least(3, (dayofmonth(ts) - 1) div 8 + case event_id % 50 when 0 then 1 when 1 then 2 else 0 end)"
_E = "e AS (SELECT *, least(3, (dayofmonth(ts) - 1) // 8 + CASE event_id % 50 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) AS arrival FROM events)"


def _folder(m: Market) -> str:
    return f"{shared_folder(m.spark)}/batches-{uuid.uuid4().hex}"


def _arrivals(m: Market, late: bool) -> list[DataFrame]:
    """The events by when they come: late ones among them, or all in the order of their days."""
    events = m.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.expr(_ARRIVAL if late else "least(3, (dayofmonth(ts) - 1) div 8)")
    return [events.filter(arrival == k) for k in range(4)]


def _late(m: Market) -> tuple[DataFrame, DataFrame]:
    """Bars of what came in time, and the rows that came too late for theirs."""

    def plan(events: DataFrame) -> DataFrame:
        ticks = events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("qty"))
        return sb.stream_bars(sb.with_watermark(ticks, "1 hour"))

    rows, runs = batches.run_batches(_arrivals(m, True), plan, _folder(m))
    return batches.latest(rows, ["symbol", "ts"]), batches.late_rows(runs, "4 hours")


_SPLIT = f"""WITH {_E}, w AS (SELECT k, (SELECT max(ts) FROM e WHERE arrival < k) - INTERVAL 1 HOUR AS held FROM range(4) t(k)),
s AS (SELECT e.*, time_bucket(INTERVAL '4 hours', ts) AS bin, coalesce(time_bucket(INTERVAL '4 hours', ts) + INTERVAL 4 HOUR <= held, false) AS late FROM e JOIN w ON w.k = e.arrival)"""
register(
    "stream_bars_in_time",
    f"{_SPLIT} SELECT event_type AS symbol, bin AS ts, round(arg_min(value, ts), 6) + 0.0::DOUBLE AS open, round(max(value), 6) + 0.0::DOUBLE AS high, round(min(value), 6) + 0.0::DOUBLE AS low, round(arg_max(value, ts), 6) + 0.0::DOUBLE AS close, CAST(count(*) AS DOUBLE) AS volume FROM s WHERE NOT late GROUP BY 1, 2",
)(lambda m: _late(m)[0].select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume"))
register("stream_late_rows", f"{_SPLIT} SELECT event_id, event_type, bin AS ts FROM s WHERE late")(
    lambda m: _late(m)[1].select("event_id", "event_type", F.window("ts", "4 hours")["start"].cast("timestamp_ntz").alias("ts"))
)


def _sessions(m: Market) -> DataFrame:
    plan = lambda events: sb.stream_sessions(sb.with_watermark(events.select("user_id", "ts"), "1 hour"))
    rows, _ = batches.run_batches(_arrivals(m, False), plan, _folder(m), "append")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


register(
    "stream_closed_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)(_sessions)


def _last_rows(m: Market) -> DataFrame:
    plan = lambda events: keyed.stream_last_rows(events.select(F.col("event_type").alias("symbol"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), "value"), 600)
    rows, _ = batches.run_batches(_arrivals(m, True), plan, _folder(m))
    out = batches.latest(rows, ["symbol"])
    return out.select("symbol", "n", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


register(
    "stream_last_600",
    """SELECT event_type AS symbol, count(*) AS n, min(ts) AS first, max(ts) AS last, round(avg(value), 6) + 0.0::DOUBLE AS mean, round(min(value), 6) + 0.0::DOUBLE AS low, round(max(value), 6) + 0.0::DOUBLE AS high
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 600 GROUP BY 1""",
)(_last_rows)


def _breaker(m: Market) -> DataFrame:
    """A user's errors are failures; three in a row open the user's breaker for a day."""

    def plan(events: DataFrame) -> DataFrame:
        rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
        return keyed.stream_breaker(rows.withWatermark("at", "1 hour"), 3, 86_400.0)

    rows, _ = batches.run_batches(_arrivals(m, False), plan, _folder(m), "append")
    return rows.select("key", F.col("at").cast("timestamp_ntz").alias("at"), "state")


register(
    "stream_breaker",
    """WITH RECURSIVE n AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r(key, i, failures, prior, move, moved) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), 0, CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP) FROM n
  UNION ALL
  SELECT r.key, n.i, CASE WHEN r.failures >= 3 AND n.ts - r.prior <= INTERVAL 1 DAY THEN r.failures WHEN NOT n.failed THEN 0 WHEN r.failures >= 3 THEN 1 ELSE r.failures + 1 END,
         CASE WHEN n.failed AND NOT (r.failures >= 3 AND n.ts - r.prior <= INTERVAL 1 DAY) THEN n.ts ELSE r.prior END,
         CASE WHEN r.failures >= 3 AND n.ts - r.prior > INTERVAL 1 DAY THEN 'closed' WHEN r.failures = 2 AND n.failed THEN 'open' END,
         CASE WHEN r.failures >= 3 AND n.ts - r.prior > INTERVAL 1 DAY THEN r.prior + INTERVAL 1 DAY ELSE n.ts END
  FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1),
z AS (SELECT key, prior + INTERVAL 1 DAY AS "at", 'closed' AS state FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS k FROM r) WHERE k = 1 AND failures >= 3)
SELECT key, moved AS "at", move AS state FROM r WHERE move IS NOT NULL UNION ALL SELECT key, "at", state FROM z WHERE "at" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)(_breaker)


def _ewma(m: Market) -> DataFrame:
    plan = lambda events: keyed.stream_ewma(events.select(F.col("event_type").alias("symbol"), F.col("ts").alias("at"), "value"))
    rows, _ = batches.run_batches(_arrivals(m, False), plan, _folder(m))
    return batches.latest(rows, ["symbol"]).select("symbol", F.round("ewma", 6).alias("ewma"))


register("stream_ewma", ORACLES["ewma_latency"])(_ewma)
