"""Keyed state that aggregations can't hold: windows by count, and breakers that close by the clock."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_SNAPSHOT = "at timestamp, seq long, value double"
COUNTED = "symbol string, n long, first timestamp, last timestamp, mean double, low double, high double"


class LastRows(StatefulProcessor):
    """A ring of a key's last rows, by time and number: what comes late takes its place, or none if the ring has moved on."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", _SNAPSHOT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(list(self.ring.get()), columns=["at", "seq", "value"])
        for pdf in rows:
            new = pdf[["at", "seq", "value"]]
            kept = (pd.concat([kept, new]) if len(kept) else new).sort_values(["at", "seq"]).tail(self.size)
        self.ring.put([(t.to_pydatetime(), int(s), float(v)) for t, s, v in zip(kept["at"], kept["seq"], kept["value"])])
        x = kept["value"].astype(float)
        yield pd.DataFrame({"symbol": [key[0]], "n": [len(kept)], "first": [kept["at"].iloc[0]], "last": [kept["at"].iloc[-1]], "mean": [x.mean()], "low": [x.min()], "high": [x.max()]})

    def close(self) -> None:
        pass


def stream_last_rows(rows: DataFrame, size: int = 600) -> DataFrame:
    """symbol, n, first, last, mean, low, high over the last `size` rows (symbol, at, seq, value) of each symbol, after every batch. State: that many rows a symbol."""
    return rows.groupBy("symbol").transformWithStateInPandas(LastRows(size), COUNTED, "Update", "None")


MOVES = "key string, at timestamp, state string"


class Breaker(StatefulProcessor):
    """Opens at so many failures in a row, and closes when the pause after the last of them is over.

    While it is open nothing is attempted, so what happens then counts neither as failure nor as success. It closes at
    the first event after the pause, or by a timer if none comes: either way at the end of the pause, once.
    """

    def __init__(self, failures: int, pause: float):
        self.failures, self.pause = failures, int(pause * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "failures int, last long")  # last in microseconds

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was = failures, last = self.state.get() or (0, 0)
        out, pause = [], self.pause * 1000
        parts = [(pdf["at"].to_numpy("datetime64[us]").astype("int64"), pdf["seq"].to_numpy(), pdf["failed"].to_numpy()) for pdf in rows]
        ats, seqs, fails = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts))
        order = np.lexsort((seqs, ats))
        for at, failed in zip(ats[order].tolist(), fails[order].tolist()):
            if failures >= self.failures:
                if at - last <= pause:
                    continue
                out.append((last + pause, "closed"))
                failures = 0
            failures, last = (failures + 1, at) if failed else (0, last)
            if failures >= self.failures:
                out.append((at, "open"))
        # each call to the store takes longer than the events of a key, so only what has changed goes there
        if (failures, last) != was:
            if was[0] >= self.failures:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            if failures >= self.failures:
                self.handle.registerTimer((last + pause) // 1000 + 1)
            self.state.update((failures, last))
        if out:
            yield self._moves(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, last = self.state.get() or (0, 0)
        self.state.clear()
        if failures >= self.failures:
            yield self._moves(key, [(last + self.pause * 1000, "closed")])

    @staticmethod
    def _moves(key, out: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "at": pd.to_datetime([t for t, _ in out], unit="us", utc=True), "state": [s for _, s in out]})

    def close(self) -> None:
        pass


def stream_breaker(events: DataFrame, failures: int = 3, pause: float = 300.0) -> DataFrame:
    """key, at, state (open, closed): how the breakers of a stream of events (key, at with a watermark, seq, failed) move. State: two numbers a key."""
    return events.groupBy("key").transformWithStateInPandas(Breaker(failures, pause), MOVES, "Append", "EventTime", eventTimeColumnName="at")


FOLDED = "symbol string, ewma double"


class Folded(StatefulProcessor):
    """A mean that forgets: each value weighs 1 - weight against the old mean; the first is taken as it is."""

    def __init__(self, weight: float):
        self.weight = weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mean", "mean double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mean = self.state.get()[0] if self.state.exists() else None
        for x in pd.concat(list(rows)).sort_values(["at", "value"])["value"].tolist():
            mean = x if mean is None else self.weight * mean + (1 - self.weight) * x
        self.state.update((mean,))
        yield pd.DataFrame({"symbol": [key[0]], "ewma": [mean]})

    def close(self) -> None:
        pass


def stream_ewma(rows: DataFrame, weight: float = 0.9) -> DataFrame:
    """symbol, ewma after every batch of rows (symbol, at, value) that come in order of their batches. State: one number a symbol."""
    return rows.groupBy("symbol").transformWithStateInPandas(Folded(weight), FOLDED, "Update", "None")
