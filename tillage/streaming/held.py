"""Alerts that hold for a time: a share of requests above a bound in windows that follow each other without a gap.

An alert is pending from its first high window on, fires when it has been high for the time asked for, and is resolved at
the end of its last high window: when the next window is low, or is missing because nothing came.  ``held_alerts`` finds
this in a table of windows, ``alert_stream`` as windows close.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

TRANSITION = "name string, state string, at long"
#: Start and end (seconds) of the run of high windows so far, and whether it has fired.
STATE = "since long, until long, firing boolean"


def window_shares(events: DataFrame, name: str, counted: Column, ts: str = "ts", width: str = "5 minutes") -> DataFrame:
    """name, start, at (the window's last instant), share of each window that has requests.  A stream needs a watermark."""
    found = events.groupBy(F.window(ts, width).alias("w"), F.col(name).alias("name")).agg(F.avg(F.when(counted, 1.0).otherwise(0.0)).alias("share"))
    return found.select("name", F.col("w.start").alias("start"), F.window_time("w").alias("at"), "share")


def _seconds(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000


def held_alerts(shares: DataFrame, most: float, hold: int, width: int) -> DataFrame:
    """name, pending_at, fired_at, resolved_at (seconds) of each alert that fired.  ``hold``, ``width``: seconds; there is a row
    for each window and name, however many requests, so a name's windows are few."""
    high = shares.where(F.col("share") > most).select("name", _seconds("start").cast("long").alias("s"))
    run = F.col("s") - width * F.row_number().over(Window.partitionBy("name").orderBy("s"))
    runs = high.withColumn("run", run).groupBy("name", "run").agg(F.min("s").alias("pending_at"), (F.max("s") + width).alias("resolved_at"))
    return runs.where(F.col("resolved_at") - F.col("pending_at") >= hold).select("name", "pending_at", (F.col("pending_at") + hold).alias("fired_at"), "resolved_at")


def transitions(state: tuple | None, windows: list[tuple[int, bool]], hold: int, width: int) -> tuple[tuple | None, list[tuple[str, int]]]:
    """The state behind some windows (start, whether high; in order) of a name, and (pending, firing or resolved, when)."""
    out: list[tuple[str, int]] = []
    for start, high in windows:
        if state and (start > state[1] or not high):  # a gap, or a low window
            out += [("resolved", state[1])]
            state = None
        if high:
            since, _, firing = state or (start, start, False)
            if state is None:
                out.append(("pending", start))
            if not firing and start + width - since >= hold:
                out.append(("firing", since + hold))
                firing = True
            state = (since, start + width, firing)
    return state, out


class Alerts(StatefulProcessor):
    """Of each name the run of high windows, and a timer behind the window that would go on with it."""

    def __init__(self, hold: int, width: int) -> None:
        self.hold, self.width = hold, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        windows = sorted((int(s), bool(h)) for part in rows for s, h in zip(part["s"], part["high"]))
        before = tuple(self.run.get()) if self.run.exists() else None
        after, found = transitions(before, windows, self.hold, self.width)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if after:
            self.run.update(after)
            self.handle.registerTimer((after[1] + self.width) * 1000)  # the next window is closed by then, if it ever was
        elif before:
            self.run.clear()
        yield self.rows(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [("resolved", int(self.run.get()[1]))] if self.run.exists() else []
        self.run.clear()
        yield self.rows(key, found)

    def rows(self, key: tuple, found: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *t) for t in found], columns=["name", "state", "at"])

    def close(self) -> None:
        pass


def alert_stream(shares: DataFrame, most: float, hold: int, width: int) -> DataFrame:
    """name, state, at of each transition, as the windows of a stream close; a timer on event time resolves an alert that
    nothing follows.  The session's state store has to be RocksDB, as transformWithState asks."""
    rows = shares.select("name", "at", _seconds("start").cast("long").alias("s"), (F.col("share") > most).alias("high"))
    return rows.groupBy("name").transformWithStateInPandas(Alerts(hold, width), TRANSITION, "Append", "EventTime")
