"""Keyed state of streams: calls that wait for their results, and sessions that fall silent.

Both are state processors with a timer: a call that is open is reported at once and again when it has waited long; a
session ends when nothing has come for a while. What a processor gives is an update: a later row for
the same call (session) replaces the earlier one, so a reader takes the last (``latest_calls``, ``latest_status``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelane.config import DEFAULTS, Params

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CALLS = "who string, call_id string, call_line bigint, start_us bigint, end_us bigint, result_line bigint, state string"
CALL = Row(*[c.split()[0] for c in CALLS.split(", ")])
STATUS = "session string, status string, start_us bigint, last_seen_us bigint, end_us bigint, at_us bigint"
#: How far a call's report has come; a later one replaces an earlier one.
OPEN, WAITING, CLOSED = "1 open", "2 waiting", "3 closed"


def use_state_store(spark: SparkSession) -> None:
    """State processors need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class PairCalls(StatefulProcessor):
    """One call id. The first start counts, the next result closes it, then the id may be used again.

    The state is the start that waits. A batch's rows of an id are put in line order by arrays of two numbers and a flag.
    """

    def __init__(self, patience_ms: int | None = None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "call_line bigint, start_us bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Rows, not frames: a batch may hold very many ids of a few rows each.
        new = sorted(((r["line_no"], r["at_us"], r["role"]) for r in rows), key=lambda r: (r[0] is None, r[0]))
        before = tuple(self.pending.get()) if self.pending.exists() else None
        pending, out = before, []
        for line, at, role in new:
            if role == "call":
                pending = pending or (line, at)
            elif role == "result" and pending is not None:
                out.append(CALL(*key, *pending, at, line, CLOSED))
                pending = None
        if pending != before:
            for timer in list(self.handle.listTimers()) if self.patience_ms is not None else []:
                self.handle.deleteTimer(timer)
            if pending is None:
                self.pending.clear()
            else:
                self.pending.update(pending)
                out.append(CALL(*key, *pending, None, None, OPEN))
                if self.patience_ms is not None:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.pending.exists():
            yield CALL(*key, *self.pending.get(), None, None, WAITING)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    fields = [c.split() for c in columns.split(", ")]
    made = pd.DataFrame(rows, columns=[n for n, _ in fields])
    return made.astype({n: "Int64" if kind == "bigint" else "object" for n, kind in fields})


def paired_calls(records: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """Calls with their results however far apart, as updates (``CALLS``). ``records``: who, call_id, line_no, at_us, role.

    Rows of one id come in line order from batch to batch, in any order inside a batch. ``patience_ms`` is processing
    time; without it no timer is set.
    """
    use_state_store(records.sparkSession)
    narrow = records.select("who", "call_id", F.col("line_no").cast("bigint"), F.col("at_us").cast("bigint"), "role")
    mode = "none" if patience_ms is None else "processingTime"
    return narrow.groupBy("who", "call_id").transformWithState(PairCalls(patience_ms), CALLS, "Update", mode)


def latest_calls(updates: DataFrame) -> DataFrame:
    """One row per call, as ``pair_calls`` gives them: closed ones with their result, the others open."""
    last = F.max_by(F.struct("start_us", "end_us", "result_line", "state"), "state").alias("c")
    return updates.groupBy("who", "call_id", "call_line").agg(last).select("who", "call_id", "call_line", "c.*")


class LiveSessions(StatefulProcessor):
    """One session: live until its recorded end or until nothing has come for ``live_within`` seconds of event time."""

    def __init__(self, live_ms: int):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "start_us bigint, last_us bigint, exit_us bigint, other_us bigint, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, last, exited, other, status = self.seen.get() if self.seen.exists() else (None,) * 5
        for r in rows:
            times = r["at_us"].dropna()
            if len(times):
                start, last = _least(start, times.min()), _most(last, times.max())
            exits, others = r.loc[r["is_exit"], "recorded_us"].dropna(), r.loc[~r["is_exit"], "at_us"].dropna()
            exited = _most(exited, exits.max() if len(exits) else None)
            other = _most(other, others.max() if len(others) else None)
        over = exited is not None and (other is None or exited >= other)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not over and last is not None:
            # The whole second in which the session has been silent for long enough.
            self.handle.registerTimer(last // 1000 + self.live_ms)
        now = "ended" if over else "live"
        self.seen.update((start, last, exited, other, now))
        yield _frame([(*key, now, start, last, exited if over else None, last)], STATUS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, last, exited, other, status = self.seen.get()
        rows = []
        if status == "live":
            self.seen.update((start, last, exited, other, "ended"))
            rows = [(*key, "ended", start, last, last, expiredTimerInfo.getExpiryTimeInMs() * 1000)]
        yield _frame(rows, STATUS)

    def close(self) -> None:
        pass


def _least(a, b):
    return int(b) if a is None else min(int(a), int(b))


def _most(a, b):
    return a if b is None else int(b) if a is None else max(int(a), int(b))


def live_sessions(records: DataFrame, p: Params = DEFAULTS, late: str = "10 seconds") -> DataFrame:
    """Status changes of sessions, as updates (``STATUS``): live with each batch that names them, ended once silent.

    ``records``: session, ``at`` TIMESTAMP (the watermark's time), is_exit, recorded_us.
    """
    use_state_store(records.sparkSession)
    narrow = records.withWatermark("at", late).select(
        F.col("session").cast("string").alias("session"), "at", F.unix_micros("at").alias("at_us"), F.coalesce("is_exit", F.lit(False)).alias("is_exit"), F.col("recorded_us").cast("bigint").alias("recorded_us")
    )
    return narrow.groupBy("session").transformWithStateInPandas(LiveSessions(p.live_within * 1000), STATUS, "Update", "eventTime")


def latest_status(updates: DataFrame) -> DataFrame:
    """One row per session: the last update, by the time it speaks of; an end beats a sign of life of the same time."""
    order = F.struct("at_us", F.col("end_us").isNotNull(), "last_seen_us")
    return updates.groupBy("session").agg(F.max_by(F.struct("status", "start_us", "last_seen_us", "end_us"), order).alias("s")).select("session", "s.*")
