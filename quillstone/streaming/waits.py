"""Waits of runs over streams: timers that fire without a new row, and two streams joined in time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from quillstone.operators.runs import end_wait, wait_start, wait_step

#: The store that operators with timers need; a query takes the setting along when it starts.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_timers(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state where timers can be."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def _millis(at: pd.Timestamp) -> int:
    """Whole milliseconds that are not before a time."""
    return -(-at.value // 1_000_000)


class _Waits(StatefulProcessor):
    """A run's state is one value; it is dropped when nothing is left of it."""

    def __init__(self, keep: pd.Timedelta | None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("body", BinaryType())]))

    def _state(self) -> dict:
        return pickle.loads(self.held.get()[0]) if self.held.exists() else wait_start() | {"since": None}

    def _store(self, state: dict) -> None:
        if state["open"] or state["there"] or state["events"]:
            self.held.update((pickle.dumps(state),))
            if state["open"] and state["open"][2] is not None:
                self.handle.registerTimer(_millis(state["open"][2]))
            if self.keep is not None:
                self.handle.registerTimer(_millis(state["since"] + self.keep))
        else:
            self.held.clear()

    def _row(self, key: tuple, seq: object, at: object, outcome: str, name: object, consumed: object = None) -> dict:
        return {"run_id": key[0], "seq": seq, "at": at, "outcome": outcome, "name": name, "consumed": consumed}

    def _ended(self, key: tuple, state: dict, at: object) -> list[dict]:
        """What is said of an open wait whose time has come."""
        ended = end_wait(state, at)
        return [] if ended is None else [self._row(key, None, ended[2], "timer" if ended[0] == "timer" else "timed_out", ended[1])]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, found = self._state(), []
        every = pd.concat(list(rows)).sort_values(["at", "seq"])
        for row in every.astype(object).where(every.notna(), None).to_dict("records"):
            found += self._ended(key, state, row["at"])
            state, answer = wait_step(state, row)
            state["since"] = row["at"]
            found.append(self._row(key, row["seq"], row["at"], answer["outcome"], row["name"], answer.get("consumed")))
        self._store(state)
        yield pd.DataFrame(found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._state()
        now = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        found = self._ended(key, state, now)
        if self.keep is not None and state["since"] is not None and _millis(state["since"] + self.keep) <= expiredTimerInfo.getExpiryTimeInMs():
            state["there"], state["events"] = {}, {}
        self._store(state)
        yield pd.DataFrame(found, columns=["run_id", "seq", "at", "outcome", "name", "consumed"])

    def close(self) -> None:
        pass


def timed_waits(operations: DataFrame, late: str = "2 hours", keep: str | None = None) -> DataFrame:
    """``runs.waited`` over a stream (run_id, seq, at, operation, kind, name, fire_at, event_id), with a row for every wait that ends by its time.

    Gives run_id, seq, at, outcome, name and consumed; rows of ended waits have no
    seq, and come once the watermark, ``late`` behind the newest row, has passed
    their time, whether or not the run has a new row. A run of which no open wait,
    outcome or event is left keeps no state; with ``keep`` outcomes and events go
    when a run has had no row for so long. Start the query ``with_timers``.
    """
    seq, event = (operations.schema[c].dataType.simpleString() for c in ("seq", "event_id"))
    run = operations.schema["run_id"].dataType.simpleString()
    processor = _Waits(None if keep is None else pd.Timedelta(keep))
    return operations.withWatermark("at", late).groupBy("run_id").transformWithStateInPandas(processor, f"run_id {run}, seq {seq}, at timestamp, outcome string, name string, consumed {event}", "Append", "EventTime")


def resumed_in_time(waits: DataFrame, events: DataFrame, longest: str = "8 hours", late: str = "2 hours") -> DataFrame:
    """wait_id, run_id, name, since, event_id and outcome of waits (wait_id, run_id, name, since) and events (run_id, name, event_id, at), of two tables or two streams.

    A wait is resumed by the first event of its run and name that comes at or
    after it and within ``longest``, else it is timed out. Over streams both sides
    are dropped from the state once the watermarks say that no partner can come.
    """
    asked = waits.withWatermark("since", late)
    raised = events.select(F.col("run_id").alias("run"), F.col("name").alias("called"), "event_id", "at").withWatermark("at", late)
    both = asked.join(raised, F.expr(f"run_id = run AND name = called AND at >= since AND at <= since + INTERVAL {longest}"), "left_outer")
    # one event time goes on: that of the wait
    matched = both.select("wait_id", "run_id", "name", "since", F.unix_micros("since").alias("since_at"), F.when(F.col("event_id").isNotNull(), F.struct(F.unix_micros("at").alias("at"), "event_id")).alias("event"))
    found = matched.groupBy("wait_id", "run_id", "name", "since_at", F.window("since", "1 hour")).agg(F.min("event").alias("first"))
    return found.select("wait_id", "run_id", "name", F.timestamp_micros("since_at").alias("since"), "first.event_id", F.when(F.col("first").isNotNull(), "resumed").otherwise("timed_out").alias("outcome"))
