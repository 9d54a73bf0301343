"""Heartbeats as a stateful stream: last beat per process, overdue by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.monitor import GRACE, REGISTRY
from .jobs import EMPTY_BATCHES, start, write_batch

BEAT = "process_name string, beat_at timestamp, status string, error string, event_id bigint"
STATE = "beat_us bigint, event_id bigint, status string, error string"
OUT = "process_name string, last_beat_at timestamp, last_status string, last_error string, overdue boolean"


def last_in_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Newest beat of each process in a task, so that a busy process does not flood its state task."""
    kept = None
    for pdf in batches:
        rows = pdf if kept is None else pd.concat([kept, pdf])
        kept = rows.sort_values(["beat_at", "event_id"]).groupby("process_name", as_index=False).tail(1)
    if kept is not None:
        yield kept


class Heartbeats(StatefulProcessor):
    """Keeps the newest beat; a processing-time timer at its deadline reports silence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        name = key[0]
        best = self.beat.get() if self.beat.exists() else None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                found = (int(pd.Timestamp(r.beat_at).value // 1000), int(r.event_id), r.status, r.error)
                if best is None or found[:2] > tuple(best[:2]):
                    best = found
        self.beat.update(tuple(best))
        deadline = int(best[0] // 1000 + REGISTRY[name] * GRACE * 60_000)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        late = timerValues.getCurrentProcessingTimeInMs() > deadline
        if not late:
            self.handle.registerTimer(deadline)
        yield self._row(name, best, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.beat.exists():
            yield self._row(key[0], self.beat.get(), True)

    @staticmethod
    def _row(name: str, beat, overdue: bool) -> pd.DataFrame:
        return pd.DataFrame({
            "process_name": [name], "last_beat_at": [pd.Timestamp(int(beat[0]), unit="us")], "last_status": [beat[2]],
            "last_error": [beat[3]], "overdue": [bool(overdue)],
        })

    def close(self) -> None:
        pass


def watch(beats: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes the state of a process whenever it beats or falls silent; unknown names are left out."""
    known = beats.filter(beats["process_name"].isin(list(REGISTRY))).selectExpr(
        "process_name", "CAST(beat_at AS TIMESTAMP) AS beat_at", "status", "error", "event_id")
    states = known.mapInPandas(last_in_batch, BEAT).groupBy("process_name").transformWithStateInPandas(
        statefulProcessor=Heartbeats(), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime")
    # Timers keep asking for another batch; a run that is to end takes only batches with data.
    conf = beats.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    conf.set(EMPTY_BATCHES, before if every else "false")
    try:
        return start(states, _store(out), checkpoint, every, mode="update")
    finally:
        conf.set(EMPTY_BATCHES, before)


def _store(out: str):
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, out, "beats", batch_id)

    return handle
