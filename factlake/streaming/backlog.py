"""The backlog as keyed state: one entry per source of an organisation, until it is answered or given up.

A source is asked when it comes. If no answer is back when its timer runs out it
is asked again, each time after twice the wait, and after ``tries`` it goes to
the dead letters. Answers come back to the state as rows of a second stream, so
nothing that was ever seen is read again: a batch costs what it asks. An entry
that is through keeps a mark without its text, which tells copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRIES = 5
BACKOFF_SECONDS = 120.0
ANSWERED, DEFERRED, TICK = "answered", "deferred", "tick"
ASK, DEAD = "ask", "dead"
WAITING, THROUGH, GIVEN_UP = "waiting", "through", "given up"
STATE = "raw_content string, tries int, status string"
OUT = "org_id string, id bigint, raw_content string, tries int, what string"
OUTCOMES = T.StructType([T.StructField("org_id", T.StringType()), T.StructField("id", T.LongType()), T.StructField("outcome", T.StringType())])


class Waiting(StatefulProcessor):
    def __init__(self, tries: int, backoff: float):
        self.tries, self.backoff = tries, backoff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", STATE)

    def _wait(self, timerValues, tries: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # A timer never runs out in the batch that set it.
        self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + max(1, self.backoff * 1000 * 2 ** (tries - 1))))

    @staticmethod
    def _row(key, text: str | None, tries: int, what: str) -> pd.DataFrame:
        return pd.DataFrame({"org_id": [key[0]], "id": [key[1]], "raw_content": [text], "tries": [tries], "what": [what]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        texts, outcomes = [], []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                (texts if r.outcome is None or pd.isna(r.outcome) else outcomes).append(r.raw_content if r.outcome is None or pd.isna(r.outcome) else r.outcome)
        if ANSWERED in outcomes:
            # Also one that comes after the source was given up.
            self.entry.update((None, entry[1] if entry else 0, THROUGH))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            return
        if DEFERRED in outcomes and entry and entry[2] == WAITING:
            # It wasn't asked after all: that try doesn't count.
            self.entry.update((entry[0], entry[1] - 1, WAITING))
            self._wait(timerValues, max(1, entry[1] - 1))
        if entry is None and texts:
            # Of copies in one batch the least text, so that reruns agree.
            text = min(texts, key=lambda t: (t is None, t or ""))
            self.entry.update((text, 1, WAITING))
            self._wait(timerValues, 1)
            yield self._row(key, text, 1, ASK)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text, tries, status = self.entry.get() if self.entry.exists() else (None, 0, THROUGH)
        if status != WAITING:
            return
        if tries >= self.tries:
            self.entry.update((None, tries, GIVEN_UP))
            yield self._row(key, text, tries, DEAD)
            return
        self.entry.update((text, tries + 1, WAITING))
        self._wait(timerValues, tries + 1)
        yield self._row(key, text, tries + 1, ASK)

    def close(self) -> None:
        pass


def waiting(sources: DataFrame, outcomes: DataFrame, tries: int = TRIES, backoff: float = BACKOFF_SECONDS) -> DataFrame:
    """What to ask now, and what is given up (``OUT``), from new sources and the outcomes of earlier batches."""
    rows = sources.select("org_id", "id", "raw_content", F.lit(None).cast("string").alias("outcome")).unionByName(
        outcomes.filter(F.col("outcome") != TICK).select("org_id", "id", F.lit(None).cast("string").alias("raw_content"), "outcome"))
    return rows.groupBy("org_id", "id").transformWithStateInPandas(
        statefulProcessor=Waiting(tries, backoff), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime")
