"""Reflexes as a stream: the fold of ``state.reflexes`` with its state between batches.

Events wait in a key's list until the watermark has passed them, so that late ones within it
are folded in their place; an event-time timer then folds what is due, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the session's state store has to be for list state and timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, threat double, occurrences int, clean_runs int, folded long"


class ReflexFold(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, threat double")
        self.reflex = handle.getValueState("reflex", "threat double, occurrences int, clean_runs int, folded long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            at = pdf["at"].astype("datetime64[us]").astype("int64")
            new += [(int(a), int(i), None if pd.isna(t) else float(t)) for a, i, t in zip(at, pdf["id"], pdf["threat"])]
        if new:
            self.waiting.appendList(new)
            self._wake(min(a for a, _, _ in new))
        return iter([])

    def _wake(self, at: int) -> None:
        """A timer for when the watermark has passed this moment (microseconds)."""
        self.handle.registerTimer(-(-at // 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda e: e[:2]) if self.waiting.exists() else []
        due, left = [e for e in waiting if e[0] < passed], [tuple(e) for e in waiting if e[0] >= passed]
        if not due:
            if left:
                self._wake(left[0][0])
            return
        threat, hits, clean, folded = self.reflex.get() if self.reflex.exists() else (0.0, 0, 0, 0)
        for _, _, new in due:
            if new is None:
                clean += 1
            else:
                threat = float(new) if hits == 0 else min(1.0, max(threat, new) + 0.05)
                hits, clean = hits + 1, 0
        folded += len(due)
        self.reflex.update((threat, hits, clean, folded))
        if left:
            self.waiting.put(left)
            self._wake(left[0][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame({"key": [key[0]], "threat": [threat], "occurrences": [hits], "clean_runs": [clean], "folded": [folded]})

    def close(self) -> None:
        pass


def reflex_stream(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """(key, threat, occurrences, clean_runs, folded) of a stream (key string, at, id, threat; null
    threat: a clean run): a key's reflex whenever some of its events have been folded, the last
    row of most ``folded`` being its newest. Events later than ``late`` are dropped by the watermark."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.select("key", "at", "id", "threat").withWatermark("at", late).groupBy("key")
    return rows.transformWithStateInPandas(ReflexFold(), OUT, "Update", "EventTime")
