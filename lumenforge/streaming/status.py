"""The status machine of items as a stateful stream: each item's status is a value in the state store, changes that the machine
doesn't allow come out as rows, and items that stay in one status for too long are told by an event-time timer."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: From each status, those that may follow; "" is an item that isn't known yet.
MACHINE = {
    "": ["enumerated"],
    "enumerated": ["pending_transcribe", "skipped"],
    "pending_transcribe": ["pending_detect", "error"],
    "pending_detect": ["done", "error"],
    "error": ["pending_transcribe"],
    "done": [],
    "skipped": [],
}
CHANGES = "uid long, event_id long, at timestamp, was string, wanted string, now string, verdict string"


class _Machine(StatefulProcessor):
    """A micro-batch's changes of an item are held as numbers (17 bytes each) to be sorted by time; the intake of a trigger bounds them."""

    def __init__(self, machine: dict[str, list[str]], patience: timedelta | None):
        self.names = sorted({*machine, *(x for v in machine.values() for x in v)})
        self.allowed = {(a, b) for a, v in machine.items() for b in v}
        self.ends = {a for a, v in machine.items() if not v}
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status string, at long, timer long")

    def _timer(self, old: int, at: int) -> int:
        """Moves the item's timer; 0 without one."""
        if not self.patience:
            return 0
        if old:
            self.handle.deleteTimer(old)
        if not self.status or self.status in self.ends:
            return 0
        new = at // 1000 + int(self.patience.total_seconds() * 1000)
        self.handle.registerTimer(new)
        return new

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, ids, wanted = [], [], []
        for part in rows:
            at.append(part["at"].to_numpy("datetime64[us]").astype(np.int64))
            ids.append(part["event_id"].to_numpy(np.int64))
            wanted.append(np.array([self.names.index(x) if x in self.names else -1 for x in part["wanted"]], np.int8))
        at, ids, wanted = map(np.concatenate, (at, ids, wanted))
        self.status, last, timer = self.state.get() if self.state.exists() else ("", -(2**62), 0)
        out = []
        for i in np.lexsort((ids, at)):
            name = self.names[wanted[i]] if wanted[i] >= 0 else None
            verdict = "late" if at[i] < last else "accepted" if (self.status, name) in self.allowed else "refused"
            was = self.status
            if verdict == "accepted":
                self.status, last = name, int(at[i])
            out.append((key[0], int(ids[i]), pd.Timestamp(int(at[i]), unit="us"), was, name, self.status, verdict))
        self.state.update((self.status, last, self._timer(timer, last)))
        yield pd.DataFrame(out, columns=["uid", "event_id", "at", "was", "wanted", "now", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, at, _ = self.state.get()
        self.state.update((status, at, 0))
        yield pd.DataFrame([(key[0], None, pd.Timestamp(at, unit="us"), status, None, status, "stalled")], columns=["uid", "event_id", "at", "was", "wanted", "now", "verdict"]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def with_rocksdb(spark: SparkSession) -> None:
    """State of arbitrary types needs this store; it spills to disk and its changelog lies in the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def changes(events: DataFrame, machine: dict[str, list[str]] = MACHINE, patience: timedelta | None = None, late: str = "1 day") -> DataFrame:
    """Of a stream (uid long, event_id, at, wanted) each wanted change with the status before and after and whether it was accepted,
    refused by the machine, or late (older than the item's last change). With patience, also a row "stalled" for an item that has
    stayed in a status that isn't an end for so long, by the watermark."""
    with_rocksdb(events.sparkSession)
    rows = events.select("uid", "event_id", "at", "wanted").withWatermark("at", late)
    return rows.groupBy("uid").transformWithStateInPandas(_Machine(machine, patience), CHANGES, "Append", "EventTime" if patience else "None")
