"""Streaming extensions: a drop folder of archives, and lyric offsets kept as state for each track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def archive_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """(book_id, content) of archives as they are dropped into a folder."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.epub").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.selectExpr("path as book_id", "content")


def offset_stream(marks: DataFrame, track: str = "track") -> DataFrame:
    """Marks (track, seq, time_ms, type, value) in order of seq within each batch to sentences with at_ms.

    The state of a track is the sum of the durations before; batches of a track must arrive in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        zero = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq")
        moved = rows["time_ms"].where(rows["type"] == "preceding_realtime", 0)
        before = zero + moved.cumsum() - moved
        state.update((int(zero + moved.sum()),))
        out = rows.assign(at_ms=rows["time_ms"] + before)
        out = out[out["type"] == "sentence"]
        yield pd.DataFrame({track: key[0], "seq": out["seq"], "at_ms": out["at_ms"].astype("int64"), "value": out["value"]})

    kind = marks.schema[track].dataType.simpleString()
    return marks.groupBy(track).applyInPandasWithState(step, f"{track} {kind}, seq long, at_ms long, value string", "zero long", "append", GroupStateTimeout.NoTimeout)


class Reorder(StatefulProcessor):
    """A track's marks in order of seq, whatever the order of their arrival: what comes early waits in a buffer.

    State: the next seq, the durations so far, and the marks that wait. If a mark is missing for `patience` milliseconds after others
    of the track came, the gap is passed over; what comes too late is left out.
    """

    def __init__(self, track: str, patience: int):
        self.track, self.patience = track, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, zero long")
        self.waiting = handle.getMapState("waiting", "seq long", "time_ms long, type string, value string")

    def _ready(self, key: tuple, pass_over: bool) -> pd.DataFrame:
        step, zero = self.at.get() if self.at.exists() else (0, 0)
        if pass_over and (early := min((k[0] for k in self.waiting.keys()), default=None)) is not None:
            step = max(step, early)
        out = []
        while self.waiting.containsKey((step,)):
            time_ms, kind, value = self.waiting.getValue((step,))
            self.waiting.removeKey((step,))
            if kind == "preceding_realtime":
                zero += time_ms
            elif kind == "sentence":
                out.append((key[0], step, time_ms + zero, value))
            step += 1
        self.at.update((int(step), int(zero)))
        return pd.DataFrame(out, columns=[self.track, "seq", "at_ms", "value"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        step = self.at.get()[0] if self.at.exists() else 0
        for frame in rows:
            for seq, time_ms, kind, value in zip(frame["seq"], frame["time_ms"], frame["type"], frame["value"]):
                if seq >= step:
                    self.waiting.updateValue((int(seq),), (int(time_ms), kind, None if pd.isna(value) else value))
        yield self._ready(key, False)
        self._watch(timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._ready(key, True)
        self._watch(timerValues)

    def _watch(self, timer: TimerValues) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if self.waiting.exists():
            self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + self.patience)

    def close(self) -> None:
        pass


def reordered_offset_stream(marks: DataFrame, track: str = "track", patience: int = 60_000) -> DataFrame:
    """offset_stream for marks (track, seq from 0, time_ms, type, value) that arrive in any order, in any batches.

    Needs the state store on RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    kind = marks.schema[track].dataType.simpleString()
    return marks.groupBy(track).transformWithStateInPandas(Reorder(track, patience), f"{track} {kind}, seq long, at_ms long, value string", "append", "ProcessingTime")
