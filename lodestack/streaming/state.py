"""State that outlives batches: processors for transformWithState, kept in RocksDB, whose state ends by timers.

Timers are of processing time and look at the watermark when they fire: a timer of event time would make Spark drop rows
behind the watermark, and late rows count here. Watermarks only decide how long state is kept. Timers fire with batches
that have rows; batches without are off, as Spark would run them without end beside timers of this kind.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on in this session keep their state in RocksDB and run no batches without rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def millis(times: pd.Series) -> pd.Series:
    """Timestamps as microseconds."""
    return times.astype("datetime64[us]").astype("int64")


class Sweeping(StatefulProcessor):
    """A processor whose keys have one timer at a time; when it fires, :meth:`sweep` says whether the key is done with."""

    def __init__(self, every_ms: int):
        self.every_ms = max(1, every_ms)  # a timer of the same instant would go with the one that fired

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def watch(self, timer_values) -> None:
        """See to it that the key has a timer."""
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.every_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.sweep(timerValues.getCurrentWatermarkInMs()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every_ms)
        return iter([])

    def sweep(self, watermark_ms: int) -> bool:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Quota(Sweeping):
    """Whether each use of a user is within the daily quota; a user's state is the starts and uses of recent windows.

    A use falls into the last window that began at or before it, if that is not over, else it opens one. So a use that
    comes late is charged to the window of its own time, whatever has come since; where it falls before a window that
    has begun, its own ends there.
    """

    def __init__(self, span_hours: int, keep_hours: int, every_ms: int):
        super().__init__(every_ms)
        self.span, self.keep = span_hours * HOUR * 1000, keep_hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.windows = handle.getValueState("windows", "starts array<long>, used array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts, used = map(list, self.windows.get()) if self.windows.exists() else ([], [])
        counts = dict(zip(starts, used, strict=True))
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        allowed = []
        for at, limit in zip(millis(events["ts"]).tolist(), events["daily_limit"].tolist(), strict=True):
            i = bisect_right(starts, at) - 1
            start = starts[i] if i >= 0 and at - starts[i] < self.span else at
            if start not in counts:
                insort(starts, start)
                counts[start] = 0
            fine = limit is None or pd.isna(limit) or counts[start] < limit
            counts[start] += int(fine)
            allowed.append(bool(fine))
        self._put(starts, counts, timerValues.getCurrentWatermarkInMs())
        self.watch(timerValues)
        yield pd.DataFrame({"user_id": key[0], "event_id": events["event_id"].to_numpy(), "allowed": allowed})

    def _put(self, starts: list[int], counts: dict[int, int], watermark_ms: int) -> bool:
        """Keep the windows that ended at most `keep` before the watermark; True if none is left."""
        starts = [s for s in starts if (s + self.span) // 1000 + self.keep > watermark_ms]
        if starts:
            self.windows.update((starts, [counts[s] for s in starts]))
        else:
            self.windows.clear()
        return not starts

    def sweep(self, watermark_ms: int) -> bool:
        starts, used = map(list, self.windows.get()) if self.windows.exists() else ([], [])
        return self._put(starts, dict(zip(starts, used, strict=True)), watermark_ms)


class Changes(Sweeping):
    """Rows of a key whose status differs from the last one shown, up to and with the first terminal status.

    State is the last status and its place in time. After the end it is a mark that the key has ended, which goes when
    the watermark is `keep` past the end; a key that comes again after that begins anew. A row at or before the
    last one shown is not shown.
    """

    def __init__(self, key: str, status: str, terminal: tuple[str, ...], keep_hours: int, every_ms: int):
        super().__init__(every_ms)
        self.key, self.status, self.terminal, self.keep = key, status, frozenset(terminal), keep_hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "status string, at long, id long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, at, number, ended = self.last.get() if self.last.exists() else (None, None, None, False)
        shown = []
        if not ended:
            events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
            for when, event, new in zip(millis(events["ts"]).tolist(), events["event_id"].tolist(), events[self.status].tolist(), strict=True):
                if at is not None and (when, event) <= (at, number):
                    continue
                new = None if pd.isna(new) else new
                if at is None or new != status:
                    shown.append((key[0], event, new))
                status, at, number, ended = new, when, event, new in self.terminal
                if ended:
                    break
            if at is not None:
                self.last.update((None if ended else status, at, number, ended))
        self.watch(timerValues)
        if shown:
            yield pd.DataFrame(shown, columns=[self.key, "event_id", self.status])

    def sweep(self, watermark_ms: int) -> bool:
        """Keys that have ended go; one that has not stays, however long it is silent."""
        _, at, _, ended = self.last.get() if self.last.exists() else (None, 0, None, True)
        if ended and at // 1000 + self.keep <= watermark_ms:
            self.last.clear()
            return True
        return False
