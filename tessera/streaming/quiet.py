"""Gathering file events until a source has been quiet, as state with a timer in a stream.

Renames and deletions pass at once, as the index follows them without reading a file.  Paths to be read wait in a map of
the source, a path once however often it is written, until no event named one of that source for ``gap``; then they come
as one burst.  The map and the timer are part of the stream's checkpoint, so neither is lost in a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.text import IMAGE_EXTENSIONS

EVENTS = "ts timestamp, op string, path string, old_path string, source string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What comes first of events with equal times.
ORDER = {"created": 0, "changed": 1, "renamed": 2, "deleted": 3}


def extension(path: str) -> str:
    name = path.replace("\\", "/").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name.lstrip(".") else ""


class Quiet(StatefulProcessor):
    """State of one source: pending paths, and when they are due."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "ts timestamp, op string")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waits = False
        for e in sorted(rows, key=lambda e: (e.ts, ORDER.get(e.op, 9), e.path)):
            if e.op in ("created", "changed"):
                if extension(e.path) in IMAGE_EXTENSIONS:
                    self.pending.updateValue((e.path,), (e.ts, e.op))
                    waits = True
                continue
            left = e.old_path if e.op == "renamed" else e.path
            if left and self.pending.containsKey((left,)):
                self.pending.removeKey((left,))
                # Written and renamed before it was read: the new name is to be read.
                if e.op == "renamed" and extension(e.path) in IMAGE_EXTENSIONS:
                    self.pending.updateValue((e.path,), (e.ts, "created"))
                    waits = True
            yield Row(ts=e.ts, op=e.op, path=e.path, old_path=e.old_path, source=e.source)
        if waits:
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.gap
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows = [Row(ts=v[0], op=v[1], path=p[0], old_path=None, source=key[0]) for p, v in self.pending.iterator()]
        self.pending.clear()
        self.due.clear()
        yield from sorted(rows, key=lambda e: (e.ts, e.path))

    def close(self) -> None:
        pass


def quiet(events: DataFrame, gap: float = 2.0) -> DataFrame:
    """A stream of events (ts, op, path, old_path, source) in which paths to be read come once their source was quiet for ``gap`` seconds.

    Sources are apart, so a busy one holds up no other.  Needs the state store that keeps timers
    (:func:`tessera.session.session` sets it).
    """
    kept = events.select("ts", "op", "path", "old_path", "source").fillna("", ["source"])
    return kept.groupBy("source").transformWithState(Quiet(int(gap * 1000)), EVENTS, "Append", "ProcessingTime")
