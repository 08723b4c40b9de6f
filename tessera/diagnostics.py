"""Errors that the engine recovers from: told to a hook, from the driver and from tasks."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark import AccumulatorParam
from pyspark.sql import SparkSession

#: Different messages that are kept; of others only their number is.
MOST = 100
#: Called with a message and how often it came; None: nobody listens.
hook: Callable[[str, int], None] | None = None


def report(error: BaseException | str, times: int = 1) -> None:
    """Tell the hook; a hook that fails itself is passed over."""
    message = error if isinstance(error, str) else f"{type(error).__name__}: {error}"
    if hook is not None:
        try:
            hook(message, times)
        except Exception:
            return


class _Counts(AccumulatorParam):
    """{message: times}, bounded whatever tasks report."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for message, times in b.items():
            key = message if message in a or len(a) < MOST else "..."
            a[key] = a.get(key, 0) + times
        return a


class Errors:
    """A channel from tasks to the driver: tasks add, :meth:`drain` tells the hook what came since the last call.

    Tasks that run again count again, as is the way of accumulators; it is for logs, not for reports.
    """

    def __init__(self, spark: SparkSession):
        self._held = spark.sparkContext.accumulator({}, _Counts())
        self._told: dict[str, int] = {}
        self._lock = threading.Lock()

    def __getstate__(self) -> dict:
        return {"_held": self._held}

    def add(self, error: BaseException | str) -> None:
        self._held.add({error if isinstance(error, str) else f"{type(error).__name__}: {error}": 1})

    def drain(self) -> dict[str, int]:
        with self._lock:
            now = dict(self._held.value)
            new = {m: n - self._told.get(m, 0) for m, n in now.items() if n > self._told.get(m, 0)}
            self._told = now
        for message, times in new.items():
            report(message, times)
        return new
