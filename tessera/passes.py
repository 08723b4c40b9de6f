"""Passes over an index: one at a time, whoever runs them, and to be stopped."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from py4j.protocol import Py4JJavaError

from tessera import diagnostics
from tessera.sources.snapshots import Snapshots

T = TypeVar("T")


class Stopped(RuntimeError):
    """The pass was stopped; the index is as it was before."""


class Busy(RuntimeError):
    """Another driver holds the lease."""


class Lease:
    """The right to change an index, as a file beside its pointers that runs out unless it is renewed."""

    def __init__(self, store: Snapshots, seconds: float = 60.0, owner: str | None = None):
        self.store, self.seconds, self.owner = store, seconds, owner or uuid.uuid4().hex
        self.path = f"{store.root}/lease.json"
        self._done = threading.Event()

    def _put(self, overwrite: bool) -> None:
        """Whole or not at all; fails if the file is there and not to be overwritten."""
        self.store.put(self.path, json.dumps({"owner": self.owner, "until": time.time() + self.seconds}), overwrite)

    def holder(self) -> dict | None:
        """Who holds the lease, and until when."""
        try:
            return json.loads(self.store.get(self.path))
        except (Py4JJavaError, ValueError):
            return None

    def take(self) -> None:
        """Raises Busy while another owner's lease runs."""
        for _ in range(3):
            try:
                self._put(False)
                break
            except FileExistsError:
                held = self.holder()
                if held is not None and held["until"] > time.time() and held["owner"] != self.owner:
                    raise Busy(f"{held['owner']} holds the index until {held['until']:.0f}") from None
                # Run out: whoever moves it away first may try again.
                self.store.move_away(self.path)
        else:
            raise Busy("the lease could not be taken")
        self._done.clear()
        threading.Thread(target=self._renew, daemon=True).start()

    def _renew(self) -> None:
        while not self._done.wait(self.seconds / 3):
            held = self.holder()
            if held is None or held["owner"] != self.owner:
                return
            try:
                self._put(True)
            except Exception as e:  # the next turn tries again while the lease still runs
                diagnostics.report(e)

    def free(self) -> None:
        self._done.set()
        held = self.holder()
        if held is not None and held["owner"] == self.owner:
            self.store.move_away(self.path)


class Passes:
    """Runs passes over one index: threads wait for each other, other drivers get Busy, and a running pass can be stopped."""

    def __init__(self, store: Snapshots, seconds: float = 60.0):
        self.store, self.lease = store, Lease(store, seconds)
        self.tag = f"tessera-pass-{uuid.uuid4().hex}"
        self._lock, self._stopped = threading.Lock(), threading.Event()

    @contextmanager
    def _held(self) -> Iterator[None]:
        with self._lock:
            if self._stopped.is_set():
                raise Stopped
            self.lease.take()
            spark = self.store.spark.sparkContext
            spark.addJobTag(self.tag)
            try:
                yield
            finally:
                spark.removeJobTag(self.tag)
                self.lease.free()

    def run(self, work: Callable[..., T], *args, **more) -> T:
        """``work(*args)`` under the lease; a pass that was stopped raises Stopped, and what it wrote is not part of the index."""
        with self._held():
            try:
                return work(*args, **more)
            except Exception as e:
                if self._stopped.is_set():
                    raise Stopped from e
                raise

    def stop(self) -> None:
        """End the running pass, if any, and refuse any future one; its Spark jobs are cancelled."""
        self._stopped.set()
        self.store.spark.sparkContext.cancelJobsWithTag(self.tag)

    def when_idle(self) -> None:
        """Returns once no pass of this process is running."""
        with self._lock:
            return
