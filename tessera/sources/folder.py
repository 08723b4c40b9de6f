"""A Python data source that lists folders as the index needs it.

Differs from Spark's file listing: underscore names count, hidden ones don't, extensions match in any case.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import stat
from collections import deque
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tessera.functions.text import IMAGE_EXTENSIONS

SKIPPED = frozenset({".obsidian", ".trash", ".git", "node_modules"})
SCHEMA = "path string, source string, source_ord int, size long, mtime timestamp, attributes int"


class Folder(InputPartition):
    def __init__(self, number: int, name: str, path: str, recursive: bool):
        self.number, self.name, self.path, self.recursive = number, name, path, recursive


def passed_over(e: os.DirEntry) -> bool:
    """Hidden entries, and folders that never hold images of interest."""
    hidden = e.name.startswith(".") or getattr(e.stat(follow_symlinks=False), "st_file_attributes", 0) & (stat.FILE_ATTRIBUTE_HIDDEN | stat.FILE_ATTRIBUTE_SYSTEM)
    return bool(hidden) or e.name.lower() in SKIPPED


def frontier(root: str, recursive: bool, most: int) -> list[tuple[str, bool]]:
    """(folder, whether all below it belongs to the part): parts that together are the tree, each listed by a task of its own.

    Folders are opened breadth first until there are ``most`` parts or 4 * ``most`` were opened, so the driver lists the top of
    the tree only, whatever its size.
    """
    if not recursive:
        return [(root, False)]
    opened: list[tuple[str, bool]] = []
    todo = deque([root])
    while todo and len(todo) < most and len(opened) < 4 * most:
        at = todo.popleft()
        try:
            below = sorted(e.path for e in os.scandir(at) if not passed_over(e) and e.is_dir(follow_symlinks=False))
        except OSError:
            below = []
        opened.append((at, False))
        todo.extend(below)
    return opened + [(p, True) for p in todo]


def scan(root: str, recursive: bool, extensions: tuple[str, ...]) -> Iterator[os.DirEntry]:
    """Files by depth first; hidden ones and what can't be read are passed over; a missing root gives none."""
    todo = [root]
    while todo:
        try:
            entries = sorted(os.scandir(todo.pop()), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            if passed_over(e):
                continue
            if e.is_dir(follow_symlinks=False):
                if recursive:
                    todo.append(e.path)
            elif e.name.rpartition(".")[1] and e.name.rpartition(".")[2].lower() in extensions:
                yield e


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """Options path, path2, ... and name, name2, ...; each source's tree is cut into some ``parallel`` parts (:func:`frontier`)."""
        out, most = [], int(self.options.get("parallel", "64"))
        for i in range(1, 1 + sum(k.startswith("path") for k in self.options)):
            s = "" if i == 1 else str(i)
            path = self.options[f"path{s}"]
            name = self.options.get(f"name{s}", os.path.basename(path))
            out += [Folder(i, name, p, r) for p, r in frontier(path, self.options.get(f"recursive{s}", "true") == "true", most)]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        extensions = tuple(self.options.get("extensions", ",".join(IMAGE_EXTENSIONS)).lower().split(","))
        for e in scan(partition.path, partition.recursive, extensions):
            s = e.stat()
            yield e.path, partition.name, partition.number, s.st_size, dt.datetime.fromtimestamp(s.st_mtime, dt.timezone.utc), getattr(s, "st_file_attributes", 0)


class FolderSource(DataSource):
    """``spark.dataSource.register(FolderSource); spark.read.format("folder").option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(dict(self.options))


EVENTS = "ts timestamp, op string, path string, old_path string, source string"


def differences(before: dict[str, tuple], now: dict[str, tuple]) -> list[tuple[str, str, str | None, str]]:
    """(op, path, old_path, source) between two listings {path: (identity, size, mtime, source)}.

    A file that is gone here and new there with the same identity was renamed.  Renames and deletions come first.
    """
    lost = {v[0]: p for p, v in before.items() if p not in now}
    out, moved = [], set()
    for p, v in now.items():
        if p not in before and v[0] in lost:
            moved.add(lost[v[0]])
            out.append(("renamed", p, lost[v[0]], v[3]))
    out += [("deleted", p, None, v[3]) for p, v in before.items() if p not in now and p not in moved]
    out += [("created", p, None, v[3]) for p, v in now.items() if p not in before and v[0] not in lost]
    return out + [("changed", p, None, v[3]) for p, v in now.items() if p in before and before[p][1:3] != v[1:3]]


class FolderEventsReader(SimpleDataSourceStreamReader):
    """Lists the folders at each trigger, on the driver, and tells what changed since the last one.

    With the option ``log``, a folder that outlives the driver, what is told is first written there, with the listing it
    follows from: a batch that was planned but not handled is told again after a restart, word for word, and so is what
    changed while nothing was running.  Without it, an index pass has to catch up with both.
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.seen = options, None
        self.told: dict[int, list[tuple]] = {}
        self.log = options.get("log")
        if self.log:
            os.makedirs(self.log, exist_ok=True)

    def _listing(self) -> dict[str, tuple]:
        extensions = tuple(self.options.get("extensions", ",".join(IMAGE_EXTENSIONS)).lower().split(","))
        out: dict[str, tuple] = {}
        for f in FolderReader(self.options).partitions():
            for e in scan(f.path, f.recursive, extensions):
                try:
                    s = e.stat()
                except OSError:
                    continue  # gone between the listing and the look
                out.setdefault(e.path, ((s.st_dev, s.st_ino), s.st_size, s.st_mtime_ns, f.name))
        return out

    def _file(self, name: str) -> str:
        return os.path.join(self.log, name)

    def _write(self, name: str, value) -> None:
        """Whole or not at all."""
        with open(self._file(name + ".tmp"), "w", encoding="utf-8") as f:
            json.dump(value, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self._file(name + ".tmp"), self._file(name))

    def _turns(self) -> list[int]:
        return sorted(int(n[5:-5]) for n in os.listdir(self.log) if n.startswith("turn-") and n.endswith(".json"))

    def _tell(self, turn: int, rows: list[tuple], now: dict[str, tuple]) -> None:
        if self.log is None:
            self.told[turn] = rows
            return
        # The turn with the listing after it: if it is there, it was told, and what follows starts from that listing.
        self._write(f"turn-{turn:012d}.json", {"rows": [[at.isoformat(), *rest] for at, *rest in rows], "listing": [[p, *v] for p, v in now.items()]})

    def _turn(self, turn: int) -> dict:
        with open(self._file(f"turn-{turn:012d}.json"), encoding="utf-8") as f:
            return json.load(f)

    def _rows(self, turn: int) -> list[tuple]:
        if self.log is None:
            return self.told.get(turn, [])
        if not os.path.exists(self._file(f"turn-{turn:012d}.json")):
            return []
        return [(dt.datetime.fromisoformat(at), *rest) for at, *rest in self._turn(turn)["rows"]]

    def initialOffset(self) -> dict:
        return {"turn": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        turns = self._turns() if self.log else []
        if turns and turns[-1] > start["turn"]:
            # Told before a restart, but not yet part of a batch.
            return iter([row for t in turns if t > start["turn"] for row in self._rows(t)]), {"turn": turns[-1]}
        if self.seen is None and turns:
            self.seen = {p: (tuple(i), size, m, name) for p, i, size, m, name in self._turn(turns[-1])["listing"]}
        now, before = self._listing(), self.seen
        self.seen = now
        turn = start["turn"] + 1
        if before is None and self.log:
            self._tell(turn, [], now)  # what later turns follow from
            return iter([]), {"turn": turn}
        found = [] if before is None else differences(before, now)
        if not found:
            return iter([]), start
        at = dt.datetime.now(dt.timezone.utc)
        self._tell(turn, [(at + dt.timedelta(microseconds=i), op, p, old, source) for i, (op, p, old, source) in enumerate(found)], now)
        return iter(self._rows(turn)), {"turn": turn}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([row for turn in range(start["turn"] + 1, end["turn"] + 1) for row in self._rows(turn)])

    def commit(self, end: dict) -> None:
        if self.log:
            # The last one holds the listing that the next turn follows from.
            for t in self._turns()[:-1]:
                if t <= end["turn"]:
                    os.remove(self._file(f"turn-{t:012d}.json"))
        self.told = {k: v for k, v in self.told.items() if k > end["turn"]}


class FolderEvents(DataSource):
    """``spark.readStream.format("folder-events").option("path", ...)``: events for :func:`tessera.streaming.watch.watch`."""

    @classmethod
    def name(cls) -> str:
        return "folder-events"

    def schema(self) -> StructType | str:
        return EVENTS

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return FolderEventsReader(dict(self.options))
