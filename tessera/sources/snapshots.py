"""The index as segments of Parquet files behind numbered pointer files.

A table is a list of segments.  A commit either replaces a table by one segment (:meth:`Snapshots.commit`) or
adds one with the rows that changed and the ids that went (:meth:`Snapshots.change`), so a burst of one file writes as much
as one file needs.  Readers merge: a row is passed over if a later segment replaced or deleted its id.  Segments are merged
when there are many (:meth:`Snapshots.compact`).  Images carry trigram postings, segment by segment, and the number and total length
of their rows, so text search reads a kept index.

A commit ends with one new pointer, so readers see a whole version or the one before.  A pointer is never replaced:
of two writers that read the same version the second finds its number taken and gets a Conflict instead of undoing the
first.  Pointers name every file with its length and checksum.  At open the last version whose files are all there is
taken; ``recovered`` says that a later one was passed over.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import diagnostics
from tessera.operators import postings
from tessera.plans.batches import small_batches

VERSION = 7
SCHEMAS = {
    "images": "id long, path string, name string, source string, size long, mtime timestamp, width int, height int, indexed_at timestamp, status string, error string, ocr_json string, text string",
    "embeddings": "image_id long, model string, vec array<float>",
    "text_embeddings": "image_id long, model string, vec array<float>",
}
KEYS = {"images": "id", "embeddings": "image_id", "text_embeddings": "image_id"}
GONE = "id long, seq long"
#: Segments of a table from which those after the first are merged, and rows of a file that a change writes.
SEGMENTS, FILE_ROWS = 8, 100_000
#: Rows of a page of postings, of which a block has some ten thousand.
PAGE_ROWS = 500
#: Compressed bytes that a task gathers before they are written: Spark's readers hold 4,096 rows at once, but none of two row groups, and
#: images in the order of time may have their longest texts together.
GROUP_BYTES, POSTINGS_BYTES = 8 << 20, 32 << 20


class Conflict(RuntimeError):
    """Another writer has committed since this version was read."""


class Snapshots:
    """Tables of one index below ``root``, any path that Spark's file systems know.

    ``check``: "files" looks at open whether all files are there with their lengths, "bytes" reads them and compares checksums, as a Spark job.
    """

    def __init__(self, spark: SparkSession, root: str, check: str = "files"):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.recovered, self.serial = False, 0
        self.state: dict = {"version": VERSION, "tables": {}}
        numbers = self._pointers()
        self.serial = numbers[-1] if numbers else 0
        for n in reversed(numbers):
            try:
                state = self._read(n)
                if not self.damaged(state, check):
                    self.state = state
                    break
                diagnostics.report(f"version {n} of {self.root} has damaged files")
            except Exception as e:  # a pointer that can't be read is passed over like one whose files are damaged
                diagnostics.report(e)
            self.recovered = True

    # --- pointers -------------------------------------------------------------------------------

    def _pointers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"pointer-(\d{12})\.json", n)))

    def _pointer(self, serial: int) -> str:
        return f"{self.root}/pointer-{serial:012d}.json"

    def _read(self, serial: int) -> dict:
        state = json.loads("\n".join(r[0] for r in self.spark.read.text(self._pointer(serial)).collect()))
        if state["version"] > VERSION or not set(state["tables"]) <= set(SCHEMAS):
            raise ValueError(f"version {state['version']} is unknown")
        # Before version 5 a table was one folder.
        state["tables"] = {n: [{"seq": 0, "rows": t, "files": {}}] if isinstance(t, str) else t for n, t in state["tables"].items()}
        if state["version"] < 6:
            # Postings were written in another form; such images are searched by their texts until all segments are merged.
            for s in (s for t in state["tables"].values() for s in t):
                s["files"].pop(s.pop("postings", None), None)
        return state

    def _publish(self, tables: dict[str, list[dict]]) -> None:
        state = {"version": VERSION, "tables": tables}
        new = self._path(f"{self.root}/tmp-{uuid.uuid4().hex}")
        self._create(new, json.dumps(state))
        self._add(new, self._path(self._pointer(self.serial + 1)))
        before, self.state, self.serial = self.state, state, self.serial + 1
        self._tell(before)

    def _create(self, at, text: str) -> None:
        stream = self._fs.create(at)
        stream.write(bytearray(text.encode()))
        stream.close()

    def put(self, path: str, text: str, overwrite: bool = False) -> None:
        """A small file, whole or not at all; FileExistsError if it is there and not to be overwritten."""
        new, to = self._path(f"{self.root}/tmp-{uuid.uuid4().hex}"), self._path(path)
        self._fs.mkdirs(to.getParent())
        self._create(new, text)
        try:
            self._rename(new, to, overwrite)
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise FileExistsError(path) from e
            raise

    def get(self, path: str) -> str:
        """A small file's text."""
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def move_away(self, path: str) -> bool:
        """Delete a file; of several that try, one succeeds."""
        gone = self._path(f"{self.root}/tmp-{uuid.uuid4().hex}")
        try:
            self._rename(self._path(path), gone, False)
        except Py4JJavaError:
            return False
        return bool(self._fs.delete(gone, False))

    def _rename(self, new, to, overwrite: bool) -> None:
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, int(overwrite))
        if overwrite:
            how[0] = kind.OVERWRITE
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(self._fs.makeQualified(new), self._fs.makeQualified(to), how)

    # --- what commits say -----------------------------------------------------------------------

    def by_source(self, state: dict | None = None) -> dict[str, int]:
        """How many images each source has, as the pointer says."""
        segments = (state or self.state)["tables"].get("images", [])
        return dict(segments[-1].get("by_source", {})) if segments else {}

    def _tell(self, before: dict) -> None:
        """One small file for each commit that changes these numbers: what :mod:`tessera.streaming.stats` adds up."""
        old, new = self.by_source(before), self.by_source()
        lines = [json.dumps({"seq": self.serial, "source": s, "n": new.get(s, 0) - old.get(s, 0)}) for s in sorted({*old, *new}) if new.get(s, 0) != old.get(s, 0)]
        if lines:
            self.put(f"{self.root}/feed/{self.serial:012d}.json", "\n".join(lines))

    def _add(self, new, pointer) -> None:
        """One rename that fails if the pointer is there."""
        try:
            self._rename(new, pointer, False)
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {self.serial + 1} was committed by another writer") from e
            raise

    # --- integrity ------------------------------------------------------------------------------

    def _files(self, at: str) -> dict[str, int]:
        """Names and lengths of a folder's data files."""
        if not self._fs.exists(self._path(f"{self.root}/{at}")):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(f"{self.root}/{at}")) if s.getPath().getName().endswith(".parquet")}

    def _sums(self, folders: list[str], whole: bool = False) -> dict[str, dict[str, list[int]]]:
        """For each folder its files' lengths and checksums; one job for all.

        Files are read as lines, whatever they hold, so a task holds no file, however large: the sum of the lines' CRC-32 and their number.
        ``whole``: the CRC-32 of the file's bytes, as it was before version 7.
        """
        out: dict[str, dict[str, list[int]]] = {at: {} for at in folders}
        sizes = {at: files for at in folders if (files := self._files(at))}
        paths = [f"{self.root}/{at}" for at in sizes]
        if not paths:
            return out
        read = self.spark.read.option("pathGlobFilter", "*.parquet")
        if whole:
            found = read.format("binaryFile").load(paths).select("path", F.array(F.crc32("content")).alias("sum"))
        else:
            lines = read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), F.crc32("value").alias("crc"))
            found = lines.groupBy("path").agg(F.array(F.sum("crc"), F.count(F.lit(1))).alias("sum"))
        for r in found.collect():
            folder, name = r["path"].rsplit("/", 2)[1:]
            out[folder][name] = [sizes[folder][name], *r["sum"]]
        return out

    def damaged(self, state: dict | None = None, check: str = "bytes") -> list[str]:
        """Files of a version (default: the one that is open) that are missing or not what was written, by their lengths or also their bytes."""
        wanted = {at: files for table in (state or self.state)["tables"].values() for s in table for at, files in s["files"].items()}
        if check == "files":
            found = {at: {n: [size] for n, size in self._files(at).items()} for at in wanted}
        else:
            old = [at for at, files in wanted.items() if any(len(known) == 2 for known in files.values())]
            found = self._sums([at for at in wanted if at not in old]) | self._sums(old, whole=True)
        return sorted(f"{at}/{n}" for at, files in wanted.items() for n, known in files.items() if found[at].get(n) != (known[:1] if check == "files" else known))

    # --- reading --------------------------------------------------------------------------------

    def _segments(self, name: str) -> list[dict]:
        return self.state["tables"].get(name, [])

    def _scan(self, at: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{at}")

    def _merged(self, name: str, segments: list[dict]) -> DataFrame:
        """Rows of the segments that none of them replaces or deletes."""
        out = None
        for s in segments:
            if s.get("rows"):
                rows = self._scan(s["rows"], SCHEMAS[name]).withColumn("seq", F.lit(s["seq"]).cast("long"))
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        key = KEYS[name]
        return postings.visible(out.withColumnRenamed(key, "id"), self.gone(segments)).withColumnRenamed("id", key).drop("seq")

    def gone(self, segments: list[dict]) -> DataFrame | None:
        """(id, seq): up to which commit rows of an id are out of date; None if no row is."""
        out = None
        for s in segments:
            if s.get("gone"):
                ids = self._scan(s["gone"], GONE)
                out = ids if out is None else out.unionByName(ids)
        return None if out is None else out.groupBy("id").agg(F.max("seq").alias("seq"))

    def table(self, name: str) -> DataFrame:
        """A table as it is after its last change."""
        return self._merged(name, self._segments(name))

    def text_index(self) -> postings.TextIndex | None:
        """The images' postings, or None where an older version kept none."""
        segments = self._segments("images")
        kept = [s for s in segments if s.get("rows")]
        if not kept or any(not s.get("postings") for s in kept):
            return None
        made = None
        for s in kept:
            part = self._scan(s["postings"], postings.SCHEMA)
            made = part if made is None else made.unionByName(part)
        n, total = segments[-1]["count"], segments[-1]["length"]
        return postings.TextIndex(made, self.gone(segments), n, total / n if n else 0.0)

    # --- writing --------------------------------------------------------------------------------

    def _write(self, kind: str, df: DataFrame) -> str:
        at = f"{kind}-{uuid.uuid4().hex}"
        out = df.write.option("compression", "zstd").option("parquet.block.size", POSTINGS_BYTES if kind == "postings" else GROUP_BYTES)
        if kind == "postings":
            # Each block is in the order of trigrams, of which a search wants few: it reads pages.
            out = out.option("parquet.page.row.count.limit", PAGE_ROWS)
        out.parquet(f"{self.root}/{at}")
        return at

    def _rows(self, name: str, df: DataFrame, parts: int | None = None) -> str:
        """Images are clustered by source and time for pruning."""
        out = df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])
        by = ["source", "mtime"] if name == "images" else ["image_id"]
        if name == "images" or parts:
            out = (out.repartitionByRange(parts, *by) if parts else out.repartitionByRange(*by)).sortWithinPartitions(*by)
        return self._write(name, out)

    def _finish(self, name: str, segment: dict, before: list[dict]) -> dict:
        """A segment with its files' checksums and, for images, postings and statistics of the table that ends with it."""
        if name == "images":
            rows = self._scan(segment["rows"], SCHEMAS[name]) if segment.get("rows") else None
            if rows is not None:
                with small_batches(self.spark):
                    segment["postings"] = self._write("postings", postings.build(rows, segment["seq"]))
            added = postings.statistics(self._scan(segment["postings"], postings.SCHEMA)) if rows is not None else (0, 0)
            of = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()} if rows is not None else {}
            sources = dict(before[-1].get("by_source", {})) if before else {}
            count, length = (before[-1]["count"], before[-1]["length"]) if before and "count" in before[-1] else (0, 0)
            if before and segment.get("gone"):
                # What the ids that go held until now, from the lists of ids alone.
                ids = self._scan(segment["gone"], GONE).select(F.col("id").alias("_i"))
                held = [postings.listed(self._scan(s["postings"], postings.SCHEMA)) for s in before if s.get("postings")]
                if held:
                    all_ = held[0]
                    for h in held[1:]:
                        all_ = all_.unionByName(h)
                    lost = postings.visible(all_.join(ids, F.col("id") == F.col("_i"), "left_semi"), self.gone(before)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("s")).first()
                    count, length = count - lost["n"], length - lost["s"]
                left = self._merged(name, before).select("id", "source").join(ids, F.col("id") == F.col("_i"), "left_semi")
                for r in left.groupBy("source").count().collect():
                    sources[r["source"]] = sources.get(r["source"], 0) - r["count"]
            for name_, n in of.items():
                sources[name_] = sources.get(name_, 0) + n
            segment |= {"count": count + added[0], "length": length + added[1], "by_source": {k: v for k, v in sources.items() if v}}
        folders = [segment[k] for k in ("rows", "gone", "postings") if segment.get(k)]
        return segment | {"files": self._sums(folders)}

    def commit(self, **tables: DataFrame) -> None:
        """New versions of the given tables, together; each is one segment."""
        seq, state = self.serial + 1, dict(self.state["tables"])
        for name, df in tables.items():
            state[name] = [self._finish(name, {"seq": seq, "rows": self._rows(name, df)}, [])]
        self._publish(state)

    def change(self, **tables: tuple[DataFrame | None, DataFrame | None]) -> None:
        """Add to the given tables, together: (rows that replace those of the same id or are new, ids that go); either may be None."""
        seq, state = self.serial + 1, dict(self.state["tables"])
        for name, (rows, ids) in tables.items():
            key, before = KEYS[name], state.get(name, [])
            segment: dict = {"seq": seq}
            if rows is not None:
                rows = rows.persist()
                n = rows.count()
                if n:
                    segment["rows"] = self._rows(name, rows, -(-n // FILE_ROWS))
                rows.unpersist()
            own = [self._scan(segment["rows"], SCHEMAS[name]).select(F.col(key).cast("long").alias("id"))] if segment.get("rows") and before else []
            own += [ids.select(F.col(ids.columns[0]).cast("long").alias("id"))] if ids is not None and before else []
            if own:
                both = own[0] if len(own) == 1 else own[0].unionByName(own[1])
                out = self._write("gone", both.distinct().withColumn("seq", F.lit(seq).cast("long")))
                if self._scan(out, GONE).limit(1).count():
                    segment["gone"] = out
            if segment.get("rows") or segment.get("gone"):
                state[name] = [*before, self._finish(name, segment, before)]
        self._publish(state)
        for name in tables:
            if len(self._segments(name)) > SEGMENTS:
                self.compact(name)

    def compact(self, name: str, whole: bool = False) -> None:
        """Merge the segments after the first into one, or, if ``whole``, all of them; what is read stays the same.

        Postings are merged in their order, and those of replaced rows go with a whole merge only.
        """
        segments = self._segments(name)
        if len(segments) < 2:
            return
        seq, state = self.serial + 1, dict(self.state["tables"])
        if whole:
            state[name] = [self._finish(name, {"seq": seq, "rows": self._rows(name, self._merged(name, segments))}, [])]
            self._publish(state)
            return
        first, rest = segments[0], segments[1:]
        made: dict = {"seq": rest[-1]["seq"]}
        if any(s.get("rows") for s in rest):
            made["rows"] = self._rows(name, self._merged(name, rest))
        gone = self.gone(rest)
        if gone is not None:
            made["gone"] = self._write("gone", gone)
        held = [self._scan(s["postings"], postings.SCHEMA) for s in rest if s.get("postings")]
        if held and len(held) == sum(bool(s.get("rows")) for s in rest):
            made["postings"] = self._write("postings", postings.merge(*held))
        if "count" in rest[-1]:
            made |= {k: rest[-1][k] for k in ("count", "length", "by_source")}
        state[name] = [first, made | {"files": self._sums([made[k] for k in ("rows", "gone", "postings") if made.get(k)])}]
        self._publish(state)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` versions names, and older pointers; returns how many folders went.

        Readers of older versions lose their files, so keep as many as are in use; run it while nobody commits, as files
        that are not named yet go, too.
        """
        numbers = self._pointers()
        held = set()
        for n in numbers[-keep:]:
            try:
                held |= {s.get(k) for t in self._read(n)["tables"].values() for s in t for k in ("rows", "gone", "postings")}
            except Exception:  # a broken pointer names nothing
                continue
        gone = 0
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if s.isDirectory() and name.rpartition("-")[0] in {*SCHEMAS, "gone", "postings"} and name not in held:
                gone += bool(self._fs.delete(s.getPath(), True))
        for n in numbers[:-keep]:
            self._fs.delete(self._path(self._pointer(n)), False)
        return gone

    def clear(self) -> None:
        """Empty tables; with the files of all versions before."""
        self.commit(**{n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items()})
        self.vacuum(1)
