"""Growing transcripts as a stream: offsets are byte positions in files.

The driver lists files and their sizes, as every file source does, and gives each batch the byte ranges that are new.
Executors read the ranges. A line belongs to the range that holds its line break: a last line without one waits until it is
finished, ranges may be cut anywhere, and every line is read once. A file that has shrunk, or whose
bytes before the known position have changed, is read anew as its next generation.

What the driver knows is written to ``positions`` before Spark learns of it: one small file per step with
the ranges that the step added, and from time to time one with all positions. Spark's own offset is
the step's number. So offsets stay small however many files there are, and a repeated batch reads the same ranges.

Lines are numbered afterwards (``numbered``): a task counts the lines of its range, and one row per range carries the
counts of the ranges before.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tracelane.sources.raw import BATCH_BYTES, lines_of_range, plain_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = TASK_BYTES = 128 << 20
RANGES = 1000
TAIL = 256
EVERY = 100
SCHEMA = "file string, generation bigint, split bigint, n bigint, pos bigint, value binary"


class Ranges(InputPartition):
    """Byte ranges (file, generation, first, end) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.positions = options["path"].rstrip("/"), options["positions"].rstrip("/")
        self.glob = options.get("glob", "*.jsonl")
        self.budget = int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", 0)))
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.version, self.known = 0, None

    # --- what is known -----------------------------------------------------------------

    def _steps(self) -> dict[str, list[int]]:
        from pyarrow import fs

        store, path = _store(self.positions)
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True))]
        return {kind: sorted(int(n.split(".")[0]) for n in names if n.endswith(f".{kind}")) for kind in ("step", "all")}

    def _load(self, version: int, kind: str):
        store, path = _store(self.positions)
        with store.open_input_stream(f"{path}/{version:012d}.{kind}") as file:
            return json.loads(file.read())

    def _save(self, version: int, kind: str, what) -> None:
        store, path = _store(self.positions)
        store.create_dir(path, recursive=True)
        hidden = f"{path}/.{version:012d}.{kind}"
        with store.open_output_stream(hidden) as file:
            file.write(json.dumps(what).encode())
        store.move(hidden, f"{path}/{version:012d}.{kind}")

    def _recover(self) -> None:
        """Positions from the last file with all of them and the steps after it."""
        steps = self._steps()
        self.known = {}
        if steps["all"]:
            self.version = steps["all"][-1]
            self.known = self._load(self.version, "all")
        for version in steps["step"]:
            if version > self.version:
                for file, generation, _, end, tail, changed in self._load(version, "step"):
                    self.known[file] = [generation, end, tail, changed]
                self.version = version

    # --- offsets -----------------------------------------------------------------------

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        if self.known is None:
            self._recover()
        store, path = _store(self.root)
        step, left = [], self.budget or (1 << 62)
        for info in sorted(store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)), key=lambda f: f.path):
            inside = info.path[len(path) :].lstrip("/")
            hidden = any(part.startswith((".", "_")) for part in inside.split("/"))
            if info.type != fs.FileType.File or hidden or not fnmatch.fnmatchcase(info.base_name, self.glob) or left <= 0:
                continue
            changed = info.mtime_ns or 0
            generation, end, tail, before = self.known.get(inside, [0, 0, "", 0])
            if info.size == end and changed == before:
                continue
            if info.size < end or (end and self._tail(store, info.path, end) != tail):
                generation, end = generation + 1, 0
            upto = min(info.size, end + left)
            if upto == end and inside in self.known:
                self.known[inside] = [generation, end, tail, changed]
                continue
            left -= upto - end
            step.append([inside, generation, end, upto, self._tail(store, info.path, upto), changed if upto == info.size else 0])
        if step:
            self._save(self.version + 1, "step", step)
            self.version += 1
            for file, generation, _, end, tail, changed in step:
                self.known[file] = [generation, end, tail, changed]
            if self.version % EVERY == 0:
                self._save(self.version, "all", self.known)
        return {"version": self.version}

    @staticmethod
    def _tail(store, path: str, end: int) -> str:
        with store.open_input_file(path) as file:
            first = max(0, end - TAIL)
            return hashlib.md5(file.read_at(end - first, first), usedforsecurity=False).hexdigest()

    # --- ranges ------------------------------------------------------------------------

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        new: dict[str, list[int]] = {}
        for version in range(start["version"] + 1, end["version"] + 1):
            for file, generation, first, upto, _, _ in self._load(version, "step"):
                held = new.get(file)
                if held and held[0] == generation:
                    held[2] = upto
                else:
                    new[file] = [generation, first, upto]
        tasks, task, size = [], [], 0
        for file, (generation, first, upto) in new.items():
            while first < upto:
                cut = min(upto, (first // self.split + 1) * self.split)
                if task and (size + cut - first > max(self.split, TASK_BYTES) or len(task) >= RANGES):
                    tasks.append(Ranges(task))
                    task, size = [], 0
                task.append((file, generation, first, cut))
                size += cut - first
                first = cut
        return [*tasks, Ranges(task)] if task else tasks

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, top = _store(self.root)
        names = ["file", "generation", "split", "n", "pos", "value"]
        rows, held = [], 0
        for file, generation, first, end in partition.ranges:
            with store.open_input_file(f"{top}/{file}") as source:
                for n, (pos, line) in enumerate(lines_of_range(source, first, end)):
                    rows.append((f"{self.root}/{file}", generation, first, n, pos, line))
                    held += len(line)
                    if held >= BATCH_BYTES or len(rows) >= 10_000:
                        yield _batch(rows, names)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, names)

    def commit(self, end: dict) -> None:
        """Steps below the last full list of positions are read by nobody once they are committed, but stay: they are small."""


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class Growing(DataSource):
    """``spark.readStream.format("growing")`` with options path, positions, glob, maxBytesPerTrigger, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


def tail_growing(spark: SparkSession, root: str, positions: str, glob: str = "*.jsonl", max_bytes: int | None = None, split_bytes: int | None = None) -> DataFrame:
    """New complete lines of the files below ``root``, as a stream. ``positions`` belongs to one checkpoint."""
    spark.dataSource.register(Growing)
    uri = root if "://" in root else f"file://{root}"
    reader = spark.readStream.format("growing").option("path", uri).option("glob", glob)
    reader = reader.option("positions", positions if "://" in positions else f"file://{positions.removeprefix('file:')}")
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes))
    if split_bytes:
        reader = reader.option("splitBytes", str(split_bytes))
    lines = reader.load()
    return lines.select(plain_path(F.col("file")).alias("file"), "generation", "split", "n", "pos", F.col("value").cast("string").alias("value"))


def numbered(lines: DataFrame) -> DataFrame:
    """(file, generation, line_no, value) of stored lines: a line's number in its range, after the lines of the ranges before."""
    counts = lines.groupBy("file", "generation", "split").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("file", "generation").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select("file", "generation", "split", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    return lines.join(carry, ["file", "generation", "split"]).select("file", "generation", (F.col("n") + F.col("_b")).alias("line_no"), "value")
