"""Tables of files that count only once a manifest names them.

A commit writes its data files into a folder of its own and then publishes one manifest, by a rename that fails where
the manifest exists. So a batch that failed half-way leaves files that nobody reads, a batch that is repeated
changes nothing, and replacing files (partitions that are written anew, small files that are merged) is one step.

``<path>/_commits/<batch>``          what the commit added (file, bytes) and removed
``<path>/_commits/<batch>.all``      all files in force after it, and the batches it stands for
``<path>/commit=<batch>.<id>/...``   data files, below the partition columns' folders

Manifests name files only; they pass the driver as any file listing does, and ``compact`` keeps them few. One writer at
a time: streams number their batches, and so do callers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TARGET_BYTES = 128 << 20


class Store:
    """The few file operations that a manifest needs, through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.top = path.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def files(self, folder: str) -> list[tuple[str, int]]:
        """(path below the top, bytes) of the data files below a folder."""
        top, out = str(self.fs.makeQualified(self._path("")).toUri().getPath()), []
        found = self.fs.listFiles(self._path(folder), True)
        while found.hasNext():
            status = found.next()
            if not status.getPath().getName().startswith(("_", ".")):
                out.append((status.getPath().toUri().getPath()[len(top) + 1 :], status.getLen()))
        return sorted(out)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def rename(self, name: str, to: str) -> bool:
        """Rename a file or folder; False where the new name is taken."""
        if self.fs.exists(self._path(to)):
            return False
        return self.fs.rename(self._path(name), self._path(to))

    def publish(self, name: str, text: str) -> None:
        """Create a file as a whole, or fail where it exists."""
        hidden = self._path(f"_commits/.{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(name)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context.rename(hidden, target, options)


class Committed:
    """A committed table. ``kind`` is the file format; a text table has ``value`` and its partition columns."""

    def __init__(self, spark: SparkSession, path: str, partitions: tuple[str, ...] = (), kind: str = "parquet"):
        self.spark, self.path, self.partitions, self.kind = spark, path.rstrip("/"), tuple(partitions), kind
        self.store = Store(spark, self.path)

    def state(self) -> tuple[set[int], dict[str, int]]:
        """The batches that are in, and the files in force with their bytes."""
        names = self.store.names("_commits")
        whole = sorted(int(n[:-4]) for n in names if n.endswith(".all"))
        batches, files = set(), {}
        if whole:
            last = json.loads(self.store.read(f"_commits/{whole[-1]:020d}.all"))
            batches, files = set(last["batches"]), dict(last["files"])
        for n in sorted(int(n) for n in names if n.isdigit()):
            if n not in batches:
                entry = json.loads(self.store.read(f"_commits/{n:020d}"))
                for file in entry["removed"]:
                    files.pop(file, None)
                files.update(entry["added"])
                batches.add(n)
        return batches, files

    def _write(self, df: DataFrame, batch: int) -> list[tuple[str, int]]:
        folder = f"commit={batch}.{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*self.partitions) if self.partitions else df.write
        writer.format(self.kind).save(f"{self.path}/{folder}")
        return self.store.files(folder)

    def append(self, df: DataFrame, batch: int) -> bool:
        """Add a batch once; False where it is in already."""
        return self.replace(lambda: (df, []), batch)

    def replace(self, change: Callable[[], tuple[DataFrame, list[str]]], batch: int) -> bool:
        """One commit that adds rows and takes files out; ``change`` says which, and is not asked for a batch that is in."""
        if batch in self.state()[0]:
            return False
        df, removed = change()
        added = self._write(df, batch)
        self.store.publish(f"_commits/{batch:020d}", json.dumps({"added": added, "removed": sorted(removed)}))
        return True

    def in_partitions(self, values: list[tuple]) -> list[str]:
        """The files in force whose partition columns have one of these values (as the folder names spell them)."""
        wanted = {tuple("__HIVE_DEFAULT_PARTITION__" if v is None else str(v) for v in value) for value in values}
        return [f for f in self.state()[1] if tuple(unquote(p.partition("=")[2]) for p in f.split("/")[1:-1]) in wanted]

    def read(self, schema: str | StructType | None = None, files: list[str] | None = None) -> DataFrame:
        """The rows in force, or those of some of the files. ``schema`` names the columns where no file may be in force."""
        if files is None:
            files = sorted(self.state()[1])
        if not files:
            if schema is None:
                raise ValueError(f"nothing is committed in {self.path}, so its columns must be given")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", self.path).format(self.kind)
        if schema is not None:
            names = schema if isinstance(schema, StructType) else self.spark.createDataFrame([], schema).schema
            reader = reader.schema(StructType([*names.fields, StructField("commit", StringType())]))
        return reader.load([f"{self.path}/{f}" for f in files]).drop("commit")

    def compact(self, target_bytes: int = TARGET_BYTES) -> int:
        """Merge the files that are smaller than the target into files near it. Returns how many files were merged."""
        batches, files = self.state()
        small = {f: n for f, n in files.items() if n < target_bytes}
        if len(small) < 2:
            return 0
        last = max(batches)
        df = self.read(files=sorted(small))
        parts = max(1, -(-sum(small.values()) // target_bytes))
        added = dict(self._write(df.repartitionByRange(parts, *self.partitions) if self.partitions else df.coalesce(parts), last))
        kept = {f: n for f, n in files.items() if f not in small}
        name = f"_commits/{last:020d}.all"
        if f"{last:020d}.all" in self.store.names("_commits"):  # compacted before at this batch: nothing came since
            return 0
        self.store.publish(name, json.dumps({"batches": sorted(batches), "files": {**kept, **added}}))
        return len(small)


def partition_values(df: DataFrame, *columns: str) -> list[tuple]:
    """The distinct values of partition columns: as many as folders that the commit would write anyway."""
    return [tuple(r) for r in df.select(*[F.col(c) for c in columns]).distinct().collect()]
