"""Saving the log-derived tables, and reusing them while they still fit.

Tables with a time are laid out by day, file events by root and day. Rows are dealt out by ranges of (root, day, time):
a large root or day spreads over many files, small ones share a task, and each file covers a short span of
time, so readers skip by folder first and by the files' value ranges then.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelane.functions.num import floor_div
from tracelane.plans.model import Tables

FORMAT = 2
DAY_US = 86_400_000_000
#: Time column and partition columns of the tables that have them. ``_day`` is days since the epoch.
LAYOUT = {
    "file_events": ("start_us", ("root_id", "_day")),
    "raw_intervals": ("start_us", ("_day",)),
    "spans": ("start_us", ("_day",)),
    "prompts": ("at_us", ("_day",)),
    "tool_windows": ("start_us", ("_day",)),
    "snapshots": ("at_us", ("_day",)),
}


@dataclass(frozen=True)
class Meta:
    """What the tables were made from; any difference means they have to be made again."""

    harness_roots: tuple[str, ...]
    roots: tuple[str, ...]
    idle_gap: int
    format: int = FORMAT

    def text(self) -> str:
        return json.dumps([self.format, list(self.harness_roots), list(self.roots), self.idle_gap])


def day(at: str | Column) -> Column:
    return floor_div(at, DAY_US)


def laid_out(name: str, df: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """A table's rows in the order of their files, and its partition columns; a table without its columns is left as it is."""
    at, parts = LAYOUT.get(name, (None, ()))
    if at not in df.columns or not set(parts) - {"_day"} <= set(df.columns):
        return df, ()
    df = df.withColumn("_day", day(at))
    return df.repartitionByRange(*parts, at).sortWithinPartitions(*parts, at), parts


def save_model(tables: Tables, path: str, meta: Meta) -> None:
    """Write every table as parquet. The one-row meta table comes last and names the folder,
    so a save that fails half-way leaves the previous one in force.

    Changes seen on the file system are left out: they have a log of their own.
    """
    folder = f"{path.rstrip('/')}/tables-{uuid.uuid4().hex}"
    schemas = {}
    for name, df in tables.items():
        if name == "file_events":
            df = df.where(F.col("source").isin("tool", "inferred"))
        columns = df.columns
        df, parts = laid_out(name, df)
        names = [c for c in df.columns if c not in parts]
        schemas[name] = [StructType([df.schema[c] for c in [*names, *parts]]).json(), columns]
        writer = df.write.partitionBy(*parts) if parts else df.write
        writer.parquet(f"{folder}/{name}")
    spark = tables.sessions.sparkSession
    row = spark.createDataFrame([(meta.text(), folder, json.dumps(schemas))], "meta string, folder string, schemas string")
    row.withColumn("saved", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/meta")


def _saved(spark: SparkSession, path: str, meta: Meta) -> dict[str, DataFrame] | None:
    try:
        saved = spark.read.parquet(f"{path.rstrip('/')}/meta")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    last = saved.orderBy(F.desc("saved")).first()  # one row per save
    if last is None or last["meta"] != meta.text():
        return None
    schemas = json.loads(last["schemas"])
    found = {}
    for name in Tables.__dataclass_fields__:
        schema, columns = schemas[name]
        df = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{last['folder']}/{name}")
        found[name] = df.select(*columns, *[c for c in df.columns if c not in columns])
    return found


def load_model(spark: SparkSession, path: str, meta: Meta) -> Tables | None:
    """The latest saved tables if they were made from the same things, else None."""
    found = _saved(spark, path, meta)
    return None if found is None else Tables(*[df.drop("_day") for df in found.values()])


def load_between(spark: SparkSession, path: str, meta: Meta, name: str, start_us: int, end_us: int, roots: list[int] | DataFrame | None = None) -> DataFrame | None:
    """Rows of one saved table whose time lies in [start_us, end_us), of some roots: only their folders are read.

    ``roots`` as a table (column ``root_id``) prunes folders when the query runs.
    """
    found = _saved(spark, path, meta)
    if found is None:
        return None
    at, parts = LAYOUT[name]
    df = found[name].where((F.col(at) >= start_us) & (F.col(at) < end_us))
    if "_day" in df.columns:
        df = df.where((F.col("_day") >= start_us // DAY_US) & (F.col("_day") <= (end_us - 1) // DAY_US))
    if isinstance(roots, list):
        df = df.where(F.col("root_id").isin(roots))
    elif roots is not None:
        df = df.join(roots.select("root_id").distinct(), "root_id", "left_semi")
    return df.drop("_day")
