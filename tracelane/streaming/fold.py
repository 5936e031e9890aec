"""Runs of a stream in a committed table, with late rows folded in.

Spans and bursts are runs: rows of a key whose steps stay below a gap. Merging is closed under union, so a run is
kept as one row with what its rows add up to, and a row that comes late, however late, is merged into the runs
it touches: those are taken out of the table and the run that they form together is put in. No watermark decides
what is too late.

The table's partitions are the time slot of a run's end and a hash of its key. A batch reads the slots that its rows can reach,
and replaces the partitions whose runs have changed, in one commit; a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.config import DEFAULTS, US, Params
from tracelane.functions.num import floor_div
from tracelane.operators.attribution import CREATED, REMOVED, kind_of, strength
from tracelane.operators.ordered import ordered, running_max
from tracelane.session import staged
from tracelane.sources.committed import Committed, partition_values

SLOT_US = 3_600 * US
PARTS = 8


@dataclass(frozen=True)
class Runs:
    """What a run is: its keys, the largest gap inside, and how the further columns add up."""

    keys: tuple[str, ...]
    gap: int
    sums: dict[str, Callable]
    columns: str
    #: Whether rows exactly one gap apart still belong together.
    inclusive: bool = True

    def merged(self, rows: DataFrame, block_rows: int | None = None) -> DataFrame:
        step = F.col("start_us") - F.col("_reach")
        apart = step > self.gap if self.inclusive else step >= self.gap
        runs = (
            ordered(rows, self.keys, ("start_us", "end_us"), block_rows, copies=True)
            .scan(_reach=running_max("end_us"))
            .with_column("_new", F.when(F.col("_reach").isNull() | apart, F.col("start_us")))
            .scan(_run=running_max("_new", inclusive=True))
        )
        sums = [f(c).alias(c) for c, f in self.sums.items()]
        return runs.df.groupBy(*self.keys, "_run").agg(F.max("end_us").alias("end_us"), *sums).select(*self.keys, F.col("_run").alias("start_us"), "end_us", *self.sums)


def run_table(spark: SparkSession, path: str) -> Committed:
    return Committed(spark, path, ("slot", "part"))


def _placed(rows: DataFrame, keys, slot_us: int, parts: int) -> DataFrame:
    return rows.withColumns({"slot": floor_div("end_us", slot_us), "part": F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")})


def stored(table: Committed, runs: Runs, files: list[str] | None = None) -> DataFrame:
    return table.read(f"{runs.columns}, slot bigint, part int", files)


def fold(batch: DataFrame, table: Committed, batch_id: int, runs: Runs, slot_us: int = SLOT_US, parts: int = PARTS) -> bool:
    """Merge a batch of rows (the columns of ``runs``) into the table; False where the batch is in already."""

    def change() -> tuple[DataFrame, list[str]]:
        new = staged(runs.merged(batch))
        # How far the batch reaches, per key; its slots bound what has to be read.
        reach = new.groupBy(*runs.keys).agg((F.min("start_us") - runs.gap).alias("_lo"), (F.max("end_us") + runs.gap).alias("_hi"))
        first = reach.agg(floor_div(F.min("_lo"), slot_us)).first()[0]
        files = sorted(table.state()[1])
        near = [] if first is None else [f for f in files if int(f.split("/")[1].partition("=")[2]) >= first]
        old = staged(stored(table, runs, near)) if near else stored(table, runs, [])
        touched = old.join(reach, list(runs.keys)).where("end_us >= _lo AND start_us <= _hi").select(*old.columns)
        touched = staged(touched)
        whole = staged(_placed(runs.merged(touched.drop("slot", "part").unionByName(new)), runs.keys, slot_us, parts))
        places = sorted({*partition_values(touched, "slot", "part"), *partition_values(whole, "slot", "part")})
        gone = set(table.in_partitions(places)) if places else set()
        rest = stored(table, runs, sorted(gone)).join(touched.select(*runs.keys, "start_us"), [*runs.keys, "start_us"], "left_anti") if gone else stored(table, runs, [])
        # Ranges, so that a folder gets few files and a large one is written by several tasks.
        return rest.select(*whole.columns).unionByName(whole).repartitionByRange("slot", "part", *runs.keys), sorted(gone)

    return table.replace(change, batch_id)


def fold_stream(stream: DataFrame, path: str, checkpoint: str, runs: Runs, slot_us: int = SLOT_US, parts: int = PARTS):
    """Keep a table of runs up to date with a stream of rows (the columns of ``runs``)."""
    table = run_table(stream.sparkSession, path)
    return stream.writeStream.foreachBatch(lambda batch, batch_id: fold(batch, table, batch_id, runs, slot_us, parts) and None).option("checkpointLocation", checkpoint)


# --- spans and bursts -----------------------------------------------------------------------


def span_runs(p: Params = DEFAULTS, who: str = "bigint") -> Runs:
    return Runs(("who",), p.idle_gap * US, {"n_intervals": F.sum}, f"who {who}, start_us bigint, end_us bigint, n_intervals bigint")


def span_rows(intervals: DataFrame) -> DataFrame:
    """Intervals (who, start_us, end_us) as runs of one; a reversed interval is turned round."""
    return intervals.select("who", F.least("start_us", "end_us").alias("start_us"), F.greatest("start_us", "end_us").alias("end_us"), F.lit(1).cast("bigint").alias("n_intervals"))


def burst_runs(p: Params = DEFAULTS) -> Runs:
    sums = {"begin": F.min, "top": F.max, "event_id": F.min, "n_raw": F.sum}
    columns = "path string, start_us bigint, end_us bigint, begin struct<at:bigint,ord:bigint,s:int>, top int, event_id bigint, n_raw bigint"
    return Runs(("path",), p.debounce * US, sums, columns, inclusive=False)


def burst_rows(changes: DataFrame) -> DataFrame:
    """Changes (path, at_us, event_id, change) as bursts of one."""
    s = strength(F.col("change"))
    begin = F.struct(F.col("at_us").alias("at"), F.col("event_id").alias("ord"), s.alias("s"))
    return changes.select("path", F.col("at_us").alias("start_us"), F.col("at_us").alias("end_us"), begin.alias("begin"), s.alias("top"), "event_id", F.lit(1).cast("bigint").alias("n_raw"))


def settled(bursts: DataFrame) -> DataFrame:
    """Bursts as coalesced changes; one that began with a creation and came to a removal leaves nothing behind."""
    kept = bursts.where(~((F.col("begin.s") == CREATED) & (F.col("top") == REMOVED)))
    return kept.select("path", "event_id", F.col("end_us").alias("at_us"), kind_of(F.col("top")).alias("change"), "n_raw")
