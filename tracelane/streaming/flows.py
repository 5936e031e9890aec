"""The same operators on streams.

Transcripts arrive as growing files (``growing``) or as closed segment files
``<dir>/<stem>.<generation>.<first line>.jsonl``. A transcript that was rewritten starts a new
generation. Windows over row order do not exist on streams, so what needs them runs inside
``foreachBatch`` on the batch operators, against tables of what is known so far. Runs with late rows are
in ``fold``, keyed state with timers in ``states``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelane.config import DEFAULTS, US, Params
from tracelane.operators.attribution import CREATED, REMOVED, kind_of, reset_reload, strength
from tracelane.operators.pairing import pair_calls
from tracelane.plans.live import as_log, classify_changes
from tracelane.session import staged
from tracelane.sources.changelog import write_change_log
from tracelane.sources.committed import Committed, partition_values
from tracelane.sources.raw import number_lines, plain_path
from tracelane.streaming.growing import numbered

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT = r"\A(.*)\.(\d+)\.(\d+)\.jsonl\z"
SEGMENT_COLUMNS = "file string, generation bigint, line_no bigint, value string"


# --- transcripts -----------------------------------------------------------------------


def tail(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Lines of new segments, as a stream."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    reader = reader.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.format("text").load(root).select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("_block"),
        "value",
    )


def segment_lines(batch: DataFrame) -> DataFrame:
    """A batch of segment lines under their transcript's name, with line numbers over all segments."""
    lines = number_lines(batch.withColumn("_pos", F.monotonically_increasing_id()))
    name = F.col("file")
    return lines.where(name.rlike(SEGMENT)).select(
        F.concat(F.regexp_extract(name, SEGMENT, 1), F.lit(".jsonl")).alias("file"),
        F.regexp_extract(name, SEGMENT, 2).cast("bigint").alias("generation"),
        (F.regexp_extract(name, SEGMENT, 3).cast("bigint") + F.col("line_no")).alias("line_no"),
        "value",
    )


def ingest(stream: DataFrame, table: str, checkpoint: str):
    """Append the lines of every batch to a table; one folder per batch makes a retry harmless."""

    def write(batch: DataFrame, batch_id: int) -> None:
        segment_lines(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def ingest_growing(stream: DataFrame, table: str, checkpoint: str):
    """Commit the lines of every batch of growing files (``growing.tail_growing``) to a table; read them with ``grown_lines``."""
    lines = Committed(stream.sparkSession, table)
    return stream.writeStream.foreachBatch(lambda batch, batch_id: lines.append(batch, batch_id) and None).option("checkpointLocation", checkpoint)


def grown_lines(spark: SparkSession, table: str) -> DataFrame:
    """The committed lines with their numbers, of each transcript's latest generation."""
    kept = Committed(spark, table).read("file string, generation bigint, split bigint, n bigint, pos bigint, value string")
    return numbered(current(kept))


def current(lines: DataFrame) -> DataFrame:
    """Only the latest generation of each transcript."""
    latest = lines.groupBy("file").agg(F.max("generation").alias("generation"))
    return lines.join(latest, ["file", "generation"], "left_semi").select(*lines.columns)


def reset_batch(events: DataFrame, known: DataFrame, batch_lines: DataFrame, fresh: DataFrame) -> DataFrame:
    """Events after a batch: transcripts with a newer generation lose what came from their log.

    ``known``: (who, generation) seen so far; ``fresh``: the batch's own events.
    """
    newer = (
        batch_lines.groupBy(F.col("file").alias("who"))
        .agg(F.max("generation").alias("_g"))
        .join(known.groupBy("who").agg(F.max("generation").alias("_k")), "who")
        .where("_g > _k")
        .select("who")
    )
    return reset_reload(events, newer, fresh)


def reingest(table: Committed, batch_id: int, who: DataFrame, fresh: DataFrame, parts: int = 64) -> bool:
    """Replace what the transcripts of ``who`` gave by ``fresh``, in a table that is partitioned by their hash.

    Only the partitions in which these transcripts lie are written anew, all in one commit; the files of the others stay.
    ``table`` has the partition column ``part`` (``by_transcript``).
    """

    def change() -> tuple[DataFrame, list[str]]:
        both = by_transcript(who.select("who").unionByName(fresh.select("who")), parts)
        files = table.in_partitions(partition_values(both, "part"))
        new = by_transcript(fresh, parts)
        if not files:
            return new, []
        return reset_reload(table.read(files=files), who, new.select(*table.read(files=files).columns)), files

    return table.replace(change, batch_id)


def by_transcript(events: DataFrame, parts: int = 64) -> DataFrame:
    return events.withColumn("part", F.pmod(F.xxhash64("who"), F.lit(parts)).cast("int"))


# --- changes ---------------------------------------------------------------------------


def debounce(changes: DataFrame, keys=("path",), p: Params = DEFAULTS, late: str = "10 seconds") -> DataFrame:
    """Coalesced changes: a session per path that ends after the quiet period.

    ``changes``: keys, ``at`` TIMESTAMP, ``change``, ``event_id``. A session is emitted once the
    watermark has passed its end; rows later than ``late`` belong to the batch path. A change
    exactly one quiet period after the last starts anew, hence the gap one microsecond short.
    """
    gap = f"{p.debounce * US - 1} microseconds"
    first = F.struct("at", "event_id", strength(F.col("change")).alias("s"))
    return (
        changes.withWatermark("at", late)
        .groupBy(*keys, F.session_window("at", gap))
        .agg(
            F.max("at").alias("at"),
            F.max(strength(F.col("change"))).alias("_top"),
            F.min(first).alias("_first"),
            F.min("event_id").alias("event_id"),
            F.count(F.lit(1)).alias("n_raw"),
        )
        .where(~((F.col("_first.s") == CREATED) & (F.col("_top") == REMOVED)))
        .select(
            *keys,
            "event_id",
            "at",
            kind_of(F.col("_top")).alias("change"),
            "n_raw",
        )
    )


def attribute_stream(
    settled: DataFrame,
    tables: Callable[[], dict],
    log: str,
    checkpoint: str,
    now_us: Callable[[], int],
    on_events: Callable[[DataFrame, int], None] | None = None,
    p: Params = DEFAULTS,
):
    """Attribute settled changes with the batch operators and append them to the log.

    ``tables`` gives the current prefixes, file_events, windows, calls and snapshots at each
    batch. The log's manifest makes a repeated batch change nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        events, _ = classify_changes(batch, now_us=now_us(), p=p, **tables())
        write_change_log(as_log(events), log, batch_id)
        if on_events is not None:
            on_events(events, batch_id)

    return settled.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def sink_changes(changes: DataFrame, log: str, checkpoint: str):
    """Append a stream of attributed changes (columns of the change log) to the log."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_change_log(batch, log, batch_id)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# --- calls, spans, sessions ------------------------------------------------------------


def pair_within(starts: DataFrame, results: DataFrame, bound: str, late: str = "10 seconds") -> DataFrame:
    """Calls with their results where a result comes within ``bound``; else the call alone.

    ``starts``/``results``: who, call_id, ``at`` TIMESTAMP. A stream-stream join: its state is
    limited by the bound, and a call stays open until the watermark has passed it.
    """
    s = starts.select("who", "call_id", F.col("at").alias("start")).withWatermark("start", late)
    r = results.select(F.col("who").alias("_w"), F.col("call_id").alias("_c"), F.col("at").alias("end")).withWatermark("end", late)
    match = (
        (F.col("who") == F.col("_w"))
        & (F.col("call_id") == F.col("_c"))
        & (F.col("end") >= F.col("start"))
        & (F.col("end") <= F.col("start") + F.expr(f"INTERVAL {bound}"))
    )
    return s.join(r, match, "leftOuter").drop("_w", "_c")


PAIRED = "who string, call_id string, start_us bigint, end_us bigint"
PENDING = "start_us bigint"


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pair one call id's records in reading order; only the pending start is kept between batches.

    All records of an id in a batch are few (an id is one call), so they are sorted here.
    """
    rows = pd.concat(list(batches)).sort_values("line_no")
    pending = state.get[0] if state.exists else None
    out = []
    for role, at in zip(rows["role"], rows["at_us"]):
        if role == "call":
            pending = at if pending is None else pending
        elif pending is not None:
            out.append((*key, pending, at))
            pending = None
    if pending is None:
        state.remove()
    else:
        state.update((int(pending),))
    yield pd.DataFrame(out, columns=["who", "call_id", "start_us", "end_us"])


def pair_any(records: DataFrame) -> DataFrame:
    """Calls with their results however far apart: the pending call is the state of its id.

    For ids that are one call each, so that an id has few records; else ``pair_batches``.
    """
    return records.groupBy("who", "call_id").applyInPandasWithState(
        _pair, PAIRED, PENDING, "append", GroupStateTimeout.NoTimeout
    )


def pair_batches(records: DataFrame, table: str, checkpoint: str, keys=("who", "call_id")):
    """Calls with their results however far apart, for ids of any size.

    Each batch is paired together with the calls still open before it, by the batch operator;
    ``<table>/pairs`` grows by what closed, ``<table>/open`` holds what is open after each
    batch. A repeated batch replaces its own folders.
    """
    schema = records.select(*keys, F.col("line_no").cast("bigint"), F.col("at_us").cast("bigint")).schema

    def pair(batch: DataFrame, batch_id: int) -> None:
        todo = batch.select(*keys, "line_no", "at_us", "role")
        if batch_id > 0:
            before = batch.sparkSession.read.schema(schema).parquet(f"{table}/open/batch={batch_id - 1}")
            todo = todo.unionByName(before.withColumn("role", F.lit("call")))
        done = staged(pair_calls(todo, keys))
        closed = done.where("result_line IS NOT NULL").select(*keys, "start_us", "end_us")
        closed.write.mode("overwrite").parquet(f"{table}/pairs/batch={batch_id}")
        still = done.where("result_line IS NULL").select(*keys, F.col("call_line").alias("line_no"), F.col("start_us").alias("at_us"))
        still.write.mode("overwrite").parquet(f"{table}/open/batch={batch_id}")

    return records.writeStream.foreachBatch(pair).option("checkpointLocation", checkpoint)


def span_stream(intervals: DataFrame, p: Params = DEFAULTS, late: str = "10 seconds") -> DataFrame:
    """Activity spans of a stream of intervals (who, ``start``, ``end`` TIMESTAMP).

    Each interval keeps its session open for its own length and the idle gap, so sessions are
    the merged spans. Only participants with new intervals are worked on.
    """
    length = F.unix_micros("end") - F.unix_micros("start") + p.idle_gap * US
    gap = F.concat(length.cast("string"), F.lit(" microseconds"))
    return (
        intervals.withWatermark("start", late)
        .groupBy("who", F.session_window("start", gap).alias("w"))
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("w")
    )


def last_activity(records: DataFrame) -> DataFrame:
    """Running start, last activity and recorded end per session, for update mode.

    Whether a session is live depends on the clock, so it is decided where the result is read
    (``operators.sessions.session_status``). ``records``: session, at_us, is_exit, recorded_us.
    """
    # An exit ends the session unless something came after it.
    last_exit = F.max(F.when(F.col("is_exit"), F.col("recorded_us")))
    last_other = F.max(F.when(~F.col("is_exit"), F.col("at_us")))
    return (
        records.groupBy("session")
        .agg(F.min("at_us").alias("start_us"), F.max("at_us").alias("last_seen_us"), last_exit.alias("_x"), last_other.alias("_o"))
        .select(
            "session",
            "start_us",
            "last_seen_us",
            F.when(F.col("_o").isNull() | (F.col("_x") >= F.col("_o")), F.col("_x")).alias("end_us"),
        )
    )


def keep_updates(updates: DataFrame, table: str, checkpoint: str):
    """Commit the updates of a keyed stream. A repeated batch is still run, for the state it makes, but not added again."""
    log = Committed(updates.sparkSession, table)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not log.append(batch.withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id):
            batch.write.format("noop").mode("overwrite").save()

    return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def missed(raw: DataFrame, handled: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of the raw table that a stream with a watermark dropped as too late; ``fold.fold`` takes them in."""
    return raw.join(handled.select(key), key, "left_anti")
