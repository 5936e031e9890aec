"""The persisted log of attributed changes: JSON lines per root, committed batch by batch and replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.functions.calls import parse_ts
from tracelane.operators.roots import project_rel, root_prefixes
from tracelane.sources import variant as V
from tracelane.sources.committed import Committed
from tracelane.sources.participants import YOU
from tracelane.sources.touches import detail

# The change words of the log.
CHANGES = ("created", "modified", "removed")


def log_lines(changes: DataFrame) -> DataFrame:
    """One JSON text per change, with its ``root_id``.

    Columns: root_id, rel, at_us, change, who, call_id, tool, input, diff. Missing values are
    left out.
    """
    at = F.date_format(F.timestamp_micros("at_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    agent = F.to_json(
        F.struct(
            F.col("who").alias("file"),
            F.coalesce("call_id", F.lit("")).alias("toolCallId"),
            F.coalesce("tool", F.lit("bash")).alias("tool"),
            F.col("input"),
        )
    )
    who = F.when(F.col("who") == YOU, F.lit(f'"{YOU}"')).otherwise(agent)
    line = F.struct(
        at.alias("t"), F.col("rel").alias("path"), F.col("change"), F.parse_json(who).alias("who"), F.col("diff")
    )
    return changes.select("root_id", F.to_json(line).alias("value"))


def change_log(spark: SparkSession, path: str) -> Committed:
    """The log's files: JSON lines by root, in force once their commit is published."""
    return Committed(spark, path, ("root_id",), "text")


def write_change_log(changes: DataFrame, path: str, batch: int) -> bool:
    """Add one batch to the log. What a failed attempt left behind is never read, and a repeated batch changes nothing."""
    return change_log(changes.sparkSession, path).append(log_lines(changes), batch)


def read_change_log(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed lines of the log; what cannot be understood is skipped."""
    return parse_lines(change_log(spark, path).read("value string, root_id bigint"))


def parse_lines(lines: DataFrame) -> DataFrame:
    log = lines.select("root_id", F.try_parse_json("value").alias("rec")).where("rec IS NOT NULL")
    who = V.text("rec", "$.who")
    file = V.text("rec", "$.who.file")
    call = F.nullif(V.text("rec", "$.who.toolCallId"), F.lit(""))
    parsed = log.select(
        F.col("root_id").cast("bigint").alias("root_id"),
        V.text("rec", "$.path").alias("path"),
        V.text("rec", "$.change").alias("change"),
        parse_ts(V.text("rec", "$.t")).alias("at_us"),
        F.when(who == YOU, who).otherwise(file).alias("who"),
        F.when(file.isNotNull(), call).alias("call_id"),
        F.when(file.isNotNull(), F.coalesce(V.text("rec", "$.who.tool"), F.lit("bash"))).alias("tool"),
        V.text("rec", "$.who.input").alias("input"),
        V.text("rec", "$.diff").alias("diff"),
    )
    return parsed.where(
        F.col("path").isNotNull() & F.col("at_us").isNotNull() & F.col("who").isNotNull() & F.col("change").isin(*CHANGES)
    )


def resolve_replay(
    log: DataFrame, participants: DataFrame, roots: DataFrame, aliases: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """File events and replayed calls of a log.

    Lines of unknown participants are dropped. A path is placed among today's roots, so that it
    moves to a checkout nested in its old one; a path no root has keeps its own.
    """
    known = participants.select("who").unionByName(
        participants.sparkSession.createDataFrame([(YOU,)], "who string")
    ).distinct()
    lines = log.join(known, "who", "left_semi")
    bases = roots.select(F.col("root_id").cast("bigint").alias("root_id"), F.col("path").alias("_base"))
    lines = lines.join(bases, "root_id").withColumnsRenamed({"root_id": "_own"})
    lines = lines.withColumn("_abs", F.concat("_base", F.lit("/"), "path"))
    placed = project_rel(lines, root_prefixes(roots, aliases), "_abs")
    has_call = F.col("call_id").isNotNull()
    events = placed.select(
        "who",
        F.lit("project").alias("scope"),
        F.coalesce("root_id", "_own").cast("bigint").alias("root_id"),
        F.lit(None).cast("string").alias("scope_session"),
        F.coalesce("rel", "path").alias("rel"),
        F.lit("write").alias("kind"),
        F.when(has_call, "window").otherwise("watcher").alias("source"),
        F.when(has_call, F.col("tool")).alias("tool"),
        F.col("at_us").alias("start_us"),
        F.col("at_us").alias("end_us"),
        "call_id",
        detail("fs", fs_change=F.col("change"), diff=F.col("diff")).alias("detail"),
    )
    copies = placed.where(has_call & F.col("input").isNotNull())
    first = F.min_by(F.struct("tool", "input"), F.struct("at_us", "rel"))
    calls = copies.groupBy("who", "call_id").agg(first.alias("c")).select("who", "call_id", "c.tool", "c.input")
    return events, calls


def known_calls(transcript: DataFrame, replayed: DataFrame) -> DataFrame:
    """Calls of both; a transcript's own beats the replayed copy."""
    only = replayed.join(transcript.select("who", "call_id"), ["who", "call_id"], "left_anti")
    names = ["who", "call_id", "tool", "input"]
    return transcript.select(*names).unionByName(only.select(*names))
