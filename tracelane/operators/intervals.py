"""Merging intervals, and the intervals that records imply. Times are BIGINT microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.config import US
from tracelane.functions.num import floor_div
from tracelane.operators.ordered import ordered, previous, running_last, running_max, running_sum


def merge_intervals(
    df: DataFrame, keys, start: str = "start_us", end: str = "end_us", gap: int = 0, block_rows: int | None = None
) -> DataFrame:
    """Gaps and islands: one row per run whose inner gaps are at most ``gap``.

    ``gap`` is in the unit of the columns and inclusive; a reversed interval is turned round.
    With keys there is one shuffle. Without, intervals with the same start are first reduced to
    the longest on the map side: over a whole table there is at most one per unit of time.
    """
    keys = tuple(keys)
    parts = df.select(*keys, F.least(start, end).alias("_s"), F.greatest(start, end).alias("_e"))
    if keys:
        parts = parts.withColumn("_n", F.lit(1).cast("bigint"))
    else:
        parts = parts.groupBy("_s").agg(F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_n"))
    runs = (
        ordered(parts, keys, ("_s", "_e"), block_rows, copies=True)
        .scan(_reach=running_max("_e"))
        .with_column("_new", F.when(F.col("_reach").isNull() | (F.col("_s") - F.col("_reach") > gap), F.col("_s")))
        .scan(_run=running_max("_new", inclusive=True))
    )
    return (
        runs.df.groupBy(*keys, "_run")
        .agg(F.max("_e").alias(end), F.sum("_n").alias("n_intervals"))
        .select(*keys, F.col("_run").alias(start), end, "n_intervals")
    )


def union_intervals(*dfs: DataFrame) -> DataFrame:
    """Raw intervals of several producers, ends in order."""
    out = None
    for df in dfs:
        part = df.select(
            "who", F.least("start_us", "end_us").alias("start_us"), F.greatest("start_us", "end_us").alias("end_us")
        )
        out = part if out is None else out.unionByName(part)
    return out


def whole_seconds(df: DataFrame, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Interval columns as whole epoch seconds ``start_s``/``end_s``, floored."""
    s, e = floor_div(start, US), floor_div(end, US)
    return df.select(F.least(s, e).alias("start_s"), F.greatest(s, e).alias("end_s"))


def activity_union(
    events: DataFrame, spans: DataFrame | None = None, prompts: DataFrame | None = None, block_rows: int | None = None
) -> DataFrame:
    """All activity as disjoint runs of whole seconds; runs that touch are one.

    Leave out spans and prompts while an action filter is on.
    """
    parts = whole_seconds(events)
    if spans is not None:
        parts = parts.unionByName(whole_seconds(spans))
    if prompts is not None:
        parts = parts.unionByName(whole_seconds(prompts, "at_us", "at_us"))
    return merge_intervals(parts, (), "start_s", "end_s", 0, block_rows).drop("n_intervals")


def generation_intervals(
    records: DataFrame, keys=("who",), at: str = "at_us", line: str = "line_no", block_rows: int | None = None
) -> DataFrame:
    """From the latest earlier entry to each assistant record, where time went forward.

    ``records`` are the user and assistant entries, with a boolean ``is_assistant``.
    """
    seen = ordered(records, keys, (line,), block_rows).scan(_prev=running_max(at))
    return seen.df.where(F.col("is_assistant") & (F.col("_prev") < F.col(at))).select(
        *keys, F.col("_prev").alias("start_us"), F.col(at).alias("end_us")
    )


def turn_intervals(
    records: DataFrame, keys=("who",), at: str = "at_us", line: str = "line_no", block_rows: int | None = None
) -> DataFrame:
    """Steps between neighbouring records inside a turn.

    ``records`` carry ``marker``: 'start', 'end' or null. A start begins a turn and never
    closes a step; the record marked 'end' still belongs to its turn.
    """
    seen = ordered(records, keys, (line,), block_rows).scan(_open=running_last("marker"), _prev=previous(at))
    inside = (F.col("_open") == "start") & F.coalesce(F.col("marker") != "start", F.lit(True))
    return seen.df.where(inside & (F.col("_prev.v") < F.col(at))).select(
        *keys, F.col("_prev.v").alias("start_us"), F.col(at).alias("end_us")
    )


def islands(df: DataFrame, keys, at: str, order, gap: int, block_rows: int | None = None):
    """Number the bursts of points: a new one starts where the step reaches ``gap``."""
    return (
        ordered(df, keys, order, block_rows)
        .scan(_prev=running_max(at))
        .with_column("_first", F.col("_prev").isNull() | (F.col(at) - F.col("_prev") >= gap))
        .scan(burst=running_sum(F.col("_first").cast("bigint"), inclusive=True))
    )
