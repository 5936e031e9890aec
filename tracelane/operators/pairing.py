"""Calls and their results, and the windows they open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.operators.ordered import ordered, running_last, running_min, running_sum


def pair_calls(
    records: DataFrame,
    keys=("who", "call_id"),
    line: str = "line_no",
    at: str = "at_us",
    block_rows: int | None = None,
) -> DataFrame:
    """One row per call: the first start wins, the next result closes it.

    ``records``: keys, line, at and ``role`` ('call' or 'result'). Each result ends a
    generation, so an id may be used again afterwards; a result without a call gives nothing,
    a call without a result stays open. One shuffle and no self-join.
    """
    is_result = (F.col("role") == "result").cast("bigint")
    numbered = ordered(records, keys, (line,), block_rows).scan(_g=running_sum(is_result, inclusive=False))
    when_call = F.when(F.col("role") == "call", F.col(line))
    when_result = F.when(F.col("role") == "result", F.col(line))
    return (
        numbered.df.withColumn("_gen", F.coalesce("_g", F.lit(0).cast("bigint")))
        .groupBy(*keys, "_gen")
        .agg(
            F.min_by(at, when_call).alias("start_us"),
            F.min_by(at, when_result).alias("end_us"),
            F.min(when_call).alias("call_line"),
            F.min(when_result).alias("result_line"),
        )
        .where("call_line IS NOT NULL")
        .drop("_gen")
    )


def open_close(
    records: DataFrame, keys=("who", "call_id"), line: str = "line_no", at: str = "at_us", block_rows: int | None = None
) -> DataFrame:
    """Tool windows: the first open of an id counts, for good; the first close after it ends it.

    ``records``: keys, line, at, ``op`` ('open' or 'close').
    """
    opens = F.when(F.col("op") == "open", F.col(line))
    seen = ordered(records, keys, (line,), block_rows).scan(_open=running_min(opens, inclusive=True))
    close = F.when((F.col("op") == "close") & F.col("_open").isNotNull(), F.col(line))
    return (
        seen.df.groupBy(*keys)
        .agg(
            F.min_by(at, opens).alias("start_us"),
            F.min(opens).alias("ord"),
            F.min_by(at, close).alias("end_us"),
            F.min(close).alias("end_line"),
        )
        .where("ord IS NOT NULL")
    )


def close_at_turn_end(
    windows: DataFrame,
    turn_ends: DataFrame,
    keys=("who",),
    open_line: str = "open_line",
    end_line: str = "end_line",
    block_rows: int | None = None,
) -> DataFrame:
    """A turn's end closes whatever its participant still has open; a later own end is too late.

    Windows look up the first turn end after they open: one as-of pass over both, newest line
    first.
    """
    keys = tuple(keys)
    w = windows.select(
        *keys,
        (-F.col(open_line)).alias("_o"),
        F.lit(0).alias("_tag"),
        F.struct(*windows.columns).alias("_w"),
        F.lit(None).alias("_t"),
    )
    t = turn_ends.select(
        *keys,
        (-F.col("line_no")).alias("_o"),
        F.lit(1).alias("_tag"),
        F.lit(None).alias("_w"),
        F.struct(F.col("line_no").alias("line"), F.col("at_us").alias("at")).alias("_t"),
    )
    both = ordered(w.unionByName(t), keys, ("_o", "_tag"), block_rows).scan(_next=running_last("_t"))
    out = both.df.where("_tag = 0").select("_w.*", "_next")
    first = F.col("_next").isNotNull() & (F.col(end_line).isNull() | (F.col("_next.line") < F.col(end_line)))
    return out.select(
        *[c for c in windows.columns if c not in {"end_us", end_line}],
        F.when(first, F.col("_next.at")).otherwise(F.col("end_us")).alias("end_us"),
    )
