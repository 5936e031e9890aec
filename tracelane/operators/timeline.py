"""The time grid: columns, collapsed idle runs, zoom choice, rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.config import DEFAULTS, US, Params
from tracelane.functions.num import floor_div
from tracelane.operators.ordered import latest_before, ordered, running_max, running_sum
from tracelane.operators.tree import prefixes


def grid_col(at_us: Column, width_s) -> Column:
    """Grid column of a time; floors, so times before the epoch work too."""
    return floor_div(floor_div(at_us, US), width_s)


def time_grid(df: DataFrame, width_s: int, at: str = "at_us") -> DataFrame:
    return df.withColumn("grid", grid_col(F.col(at), width_s))


def idle_gaps(
    activity: DataFrame,
    width,
    keys=(),
    start: str = "start_s",
    end: str = "end_s",
    p: Params = DEFAULTS,
    block_rows: int | None = None,
) -> DataFrame:
    """Idle runs of at least ``min_gap_cols`` grid columns: ``[first, end)``.

    ``width`` is seconds, or the name of a key column that holds them. ``removed_before`` is
    how many columns the earlier gaps take out of the display. Activity is first reduced to
    the last column reached per starting column, so the sort sees at most one row per column.
    """
    w = F.col(width) if isinstance(width, str) else F.lit(width).cast("bigint")
    keys = tuple(keys)
    reach = (
        activity.select(*keys, floor_div(start, w).alias("a"), floor_div(end, w).alias("b"))
        .groupBy(*keys, "a")
        .agg(F.max("b").alias("b"))
    )
    seen = ordered(reach, keys, ("a",), block_rows).scan(prev=running_max("b"))
    size = F.col("a") - F.col("prev") - 1
    gaps = seen.df.where(size >= p.min_gap_cols).select(
        *keys, (F.col("prev") + 1).alias("first"), F.col("a").alias("end"), (size - p.break_cols).alias("_cut")
    )
    return (
        ordered(gaps, keys, ("first",), block_rows)
        .scan(_before=running_sum("_cut", inclusive=False))
        .df.select(*keys, "first", "end", F.coalesce("_before", F.lit(0)).alias("removed_before"))
    )


def display_cols(grid: DataFrame, gaps: DataFrame, p: Params = DEFAULTS, block_rows: int | None = None) -> DataFrame:
    """Display column ``d`` of each distinct grid column ``g``."""
    cols = grid.select("g").distinct()
    info = F.struct("first", "end", "removed_before")
    placed = latest_before(cols, gaps, (), "g", "first", info, strict=False, name="gap", block_rows=block_rows)
    g, gap = F.col("g"), F.col("gap")
    left = gap["first"] - gap["removed_before"]
    inside = (
        F.when(g == gap["first"], left)
        .when(g == gap["end"] - 1, left + p.break_cols - 1)
        .otherwise(left + 1)
    )
    after = g - gap["removed_before"] - (gap["end"] - gap["first"] - p.break_cols)
    return placed.select("g", F.when(gap.isNull(), g).when(g < gap["end"], inside).otherwise(after).alias("d"))


def column_ranges(
    cols: DataFrame, gaps: DataFrame, width_s: int, p: Params = DEFAULTS, block_rows: int | None = None
) -> DataFrame:
    """What each display column ``d`` shows: 'time', 'pad' or 'break', and its seconds."""
    wanted = cols.select("d").distinct()
    shown = gaps.withColumn("_d", F.col("first") - F.col("removed_before"))
    info = F.struct("first", "end", "removed_before", "_d")
    placed = latest_before(wanted, shown, (), "d", "_d", info, strict=False, name="gap", block_rows=block_rows)
    gap, d = F.col("gap"), F.col("d")
    at = d - gap["_d"]
    plain = F.coalesce(d + gap["removed_before"] + (gap["end"] - gap["first"] - p.break_cols), d)
    kind = F.when(at.isin(0, p.break_cols - 1), "pad").when((at > 0) & (at < p.break_cols - 1), "break").otherwise("time")
    one = F.when(at == 0, gap["first"]).when(at == p.break_cols - 1, gap["end"] - 1).otherwise(plain)
    first = F.when(F.col("type") == "break", gap["first"]).otherwise(one)
    end = F.when(F.col("type") == "break", gap["end"]).otherwise(one + 1)
    return placed.withColumn("type", kind).select(
        "d", "type", (first * width_s).alias("start_s"), (end * width_s).alias("end_s")
    )


def fit_width(
    activity: DataFrame,
    lo: int | None,
    hi: int | None,
    n_cols: int,
    p: Params = DEFAULTS,
    collapse: bool = True,
    block_rows: int | None = None,
) -> DataFrame:
    """The finest width that shows ``[lo, hi]`` in ``n_cols`` columns, else the coarsest.

    All widths are tried at once: the activity is reduced to grid columns per width, and the
    gaps of every width come from one pass keyed by width. ``lo``/``hi`` default to the ends
    of the activity.
    """
    room = max(0, max(n_cols, 1) - 1 - p.right_margin)
    ends = activity.agg(F.min("start_s").alias("lo"), F.max("end_s").alias("hi"))
    if lo is not None:
        ends = ends.withColumn("lo", F.lit(lo).cast("bigint"))
    if hi is not None:
        ends = ends.withColumn("hi", F.lit(hi).cast("bigint"))
    # One row per width: sixteen rows in all.
    per_width = ends.select("lo", "hi", F.explode(F.array(*[F.lit(w).cast("bigint") for w in p.widths])).alias("w"))
    per_width = per_width.select(
        "w", floor_div("lo", F.col("w")).alias("g_lo"), floor_div("hi", F.col("w")).alias("g_hi")
    )
    if collapse:
        # Of equal starts only the latest end can matter, whatever the width.
        spread = activity.groupBy("start_s").agg(F.max("end_s").alias("end_s")).select(
            "start_s", "end_s", F.explode(F.array(*[F.lit(w).cast("bigint") for w in p.widths])).alias("w")
        )
        gaps = idle_gaps(spread, "w", ("w",), p=p, block_rows=block_rows)
        size = F.col("end") - F.col("first")

        def removed(g: Column) -> Column:
            whole = size - p.break_cols
            part = (
                F.when(g == F.col("first"), 0)
                .when(g == F.col("end") - 1, whole)
                .otherwise(g - F.col("first") - 1)
            )
            cut = F.when(g >= F.col("end"), whole).when(g >= F.col("first"), part).otherwise(0)
            return F.coalesce(F.sum(F.when(F.col("first").isNotNull(), cut)), F.lit(0))

        taken = per_width.join(gaps, "w", "left").groupBy("w", "g_lo", "g_hi").agg(
            removed(F.col("g_lo")).alias("r_lo"), removed(F.col("g_hi")).alias("r_hi")
        )
    else:
        taken = per_width.withColumn("r_lo", F.lit(0)).withColumn("r_hi", F.lit(0))
    shown = (F.col("g_hi") - F.col("r_hi")) - (F.col("g_lo") - F.col("r_lo"))
    return taken.agg(
        F.coalesce(F.min(F.when(shown <= room, F.col("w"))), F.lit(max(p.widths)).cast("bigint")).alias("width")
    )


def dyadic_cells(first: Column, last: Column) -> Column:
    """The aligned cells that make up the columns ``first`` to ``last``: structs (level, cell), 2^level columns each, two per level at most."""
    end = last + 1

    def at(level: Column) -> Column:
        lo = -F.call_function("shiftright", -first, level)  # rounded up
        hi = F.call_function("shiftright", end, level)
        cell = lambda odd, index: F.when((odd.bitwiseAND(F.lit(1)) == 1) & (lo < hi), F.struct(level.alias("level"), index.alias("cell")))
        return F.array_compact(F.array(cell(lo, lo), cell(hi, hi - 1)))

    top = F.floor(F.log2((end - first).cast("double"))).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), top), at))


def cover(df: DataFrame, width_s: int, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """The cells (``level``, ``cell``) of each interval: about twice the logarithm of the columns it touches.

    Touching a column's start counts. What is said per cell holds for all of its columns, so results are reduced per
    cell first and spread over the columns that are shown at the end (``shown_columns``).
    """
    cells = dyadic_cells(grid_us(F.col(start), width_s), grid_us(F.col(end), width_s))
    return df.select("*", F.inline(cells))


def shown_columns(cells: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """``bucket`` instead of ``level`` and ``cell``: the columns of each cell, of those from ``first`` to ``last`` only."""
    lo = F.call_function("shiftleft", F.col("cell"), F.col("level"))
    hi = F.call_function("shiftleft", F.col("cell") + 1, F.col("level")) - 1
    if first is not None:
        lo = F.greatest(lo, F.lit(first).cast("bigint"))
    if last is not None:
        hi = F.least(hi, F.lit(last).cast("bigint"))
    named = cells.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi")
    return named.withColumn("bucket", F.explode(F.sequence("_lo", "_hi"))).drop("level", "cell", "_lo", "_hi")


def overlap_counts(df: DataFrame, keys, who: str, width_s: int) -> DataFrame:
    """Per grid column and key: intervals that touch it (``n``) and different ``who`` among them (``people``)."""
    cells = cover(df.select(*keys, who, "start_us", "end_us"), width_s).groupBy(*keys, who, "level", "cell").agg(F.count(F.lit(1)).alias("n"))
    per_who = shown_columns(cells).groupBy(*keys, who, "bucket").agg(F.sum("n").alias("n"))
    return per_who.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.count(who).alias("people"))


def overlap_totals(df: DataFrame, width_s: int, first: int, last: int) -> DataFrame:
    """Intervals that touch each shown column: one row per cell until the columns are shown."""
    cells = cover(df.select("start_us", "end_us"), width_s).groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n"))
    return shown_columns(cells, first, last).groupBy("bucket").agg(F.sum("n").alias("n"))


def grid_us(at_us: Column, width_s: int) -> Column:
    """Grid column at full precision (for overlap tests, which compare microseconds)."""
    return floor_div(at_us, width_s * US)


def gantt_nodes(events: DataFrame, width_s: int, leaf=("rel",), nodes: Column | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Who a raster cell shows per (node, column): the last write's author, else the last read's; of equal ends the earliest event's.

    ``nodes`` is the array of nodes that an event counts for, a function of its ``leaf`` columns: by default every ancestor of its path.
    Events are reduced to one winner per leaf and dyadic cell, only winners are spread over the nodes, and only winners of
    a node over the columns shown. So neither a long event nor a node that owns most events costs more than a few rows per map task.
    """
    nodes = prefixes(F.split("rel", "/")) if nodes is None else nodes
    is_write = (F.col("kind") == "write").cast("int")
    rank = F.struct(is_write.alias("w"), F.col("end_us").alias("e"), (-F.col("event_id")).alias("i"), "who")
    best = F.max("_r").alias("_r")
    leaves = cover(events.select(*leaf, "start_us", "end_us", rank.alias("_r")), width_s).groupBy(*leaf, "level", "cell").agg(best)
    cells = leaves.select(F.explode(nodes).alias("node"), "level", "cell", "_r").groupBy("node", "level", "cell").agg(best)
    top = shown_columns(cells, first, last).groupBy("node", "bucket").agg(best)
    return top.select("node", "bucket", F.col("_r.who").alias("who"), F.col("_r.w").alias("is_write"))


# What a lane cell shows, strongest last.
MARK_CHILD, MARK_ACTIVE, MARK_PROMPT = 1, 2, 3


def gantt_lanes(
    spans: DataFrame,
    prompts: DataFrame,
    you_events: DataFrame,
    participants: DataFrame,
    width_s: int,
    you: object = "you",
    filtered: bool = False,
    first: int | None = None,
    last: int | None = None,
) -> DataFrame:
    """Strongest mark per (row, column), of the columns from ``first`` to ``last`` only.

    ``you`` shows a prompt over an own event; an agent shows its own span; a session's main
    row shows a child mark where another participant of the session was active. While an
    action filter is on, pass events as ``spans`` (with ``you`` among them): prompts then do
    not show.
    """
    at = ["level", "cell"]
    own = cover(spans.select("who", "start_us", "end_us"), width_s).select("who", *at).distinct()
    mark = lambda who, value: F.struct(who.alias("who"), F.lit(value).alias("mark"))
    child = F.when(F.col("main") != F.col("who"), mark(F.col("main"), MARK_CHILD))
    both = own.join(participants.select("who", "main"), "who", "left")
    marks = both.select(*at, F.inline(F.array_compact(F.array(mark(F.col("who"), MARK_ACTIVE), child)))).select("who", *at, "mark")
    if not filtered:
        mine = cover(you_events.select("start_us", "end_us"), width_s)
        asked = grid_us(F.col("at_us"), width_s).alias("cell")
        marks = marks.unionByName(mine.select(F.lit(you).alias("who"), *at, F.lit(MARK_ACTIVE).alias("mark"))).unionByName(
            prompts.select(F.lit(you).alias("who"), F.lit(0).alias("level"), asked, F.lit(MARK_PROMPT).alias("mark"))
        )
    strongest = F.max("mark").cast("bigint").alias("mark")
    return shown_columns(marks.groupBy("who", *at).agg(strongest), first, last).groupBy("who", "bucket").agg(strongest)
