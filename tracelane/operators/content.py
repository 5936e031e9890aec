"""File contents over time: as-of lookups, de-duplication, diffs and churn."""

from __future__ import annotations

import difflib
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelane.operators.ordered import (
    latest_before,
    ordered,
    previous,
    running_last,
    running_sum,
)
from tracelane.session import spread


def asof_prev(
    probes: DataFrame, history: DataFrame, keys, probe_at: str, at: str, seq: str | None = None, block_rows: int | None = None
) -> DataFrame:
    """Each probe with the latest version strictly before it; on equal times the last recorded.

    The lookup sorts only the versions' (time, sequence); the contents join afterwards by
    equality, so a long text never sits in a sort buffer.
    """
    keys = tuple(keys)
    order = F.struct(F.col(at).alias("at"), (F.col(seq) if seq else F.lit(0).cast("bigint")).alias("seq"))
    narrow = history.select(*keys, at, *([seq] if seq else [])).distinct()
    found = latest_before(
        probes, narrow, keys, probe_at, at, order, seq=F.col(seq) if seq else None, name="_prev", block_rows=block_rows
    )
    # One version per key and order: of texts recorded at the same place the greatest.
    versions = history.groupBy(*keys, at, *([seq] if seq else [])).agg(F.max("content").alias("content")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(at).alias("_v_at"),
        (F.col(seq) if seq else F.lit(0).cast("bigint")).alias("_v_seq"),
        F.col("content").alias("prev_content"),
    )
    match = (F.col("_prev.at") == F.col("_v_at")) & F.col("_prev.seq").eqNullSafe(F.col("_v_seq"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return found.join(versions, match, "left").select(
        *probes.columns, F.col("_prev.at").alias("prev_at"), "prev_content"
    )


def dedup_states(df: DataFrame, keys, at: str, content: str, order=None, block_rows: int | None = None) -> DataFrame:
    """Rows whose content differs from the one before them in time.

    Only digests of the contents are put in order; the rows join afterwards.
    """
    place = [*keys, *(order or (at,))]
    marks = df.select(*place, F.sha2(F.col(content).cast("string"), 256).alias("_d"))
    seen = ordered(marks, keys, tuple(order or (at,)), block_rows).scan(_p=previous("_d"))
    changed = F.col("_p").isNull() | ~F.col("_p.v").eqNullSafe(F.col("_d"))
    kept = seen.df.where(changed).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(place)], F.col("_d").alias("_dd")).distinct()
    same = F.sha2(F.col(content).cast("string"), 256).eqNullSafe(F.col("_dd"))
    for i, c in enumerate(place):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    return df.join(kept, same, "left_semi")


def seed_content(snapshots: DataFrame, seed: DataFrame, at_us: int, root_id: int = 0) -> DataFrame:
    """Snapshots plus the texts found on disk in the first root when the logs were read."""
    text = seed.where((F.col("root_id") == root_id) & F.is_valid_utf8("content"))
    # Recorded before anything else: the least value of whatever the snapshots are ordered by.
    first = F.lit(0).cast("bigint") if snapshots.schema["seq"].dataType.typeName() == "long" else F.lit(None).cast(snapshots.schema["seq"].dataType)
    return snapshots.unionByName(text.withColumn("at_us", F.lit(at_us).cast("bigint")).withColumn("seq", first), allowMissingColumns=True)


def version_pairs(history: DataFrame, keys=("path",), at: str = "at", block_rows: int | None = None) -> DataFrame:
    """Consecutive versions: ``content`` with the ``prev_content`` before it, NULL at the start."""
    keys = tuple(keys)
    seen = ordered(history.select(*keys, at), keys, (at,), block_rows).scan(_p=previous(at))
    steps = seen.df.select(*keys, F.col(at), F.col("_p.v").alias("prev_at"))
    new = history.select(*keys, at, "content")
    old = history.select(*keys, F.col(at).alias("prev_at"), F.col("content").alias("prev_content"))
    return steps.join(new, [*keys, at]).join(old, [*keys, "prev_at"], "left")


# Executors need no copy of this package: the small Python part travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Unified diff with three lines of context, without file headers; NULL for equal texts."""

    def one(a, b):
        if a is None or b is None or a == b:
            return None
        lines = list(difflib.unified_diff(a.splitlines(True), b.splitlines(True), n=3))[2:]
        return "".join(s if s.endswith("\n") else s + "\n\\ No newline at end of file\n" for s in lines) or None

    return pd.Series([one(a, b) for a, b in zip(old, new)], dtype=object)


def version_diff(pairs: DataFrame, created: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``diff``. Without a previous text there is none, except that a created file is
    compared with the empty text. Equal texts are settled before Python is called.

    ``by`` names columns that tell rows apart: given, rows are spread evenly first, as
    comparing texts costs more than moving them.
    """
    pairs = spread(pairs, *by) if by else pairs
    old = F.col("prev_content")
    if created is not None:
        old = F.when(old.isNull() & created, F.lit("")).otherwise(old)
    differs = old.isNotNull() & F.col("content").isNotNull() & (old != F.col("content"))
    todo = pairs.withColumn("_old", F.when(differs, old)).withColumn("_new", F.when(differs, F.col("content")))
    return todo.withColumn("diff", unified_diff("_old", "_new")).drop("_old", "_new")


def line_churn(history: DataFrame, keys=("path",), at: str = "at", block_rows: int | None = None) -> DataFrame:
    """Lines added and removed between consecutive versions, as multisets of lines.

    Each line counts +1 for its own version and -1 for the next one, so a single aggregation
    compares all neighbours: no join of texts. The last version only serves as "before".
    """
    keys = tuple(keys)
    # The next version's time: the previous one, seen from the end.
    turned = history.select(*keys, F.col(at), (-F.col(at)).alias("_r"))
    seen = ordered(turned, keys, ("_r",), block_rows).scan(_n=previous(at))
    steps = seen.df.select(*keys, F.col(at), F.col("_n.v").alias("_next"))
    lines = history.join(steps, [*keys, at]).select(
        *keys, F.col(at).alias("_own"), "_next", F.explode(F.split("content", "\n")).alias("line")
    )
    counted = lines.groupBy(*keys, "_own", "_next", "line").agg(F.count(F.lit(1)).alias("n"))
    first = seen.df.groupBy(*keys).agg(F.min(at).alias("_first"))
    sides = F.array(
        F.struct(F.col("_own").alias("v"), F.col("n").alias("n")), F.struct(F.col("_next").alias("v"), (-F.col("n")).alias("n"))
    )
    signed = counted.select(*keys, "line", F.explode(sides).alias("s")).where("s.v IS NOT NULL")
    diff = signed.groupBy(*keys, F.col("s.v").alias(at), "line").agg(F.sum("s.n").alias("d"))
    churn = diff.groupBy(*keys, at).agg(
        F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed")
    )
    return churn.join(first, list(keys)).where(F.col(at) > F.col("_first")).drop("_first")


HUNK = r"\A@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
NUMBERED = r"\A([-+ ])\s*(\d{1,18})\|(.*)\z"
FACTS = ("event_id", "hunk", "op", "old_line", "new_line", "text", "pos")


def _lines(events: DataFrame, text: str) -> DataFrame:
    body = F.regexp_replace(F.col(text), r"\r?\n\z", "")
    return events.where(F.col(text).isNotNull() & (F.col(text) != "")).select(
        "event_id", F.posexplode(F.split(body, r"\r?\n")).alias("pos", "line")
    )


def unified_lines(events: DataFrame, text: str = "diff", block_rows: int | None = None) -> DataFrame:
    """Facts per line of unified diffs: hunk number, op, position in the old and in the new text.

    Context moves both positions, a removed line the old one, an added line the new one. The
    positions are running counts over the event's lines, less the counts at the hunk's header.
    """
    line, first = F.col("line"), F.substring("line", 1, 1)
    is_head = line.rlike(HUNK)
    op = F.when(is_head, None).when(first.isin("+", "-"), first).when(first.isin("", " "), " ")
    lines = _lines(events, text).withColumn("op", op).withColumn("_head", is_head)

    def count(*ops):
        return running_sum(F.coalesce(F.col("op").isin(*ops), F.lit(False)).cast("bigint"), inclusive=False)

    start = F.struct(
        F.regexp_extract("line", HUNK, 1).alias("o"),
        F.regexp_extract("line", HUNK, 2).alias("n"),
        F.col("_o").alias("o0"),
        F.col("_n").alias("n0"),
    )
    seen = (
        ordered(lines, ("event_id",), ("pos",), block_rows)
        .scan(hunk=running_sum(F.col("_head").cast("bigint")), _o=count("-", " "), _n=count("+", " "))
        .with_column("_o", F.coalesce("_o", F.lit(0).cast("bigint")))
        .with_column("_n", F.coalesce("_n", F.lit(0).cast("bigint")))
        .with_column("_start", F.when(F.col("_head"), start))
        .scan(_at=running_last("_start", inclusive=True))
    )
    at = F.col("_at")
    return seen.df.where("hunk > 0 AND op IS NOT NULL").select(
        "event_id",
        "hunk",
        "op",
        (at["o"].cast("bigint") + F.col("_o") - at["o0"]).alias("old_line"),
        (at["n"].cast("bigint") + F.col("_n") - at["n0"]).alias("new_line"),
        F.substring("line", 2, 1 << 30).alias("text"),
        "pos",
    )


def patch_text(hunks: Column) -> Column:
    """Structured hunks (oldStart, oldLines, newStart, newLines, lines) as unified text."""

    def one(h):
        head = F.format_string("@@ -%d,%d +%d,%d @@\n", h["oldStart"], h["oldLines"], h["newStart"], h["newLines"])
        return F.concat(head, F.array_join(F.transform(h["lines"], lambda s: F.concat(s, F.lit("\n"))), ""))

    return F.coalesce(F.array_join(F.transform(hunks, one), ""), F.lit(""))


def numbered_lines(events: DataFrame, text: str = "diff", block_rows: int | None = None) -> DataFrame:
    """The same facts from numbered edit lines ``<mark><number>|<text>``.

    Context and removals carry old numbers, additions new ones. The new position minus the old
    one is, at every line, the additions minus the removals before it, so each line's two
    positions follow from its number and one running sum. A hunk starts after a blank line and
    where the position does not follow on. Hunks of context alone are left out; an event with a
    line of another shape, or a position below one, gives nothing.
    """
    mark = F.regexp_extract("line", NUMBERED, 1)
    lines = _lines(events, text).select(
        "event_id",
        "pos",
        "line",
        F.when(mark != "", mark).alias("op"),
        F.nullif(F.regexp_extract("line", NUMBERED, 2), F.lit("")).cast("bigint").alias("num"),
        F.regexp_extract("line", NUMBERED, 3).alias("text"),
    )
    moved = F.when(F.col("op") == "+", 1).when(F.col("op") == "-", -1).otherwise(0).cast("bigint")
    shifted = (
        ordered(lines, ("event_id",), ("pos",), block_rows)
        .scan(_s=running_sum(moved, inclusive=False))
        .with_column("_s", F.coalesce("_s", F.lit(0).cast("bigint")))
        .with_column("old_line", F.when(F.col("op") == "+", F.col("num") - F.col("_s")).otherwise(F.col("num")))
        .with_column("new_line", F.col("old_line") + F.col("_s"))
        .with_column("_next", F.col("old_line") + F.when(F.col("op") == "+", 0).otherwise(1))
        .scan(_p=previous("_next"))
        .with_column("_new", F.col("op").isNotNull() & ~F.col("old_line").eqNullSafe(F.col("_p.v")))
        .scan(hunk=running_sum(F.col("_new").cast("bigint")))
        .df
    )
    bad_line = (F.col("line") != "") & (F.col("op").isNull() | (F.least("num", "old_line", "new_line") < 1))
    bad = shifted.where(bad_line).select("event_id").distinct()
    changed = shifted.where("op IN ('+', '-')").select("event_id", "hunk").distinct()
    return (
        shifted.where("op IS NOT NULL")
        .join(bad, "event_id", "left_anti")
        .join(changed, ["event_id", "hunk"], "left_semi")
        .select(*FACTS)
    )


def first_changed_line(facts: DataFrame, numbered: bool = False) -> DataFrame:
    """Per event the line of its first change, in the new text's numbering (the line's own
    number for numbered edits)."""
    is_change = F.col("op").isin("+", "-")
    if numbered:
        line = F.when(F.col("op") == "+", F.col("new_line")).otherwise(F.col("old_line"))
    else:
        # What looks like a file header never counts.
        header = ((F.col("op") == "+") & F.col("text").startswith("++")) | (
            (F.col("op") == "-") & F.col("text").startswith("--")
        )
        is_change = is_change & ~header
        line = F.greatest("new_line", F.lit(1))
    return facts.where(is_change).groupBy("event_id").agg(F.min_by(line, F.col("pos")).alias("first_line"))


def churn(facts: DataFrame, events: DataFrame) -> DataFrame:
    """Lines added and removed per path and day."""
    counts = facts.groupBy("event_id").agg(F.count_if(F.col("op") == "+").alias("a"), F.count_if(F.col("op") == "-").alias("r"))
    day = F.to_date(F.timestamp_micros("end_us"))
    return (
        counts.join(events.select("event_id", "rel", day.alias("day")), "event_id")
        .groupBy("rel", "day")
        .agg(F.sum("a").alias("added"), F.sum("r").alias("removed"))
    )
