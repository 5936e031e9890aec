"""Running values along an order, safe for keys of any size.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts all rows of one key in one task. That
is fine until one key owns a large share of the table. Here such a key is cut into blocks of
bounded size along its order: the running value inside a block comes from a window over
``(key, block)``, and what the earlier blocks contribute is a prefix over one summary row per
block. Both parts are exact, so the split never changes a result.

How a key is found to be large: one aggregation counts rows per key (left out where the whole input is a few
megabytes). Keys above the limit are
few by construction (total / limit), and so are their cut points, which are taken from a
sample of the key's rows. The sample picks cut points only; every row is processed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelane.session import durable

BLOCK = "_blk"
# A block holds about this many rows, or total / MAX_BLOCKS where that is more, which bounds
# the number of large keys and of cut points whatever the size of the table.
BLOCK_ROWS = 1_000_000
# For rows that carry whole texts.
WIDE_BLOCK_ROWS = 50_000
MAX_BLOCKS = 50_000
SAMPLE_PER_BLOCK = 10
# An input that Catalyst takes for smaller than this is not counted first: its keys fit a task.
SMALL_BYTES = 32 << 20


@dataclass(frozen=True)
class Running:
    """One running value. ``inclusive`` says whether the current row counts."""

    kind: str
    col: Column
    inclusive: bool

    def over(self, window) -> Column:
        fn = {
            "max": F.max,
            "min": F.min,
            "sum": F.sum,
            "last": lambda c: F.last(c, ignorenulls=True),
            "first": lambda c: F.first(c, ignorenulls=True),
        }[self.kind]
        return fn(self.col).over(window)

    def summary(self, order: Column) -> Column:
        """The block's own total, from an aggregation without any sort."""
        present = F.when(self.col.isNotNull(), order)
        return {
            "max": lambda: F.max(self.col),
            "min": lambda: F.min(self.col),
            "sum": lambda: F.sum(self.col),
            "last": lambda: F.max_by(self.col, present),
            "first": lambda: F.min_by(self.col, present),
        }[self.kind]()

    def merge(self, carry: Column, inside: Column) -> Column:
        return {
            "max": lambda: F.greatest(carry, inside),
            "min": lambda: F.least(carry, inside),
            "sum": lambda: F.when(
                carry.isNotNull() | inside.isNotNull(),
                F.coalesce(carry, F.lit(0)) + F.coalesce(inside, F.lit(0)),
            ),
            "last": lambda: F.coalesce(inside, carry),
            "first": lambda: F.coalesce(carry, inside),
        }[self.kind]()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running_max(c, inclusive=False) -> Running:
    return Running("max", _col(c), inclusive)


def running_min(c, inclusive=False) -> Running:
    return Running("min", _col(c), inclusive)


def running_sum(c, inclusive=True) -> Running:
    return Running("sum", _col(c), inclusive)


def running_last(c, inclusive=False) -> Running:
    """Latest non-null value."""
    return Running("last", _col(c), inclusive)


def running_first(c, inclusive=True) -> Running:
    """Earliest non-null value."""
    return Running("first", _col(c), inclusive)


def previous(c) -> Running:
    """Value of the row before, wrapped in a struct ``v`` so that a null value survives."""
    return Running("last", F.struct(_col(c).alias("v")), False)


@dataclass(frozen=True)
class Ordered:
    """A DataFrame with a key, a total order and, where needed, a block column."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    def with_column(self, name: str, c: Column) -> "Ordered":
        return replace(self, df=self.df.withColumn(name, c))

    def scan(self, **values: Running) -> "Ordered":
        """Add one column per running value; all share one shuffle and one sort."""
        if self.split:
            return self._scan_blocks(values)
        if not self.keys:
            window = Window.partitionBy(F.col(BLOCK)).orderBy(*self.order)
        else:
            window = Window.partitionBy(*self.keys).orderBy(*self.order)
        return replace(self, df=self.df.select("*", *self._inside(values, window)))

    def _inside(self, values, window):
        for name, value in values.items():
            last = Window.currentRow if value.inclusive else -1
            yield value.over(window.rowsBetween(Window.unboundedPreceding, last)).alias(name)

    def _scan_blocks(self, values) -> "Ordered":
        df = durable(self.df)  # read twice below
        order = F.struct(*self.order)
        totals = (
            df.where(F.col(BLOCK) >= 0)
            .groupBy(*self.keys, BLOCK)
            .agg(*[v.summary(order).alias(f"_c_{n}") for n, v in values.items()])
        )
        before = Window.partitionBy(*(self.keys or (F.lit(0),))).orderBy(BLOCK)
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *[F.col(k).alias(f"_k_{k}") for k in self.keys],
            F.col(BLOCK).alias("_k_blk"),
            *[replace(v, col=F.col(f"_c_{n}")).over(before).alias(f"_c_{n}") for n, v in values.items()],
        )
        window = Window.partitionBy(*self.keys, BLOCK).orderBy(*self.order)
        inside = df.select("*", *self._inside(values, window))
        match = F.col(BLOCK) == F.col("_k_blk")
        for k in self.keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        # At most 2 * MAX_BLOCKS rows: one per block of a large key.
        joined = inside.join(F.broadcast(carry), match, "left")
        kept = [c for c in inside.columns if c not in values]
        merged = [v.merge(F.col(f"_c_{n}"), F.col(n)).alias(n) for n, v in values.items()]
        return replace(self, df=joined.select(*kept, *merged))

    def drop(self, *names: str) -> DataFrame:
        return self.df.drop(BLOCK, "_salt", *names)


def ordered(df: DataFrame, keys, order, block_rows: int | None = None, copies: bool = False) -> Ordered:
    """Put ``df`` in ``order`` within ``keys``. No keys: the whole table.

    The order must be total, unless rows that tie are interchangeable for what is scanned
    (``copies``): then ties get a random order in large keys, so that a crowd of equal rows is
    cut into blocks as well.
    """
    keys, order = tuple(keys), tuple(order)
    floor = BLOCK_ROWS if block_rows is None else block_rows
    if block_rows is None and _estimated_bytes(df) <= SMALL_BYTES:
        total_row, hot = 0, []
    elif keys:
        sizes = df.groupBy(*keys).count()
        # Only keys above the floor can be too large, so all other counts stay on executors.
        total_row, hot = _large_keys(sizes, keys, floor)
    else:
        total_row = df.count()
        hot = [((), total_row)] if total_row > floor else []
    limit = max(floor, math.ceil(total_row / MAX_BLOCKS))
    hot = [(k, n) for k, n in hot if n > limit]
    if not hot:
        return Ordered(df if keys else df.withColumn(BLOCK, F.lit(-1)), keys, order, False)
    if copies:
        df, order = df.withColumn("_salt", F.rand(11)), (*order, "_salt")
    return Ordered(_cut(df, keys, order, hot, limit), keys, order, True)


def _estimated_bytes(df: DataFrame) -> int:
    """What the optimizer expects of the input, from its files' sizes; a wrong guess costs time, never rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _large_keys(sizes: DataFrame, keys, floor):
    """Total rows and the large keys with their counts, in one job.

    One summary row plus fewer than MAX_BLOCKS keys reach the driver: the candidates are
    ordered by size and a key below total / MAX_BLOCKS is never needed.
    """
    top = (
        sizes.where(F.col("count") > floor)
        .orderBy(F.desc("count"))
        .limit(MAX_BLOCKS)
        .select(F.struct(*keys).alias("k"), "count")
    )
    found = top.collect()
    if not found:
        return 0, []
    total = sizes.agg(F.sum("count")).first()[0]
    return total, [(tuple(r["k"]), r["count"]) for r in found]


def _nulls_first(value):
    """Sort key with the order that Spark gives to structs and arrays."""
    if value is None:
        return (0,)
    if isinstance(value, (tuple, list)):
        return (1, tuple(_nulls_first(v) for v in value))
    return (1, value)


def _cut(df: DataFrame, keys, order, hot, limit) -> DataFrame:
    """Add the block column: -1 for keys that fit, else the number of cut points at or below."""
    types = {f.name: f.dataType for f in df.schema.fields}
    key_schema = T.StructType([T.StructField(f"_k_{k}", types[k]) for k in keys])
    at = F.struct(*order)
    picked = df
    if keys:
        names = df.sparkSession.createDataFrame([k for k, _ in hot], key_schema)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        picked = df.join(F.broadcast(names), same, "left_semi")
    share = min(1.0, SAMPLE_PER_BLOCK / limit)
    sample = picked.where(F.rand(7) < share).select(F.struct(*keys).alias("k") if keys else F.lit(0).alias("k"), at.alias("o"))
    points: dict[tuple, list] = {}
    for row in sample.collect():  # about SAMPLE_PER_BLOCK * MAX_BLOCKS rows at the most
        points.setdefault(tuple(row["k"]) if keys else (), []).append(row["o"])
    rows = []
    for key, n in hot:
        drawn = sorted(points.get(key, []), key=_nulls_first)
        blocks = max(2, math.ceil(n / limit))
        step = max(1, len(drawn) // blocks)
        cuts = [cut for cut, _ in groupby(drawn[step::step])]
        if not cuts:
            continue
        # Two levels, so that placing a row compares about 2 * sqrt(cuts) points.
        width = max(1, math.isqrt(len(cuts)))
        chunks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
        rows.append((*key, [c[0] for c in chunks], chunks, width))
    point = T.StructType([T.StructField(o, types[o]) for o in order])
    schema = T.StructType(
        [
            *key_schema.fields,
            T.StructField("_heads", T.ArrayType(point)),
            T.StructField("_chunks", T.ArrayType(T.ArrayType(point))),
            T.StructField("_width", T.IntegerType()),
        ]
    )
    cuts = df.sparkSession.createDataFrame(rows, schema)
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # At most MAX_BLOCKS rows with 2 * MAX_BLOCKS points between them.
    placed = df.join(F.broadcast(cuts), match, "left")
    head = F.size(F.filter("_heads", lambda p: p <= at))
    inner = F.size(F.filter(F.element_at("_chunks", F.greatest(head, F.lit(1))), lambda p: p <= at))
    block = (
        F.when(F.col("_heads").isNull(), F.lit(-1))
        .when(head == 0, F.lit(0))
        .otherwise((head - 1) * F.col("_width") + inner)
    )
    return placed.select(*df.columns, block.cast("int").alias(BLOCK))


def latest_before(
    probes: DataFrame,
    history: DataFrame,
    keys,
    probe_at: str,
    history_at: str,
    value: Column,
    seq: Column | None = None,
    strict: bool = True,
    name: str = "found",
    forward: bool = False,
    probe_id: Column | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """As-of lookup: each probe with the last history row before it (or first after it).

    One union, one shuffle by key and one sort; no pairs are formed. ``strict`` leaves out
    history at the probe's own time. Among equal times the highest ``seq`` wins.
    """
    keys = tuple(keys)
    sign = F.lit(-1) if forward else F.lit(1)
    seq = F.lit(0).cast("bigint") if seq is None else seq
    kind = history.select(seq.alias("s")).schema["s"].dataType
    tie = F.lit(0).cast("bigint") if probe_id is None else probe_id.cast("bigint")
    ks = [F.col(k) for k in keys]
    left = probes.select(
        *ks,
        (F.col(probe_at) * sign).alias("_at"),
        F.lit(0 if strict else 2).alias("_tag"),
        F.lit(None).cast(kind).alias("_seq"),
        tie.alias("_tie"),
        F.struct(*probes.columns).alias("_p"),
        F.lit(None).alias("_h"),
    )
    right = history.select(
        *ks,
        (F.col(history_at) * sign).alias("_at"),
        F.lit(1).alias("_tag"),
        seq.alias("_seq"),
        F.lit(0).cast("bigint").alias("_tie"),
        F.lit(None).alias("_p"),
        F.struct(value.alias("v")).alias("_h"),
    )
    both = left.unionByName(right)
    found = ordered(both, keys, ("_at", "_tag", "_seq", "_tie"), block_rows, copies=True).scan(_f=running_last("_h"))
    return found.df.where(F.col("_tag") != 1).select("_p.*", F.col("_f.v").alias(name))
