"""From raw file changes to attributed events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.config import DEFAULTS, US, Params
from tracelane.operators.intervals import islands
from tracelane.operators.ordered import latest_before
from tracelane.session import spread

# When changes to one path coalesce, the stronger kind stays.
MODIFIED, CREATED, REMOVED = 0, 1, 2


def strength(kind: Column) -> Column:
    return F.when(kind == "removed", REMOVED).when(kind == "created", CREATED).otherwise(MODIFIED)


def kind_of(strength: Column) -> Column:
    return F.when(strength == REMOVED, "removed").when(strength == CREATED, "created").otherwise("modified")


def coalesce_changes(
    changes: DataFrame,
    keys=("root_id", "rel"),
    at: str = "at_us",
    kind: str = "change",
    ord: str = "event_id",
    quiet_us: int | None = None,
    p: Params = DEFAULTS,
    block_rows: int | None = None,
) -> DataFrame:
    """One row per burst of changes to a path; a burst ends after a quiet period.

    Keeps the last time and the strongest kind. A burst that began with a creation and came to
    a removal leaves nothing behind and is dropped.
    """
    gap = p.debounce * US if quiet_us is None else quiet_us
    bursts = islands(changes, keys, at, (at, ord), gap, block_rows).df
    return (
        bursts.groupBy(*keys, "burst")
        .agg(
            F.max(at).alias(at),
            F.max(strength(F.col(kind))).alias("_top"),
            F.max(F.when(F.col("_first"), strength(F.col(kind)))).alias("_begin"),
            F.min(ord).alias(ord),
            F.count(F.lit(1)).alias("n_raw"),
        )
        .where(~((F.col("_begin") == CREATED) & (F.col("_top") == REMOVED)))
        .select(*keys, ord, at, kind_of(F.col("_top")).alias(kind), "n_raw")
    )


def suppress_echoes(
    changes: DataFrame,
    writes: DataFrame,
    keys=("root_id", "rel"),
    before_us: int | None = None,
    after_us: int | None = None,
    p: Params = DEFAULTS,
    block_rows: int | None = None,
) -> DataFrame:
    """Drop a change when a tool's own write to the path ended close to it.

    "Some write ended in [at - before, at + after]" holds exactly when the latest write end up
    to at + after is not older than at - before, so the range anti-join becomes one as-of
    lookup: linear in the rows even where one path has most of them.
    """
    before = p.echo_before * US if before_us is None else before_us
    after = p.echo_after * US if after_us is None else after_us
    probes = changes.withColumn("_until", F.col("at_us") + after)
    found = latest_before(
        probes, writes, keys, "_until", "end_us", F.col("end_us"), strict=False, name="_wrote", block_rows=block_rows
    )
    return found.where(F.col("_wrote").isNull() | (F.col("_wrote") < F.col("at_us") - before)).drop("_until", "_wrote")


# Aligned time blocks: a block of level n spans 4**n microseconds, so levels are bit shifts.
BITS = 2
MAX_LEVEL = 28
ANY_ROOT = -1


def _tiles(spans: DataFrame) -> DataFrame:
    """Tile each range [_lo, _hi) exactly with aligned blocks; adds ``_level`` and ``_block``.

    A level contributes its blocks inside the range whose parent block is not inside: at most
    three at either end, six at the top level. Only levels up to the range's length occur.
    """
    top = F.ceil(F.log2((F.col("_hi") - F.col("_lo")).cast("double")) / BITS).cast("int")
    per_level = spans.withColumn("_level", F.explode(F.sequence(F.lit(0), F.least(top, F.lit(MAX_LEVEL)))))

    def down(c: str, levels: str) -> Column:
        return F.expr(f"shiftright({c}, {BITS} * ({levels}))")

    def up(c: str, levels: str) -> Column:
        return F.expr(f"-shiftright(-{c}, {BITS} * ({levels}))")

    per_level = per_level.withColumns({"_a": up("_lo", "_level"), "_b": down("_hi", "_level")}).where("_a < _b")
    per_level = per_level.withColumns({"_pa": up("_a", "1"), "_pb": down("_b", "1")})
    inner = F.col("_pa") < F.col("_pb")
    per_level = per_level.withColumns(
        {
            "_a_end": F.when(inner, F.shiftleft("_pa", BITS)).otherwise(F.col("_b")),
            "_b_start": F.when(inner, F.shiftleft("_pb", BITS)).otherwise(F.col("_b")),
        }
    ).where("_a < _a_end OR _b_start < _b")
    none = F.array().cast("array<bigint>")
    left = F.when(F.col("_a") < F.col("_a_end"), F.sequence("_a", F.col("_a_end") - 1)).otherwise(none)
    right = F.when(F.col("_b_start") < F.col("_b"), F.sequence("_b_start", F.col("_b") - 1)).otherwise(none)
    return per_level.withColumn("_block", F.explode(F.concat(left, right)))


def attribute(
    changes: DataFrame,
    windows: DataFrame,
    now_us: int,
    start_slack_us: int | None = None,
    end_slack_us: int | None = None,
    p: Params = DEFAULTS,
    nullable_root: bool = False,
) -> DataFrame:
    """Give each change the tool window that most likely caused it, else nobody.

    The winner is the window with the latest start among those open at the change (with slack
    on both sides, bounds inclusive) whose root is the change's; equal starts go to the one
    recorded first (``ord``). A window without a root (``nullable_root``) fits every root.

    No pair of change and window is formed. Each window's range is tiled by aligned time
    blocks of growing size; per (root, block) only the best window is kept, by partial
    aggregation. A change then looks up the one block of each size that contains it. The rows
    involved are (windows + changes) times the number of sizes, however crowded a moment is.
    """
    slack_a = p.slack_start * US if start_slack_us is None else start_slack_us
    slack_b = p.slack_end * US if end_slack_us is None else end_slack_us
    spans = windows.select(
        F.coalesce("root_id", F.lit(ANY_ROOT)).cast("bigint").alias("_root"),
        (F.col("start_us") - slack_a).alias("_lo"),
        (F.coalesce("end_us", F.lit(now_us)) + slack_b + 1).alias("_hi"),
        F.struct(
            F.col("start_us").alias("s"),
            (-F.col("ord")).alias("o"),
            F.col("who").alias("who"),
            F.col("call_id").alias("call_id"),
        ).alias("_w"),
    ).where("_lo < _hi")
    tiles = (
        _tiles(spread(spans, "_w"))
        .groupBy("_root", "_level", "_block")
        .agg(F.max("_w").alias("_w"))
    )
    longest = spans.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 1
    levels = min(MAX_LEVEL, math.ceil(math.log2(longest) / BITS))
    roots = F.array(F.col("root_id").cast("bigint"), F.lit(ANY_ROOT).cast("bigint"))
    probes = spread(
        changes.select(
            "event_id",
            F.explode(roots).alias("_root") if nullable_root else F.col("root_id").cast("bigint").alias("_root"),
            F.col("at_us").alias("_at"),
        ),
        "event_id",
    ).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    probes = probes.select("event_id", "_root", "_level", F.expr(f"shiftright(_at, {BITS} * _level)").alias("_block"))
    best = (
        probes.join(tiles, ["_root", "_level", "_block"])
        .groupBy("event_id")
        .agg(F.max("_w").alias("_w"))
    )
    out = changes.join(best, "event_id", "left")
    return out.select(
        *changes.columns,
        F.col("_w.who").alias("window_who"),
        F.col("_w.call_id").alias("call_id"),
    )


def attributed_events(attributed: DataFrame, calls: DataFrame, you: object = "you") -> DataFrame:
    """Attributed changes as file events; a call that is unknown counts as ``bash``."""
    named = with_provenance(
        attributed.withColumn("who", F.coalesce("window_who", F.lit(you))), calls, None
    )
    has = F.col("call_id").isNotNull()
    return named.select(
        *[c for c in attributed.columns if c != "window_who"],
        "who",
        F.lit("write").alias("kind"),
        F.when(has, "window").otherwise("watcher").alias("source"),
        F.when(has, F.coalesce("tool", F.lit("bash"))).alias("tool"),
        F.col("at_us").alias("start_us"),
        F.col("at_us").alias("end_us"),
    )


def with_provenance(events: DataFrame, calls: DataFrame, replayed: DataFrame | None) -> DataFrame:
    """Events with the tool and input of their call; the transcript beats a replayed copy."""
    # Events without a call, most of them by one person, have nothing to look up.
    named = events.where("call_id IS NOT NULL")
    out = named.join(
        calls.select("who", "call_id", F.col("tool").alias("_t1"), F.col("input").alias("_i1")), ["who", "call_id"], "left"
    )
    types = {c: calls.schema[c].dataType for c in ("tool", "input")}
    rest = events.where("call_id IS NULL").select("who", "call_id", *[c for c in events.columns if c not in ("who", "call_id")], *[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    if replayed is None:
        return out.withColumnsRenamed({"_t1": "tool", "_i1": "input"}).unionByName(rest)
    copies = replayed.select("who", "call_id", F.col("tool").alias("_t2"), F.col("input").alias("_i2"))
    out = out.join(copies, ["who", "call_id"], "left")
    known = F.col("_t1").isNotNull()
    return out.select(
        *[c for c in out.columns if not c.startswith("_")],
        F.when(F.col("call_id").isNotNull(), F.coalesce("_t1", "_t2", F.lit("bash"))).alias("tool"),
        F.when(known, F.col("_i1")).otherwise(F.col("_i2")).alias("input"),
    ).unionByName(rest)


def reset_reload(events: DataFrame, who: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace what re-reading a participant's transcript will produce again.

    Tool and inferred events of the given participants go; what was seen on the file system
    (sources ``window`` and ``watcher``) cannot be read again and stays.
    """
    from_log = events.where(F.col("source").isin("tool", "inferred"))
    rest = events.where(~F.col("source").isin("tool", "inferred"))
    kept = from_log.join(who.select("who").distinct(), "who", "left_anti")
    return rest.unionByName(kept.select(*events.columns)).unionByName(fresh.select(*events.columns))


def reset_prompts(prompts: DataFrame, participants: DataFrame, who: DataFrame) -> DataFrame:
    """Prompts without those of the sessions whose main participant is re-read."""
    mains = participants.where("kind = 'main'").join(who.select("who").distinct(), "who", "left_semi")
    return prompts.join(mains.select("session").distinct(), "session", "left_anti")
