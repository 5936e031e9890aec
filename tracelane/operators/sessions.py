"""Filters, roll-ups and lists over sessions and their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.config import DEFAULTS, US, Params
from tracelane.functions.actions import ACTIONS, DURING, ActionFilter, action_key
from tracelane.operators.ordered import latest_before, ordered, running_sum

UNTITLED = "(untitled)"


def session_filter(df: DataFrame, participants: DataFrame, selected: DataFrame | None, you: object = "you") -> DataFrame:
    """Rows whose participant is visible; ``selected`` None shows all, an empty table none.

    The human and participants without a session always show. Only the hidden participants
    are listed, so one anti-join decides.
    """
    if selected is None:
        return df
    hidden = (
        participants.where(F.col("session").isNotNull() & (F.col("who") != F.lit(you)))
        .join(selected.select("session").distinct(), "session", "left_anti")
        .select("who")
    )
    return df.join(hidden, "who", "left_anti")


def visible_events(
    events: DataFrame,
    participants: DataFrame | None = None,
    selected: DataFrame | None = None,
    actions: ActionFilter | None = None,
    you: object = "you",
) -> DataFrame:
    """The events every read-side operator works on: session filter, then action filter."""
    out = events if actions is None else events.where(actions.matches())
    return out if participants is None else session_filter(out, participants, selected, you)


def active_participants(events: DataFrame, participants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Participants and sessions that stay while an action filter is on; ``events`` are visible ones."""
    active = participants.join(events.select("who").distinct(), "who", "left_semi")
    return active, active.where("session IS NOT NULL").select("session").distinct()


def action_facets(events: DataFrame, current: ActionFilter | None = None) -> DataFrame:
    """Events per action class, whatever the action filter says; its classes stay listed at zero.

    The filter's classes join as zero-count rows: the class list is fixed and short.
    """
    counts = events.groupBy(action_key().alias("action")).agg(F.count(F.lit(1)).alias("n"))
    keys = current.keys() if current else []
    if not keys:
        return counts
    zeros = events.sparkSession.createDataFrame([(k, 0) for k in keys], "action string, n bigint")
    return counts.unionByName(zeros).groupBy("action").agg(F.sum("n").alias("n"))


def facet_order(action: Column) -> Column:
    """Fixed classes in their order, then ``fs during`` tools by name."""
    return F.when(action.startswith(DURING), len(ACTIONS)).otherwise(
        F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), action)
    )


def time_range(
    events: DataFrame,
    spans: DataFrame | None = None,
    prompts: DataFrame | None = None,
    sessions: DataFrame | None = None,
    now_us: int | None = None,
    p: Params = DEFAULTS,
) -> DataFrame:
    """Earliest and latest time on record. A latest time close to now becomes now."""
    ends = events.agg(F.min("start_us").alias("lo"), F.max("end_us").alias("hi"))
    if spans is not None:
        ends = ends.unionByName(spans.agg(F.min("start_us").alias("lo"), F.max("end_us").alias("hi")))
    if prompts is not None:
        ends = ends.unionByName(prompts.agg(F.min("at_us").alias("lo"), F.max("at_us").alias("hi")))
    if sessions is not None:
        hi = F.max(F.greatest("start_us", "end_us"))
        ends = ends.unionByName(sessions.agg(F.min("start_us").alias("lo"), hi.alias("hi")))
    out = ends.agg(F.min("lo").alias("lo_us"), F.max("hi").alias("hi_us"))
    if now_us is None:
        return out
    recent = F.abs(F.lit(now_us) - F.col("hi_us")) <= p.now_within * US
    return out.withColumn("hi_us", F.when(recent, F.lit(now_us)).otherwise(F.col("hi_us")))


def session_rollup(records: DataFrame, start: Column | None = None) -> DataFrame:
    """One row per session from its records (session, at_us, ord, and optional cwd and flags).

    ``last_seen`` covers every participant of the session. ``start`` is the header's own time
    where the format has one, else the earliest record.
    """
    first_cwd = F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.struct("at_us", "ord")))
    return records.groupBy("session").agg(
        F.coalesce(F.min(start), F.min("at_us")).alias("start_us") if start is not None else F.min("at_us").alias("start_us"),
        F.max("at_us").alias("last_seen_us"),
        first_cwd.alias("cwd"),
        F.count_if("is_prompt").alias("n_prompts"),
        F.count_if("is_event").alias("n_events"),
        F.count_distinct(F.when(~F.col("is_main"), F.col("who"))).alias("n_subagents"),
    )


def session_end(records: DataFrame) -> DataFrame:
    """When a session ended: its last exit's time, unless anyone in it did something later.

    ``records``: session, ord (total order), is_exit, recorded_us. One aggregation, no sort.
    """
    last_exit = F.max(F.when(F.col("is_exit") & F.col("recorded_us").isNotNull(), F.struct("ord", "recorded_us")))
    last_other = F.max(F.when(~F.col("is_exit"), F.col("ord")))
    out = records.groupBy("session").agg(last_exit.alias("_x"), last_other.alias("_o"))
    ended = F.col("_x").isNotNull() & (F.col("_o").isNull() | (F.col("_x.ord") > F.col("_o")))
    return out.select("session", F.when(ended, F.col("_x.recorded_us")).alias("end_us"))


def titles(records: DataFrame) -> DataFrame:
    """The session title: the last non-empty custom title, else the first automatic one.

    ``records``: session, ord, title, title_kind ('custom' or 'auto').
    """
    named = F.coalesce(F.col("title") != "", F.lit(False))
    custom = F.max_by("title", F.when(named & (F.col("title_kind") == "custom"), F.col("ord")))
    auto = F.min_by("title", F.when(named & (F.col("title_kind") == "auto"), F.col("ord")))
    return records.groupBy("session").agg(F.coalesce(custom, auto, F.lit(UNTITLED)).alias("title"))


def recency(sessions: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Sessions ranked from 0, most recently active first, then newer start, then path."""
    keyed = sessions.withColumn("_a", -F.col("last_seen_us")).withColumn("_b", -F.col("start_us"))
    out = ordered(keyed, (), ("_a", "_b", "session"), block_rows).scan(_n=running_sum(F.lit(1).cast("bigint")))
    return out.df.select(*sessions.columns, (F.col("_n") - 1).alias("rank"))


def subagent_ordinals(participants: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Number the other participants of a session from 0 in order of appearance (``ord``)."""
    others = participants.where("session IS NOT NULL AND kind <> 'main'")
    out = ordered(others, ("session",), ("ord",), block_rows).scan(_n=running_sum(F.lit(1).cast("bigint")))
    return out.df.select(*participants.columns, (F.col("_n") - 1).alias("ordinal"))


def session_status(sessions: DataFrame, now_us: int, p: Params = DEFAULTS) -> DataFrame:
    """``live`` without a recorded end while the last record is recent; else the effective end."""
    live = F.col("end_us").isNull() & (seconds_between(F.lit(now_us), F.col("last_seen_us")) < p.live_within)
    return sessions.withColumn("status", F.when(live, "live").otherwise("ended")).withColumn(
        "shown_end_us", F.when(~live, F.coalesce("end_us", "last_seen_us"))
    )


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds of ``a - b``, truncated toward zero."""
    return F.call_function("div", a - b, F.lit(US).cast("bigint"))


def detail_items(events: DataFrame, keys, block_rows: int | None = None) -> DataFrame:
    """Every row's detail list: events newest end first, recorded order among equals; ``pos`` from 1."""
    keyed = events.withColumn("_e", -F.col("end_us"))
    out = ordered(keyed, keys, ("_e", "event_id"), block_rows).scan(pos=running_sum(F.lit(1).cast("bigint")))
    return out.drop("_e")


def row_items(spans: DataFrame, prompts: DataFrame, who: object, session: object | None = None) -> DataFrame:
    """One participant's own list: spans, and for a main its session's prompts, newest first."""
    own = spans.where(F.col("who") == F.lit(who)).select(
        F.lit("span").alias("item"), "start_us", "end_us", F.col("start_us").alias("ord")
    )
    if session is not None:
        said = prompts.where(F.col("session") == F.lit(session)).select(
            F.lit("prompt").alias("item"), F.col("at_us").alias("start_us"), F.col("at_us").alias("end_us"), F.col("at_us").alias("ord")
        )
        own = own.unionByName(said)
    return own.orderBy(F.desc("end_us"), F.desc("item"), "ord")


def row_lists(spans: DataFrame, prompts: DataFrame, mains: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``row_items`` of all participants at once: (who, item, start_us, end_us, pos), ``pos`` from 1.

    ``mains``: (session, who), the main participant whose list shows the session's prompts.
    """
    at = F.col("at_us")
    said = prompts.join(mains.select("session", "who"), "session").select("who", F.lit("prompt").alias("item"), at.alias("start_us"), at.alias("end_us"))
    both = spans.select("who", F.lit("span").alias("item"), "start_us", "end_us").unionByName(said)
    # Newest end first; a span before a prompt of the same instant.
    keyed = both.withColumns({"_e": -F.col("end_us"), "_i": (F.col("item") == "prompt").cast("int")})
    out = ordered(keyed, ("who",), ("_e", "_i", "start_us"), block_rows, copies=True).scan(pos=running_sum(F.lit(1).cast("bigint")))
    return out.drop("_e", "_i")


def nearest(items: DataFrame, probes: DataFrame, keys=("who",), block_rows: int | None = None) -> DataFrame:
    """For each probe the item closest in whole seconds; among equals the first of the detail list.

    ``items``: keys, end_us, event_id; ``probes``: keys, probe_id, at_us. Three as-of lookups
    replace the pairing of probes and items: the last item up to the probe, the first after
    it, and, as the list runs from the newest, the last item that is just as close behind.
    """
    first_at = items.groupBy(*keys, "end_us").agg(F.min("event_id").alias("event_id"))
    value = F.struct("end_us", "event_id")

    def lookup(df, at, name, **how):
        return latest_before(df, first_at, keys, at, "end_us", value, name=name, block_rows=block_rows, **how)

    out = lookup(probes, "at_us", "_b", strict=False)
    out = lookup(out, "at_us", "_a", strict=True, forward=True)
    before = seconds_between(F.col("at_us"), F.col("_b.end_us"))
    after = seconds_between(F.col("_a.end_us"), F.col("at_us"))
    ahead = F.col("_a").isNotNull() & (F.col("_b").isNull() | (after <= before))
    edge = F.when(ahead, F.col("at_us") + (after + 1) * US - 1).otherwise(F.col("at_us"))
    out = lookup(out.withColumn("_edge", edge), "_edge", "_pick", strict=False)
    return out.select(
        *probes.columns, F.col("_pick.event_id").alias("event_id"), F.col("_pick.end_us").alias("end_us")
    ).where("event_id IS NOT NULL")


def nth_activity(
    times: DataFrame, probes: DataFrame, n: int, forward: bool = True, keys=("who",), block_rows: int | None = None
) -> DataFrame:
    """The n-th distinct activity time after (before) each probe, or the farthest there is.

    Times are numbered once per key; a probe then only needs the number at its own place, and
    the target is found by equality on (key, number).
    """
    n = max(n, 1)
    distinct = times.select(*keys, F.col("at_us").alias("t")).distinct()
    numbered = ordered(distinct, keys, ("t",), block_rows).scan(i=running_sum(F.lit(1).cast("bigint"))).df
    numbered = numbered.select(*keys, "t", "i")
    last = numbered.groupBy(*keys).agg(F.max("i").alias("_last"))
    here = latest_before(
        probes, numbered, keys, "at_us", "t", F.col("i"), strict=not forward, name="_i", block_rows=block_rows
    ).join(last, list(keys))
    at = F.coalesce("_i", F.lit(0).cast("bigint"))
    if forward:
        target = F.when(at < F.col("_last"), F.least(at + n, F.col("_last")))
    else:
        target = F.when(at >= 1, F.greatest(at - n + 1, F.lit(1).cast("bigint")))
    aimed = here.withColumn("i", target).where("i IS NOT NULL")
    return aimed.join(numbered, [*keys, "i"]).select(*probes.columns, F.col("t").alias("target_us"))


def union_events(*dfs: DataFrame) -> DataFrame:
    """Events of several producers as one table; a column one lacks is NULL there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


