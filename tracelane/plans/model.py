"""From raw records to the canonical tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.config import DEFAULTS, US, Params
from tracelane.functions import paths as P
from tracelane.operators import sessions as Q
from tracelane.operators.intervals import merge_intervals, union_intervals
from tracelane.operators.ordered import ordered, running_sum
from tracelane.operators.pairing import close_at_turn_end, open_close
from tracelane.operators.roots import root_prefixes
from tracelane.schemas import FILE_EVENTS
from tracelane.session import merged, staged
from tracelane.sources import claude, codex, omp, participants, raw, touches

EVENT_ORDER = ("start_us", "end_us", "who", "line_no", "ord", "_n")


@dataclass(frozen=True)
class Tables:
    """The canonical tables (see ``schemas``)."""

    participants: DataFrame
    sessions: DataFrame
    file_events: DataFrame
    raw_intervals: DataFrame
    spans: DataFrame
    prompts: DataFrame
    tool_windows: DataFrame
    calls: DataFrame
    snapshots: DataFrame

    def items(self):
        return [(name, getattr(self, name)) for name in self.__dataclass_fields__]


def sessions_of(facts: DataFrame) -> DataFrame:
    """Session rows from the formats' facts: header, titles, exits, last activity of anyone."""
    main = F.col("is_main")
    order = F.struct(F.coalesce("at_us", "recorded_us").alias("t"), "who", "line_no")

    def header(c, pick):
        return pick(c, F.when(main & F.col(c).isNotNull(), F.col("line_no")))

    base = facts.groupBy("harness", "session").agg(
        F.coalesce(header("header_us", F.max_by), F.min("at_us")).alias("start_us"),
        F.max("at_us").alias("last_seen_us"),
        header("id", F.max_by).alias("id"),
        header("cwd", F.min_by).alias("first_cwd"),
        header("cwd", F.max_by).alias("last_cwd"),
    )
    ends = Q.session_end(facts.select("session", order.alias("ord"), "is_exit", "recorded_us"))
    named = facts.where(main).select("session", F.col("line_no").alias("ord"), "title", "title_kind")
    out = base.join(merged(ends), "session", "left").join(merged(Q.titles(named)), "session", "left")
    # One format rewrites its header's folder when a session moves; the others drift later on.
    cwd = F.when(F.col("harness") == "omp", F.col("last_cwd")).otherwise(F.col("first_cwd"))
    return out.select(
        "harness",
        "session",
        F.coalesce("id", P.stem(F.col("session"))).alias("id"),
        F.coalesce("title", F.lit(Q.UNTITLED)).alias("title"),
        cwd.alias("cwd"),
        "start_us",
        "end_us",
        "last_seen_us",
        F.col("session").alias("main"),
    )


def main_prompts(typed: DataFrame, known: DataFrame) -> DataFrame:
    """Prompts are what was typed in a session's main transcript."""
    mains = known.where("is_main AND session IS NOT NULL").select("who", "session")
    return typed.join(merged(mains), "who").select("session", "at_us")


def file_events(events: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Events numbered by (start, end, transcript, line, position): the same on every run."""
    tie = F.xxhash64("scope", "rel", "kind", "source", "tool", "call_id", "detail.type", "detail.moved_to")
    keyed = events.withColumn("ord", F.coalesce("ord", F.lit(0))).withColumn("_n", tie)
    numbered = ordered(keyed, (), EVENT_ORDER, block_rows).scan(event_id=running_sum(F.lit(1).cast("bigint")))
    names = [c.split()[0] for c in FILE_EVENTS.split(", ")]
    return numbered.df.select(*names)


def build(
    records: DataFrame,
    roots: DataFrame,
    aliases: DataFrame | None = None,
    labels: DataFrame | None = None,
    title_index: DataFrame | None = None,
    session_roots: tuple[str, ...] = (),
    p: Params = DEFAULTS,
    block_rows: int | None = None,
    targets: DataFrame | None = None,
) -> Tables:
    """All canonical tables of the transcripts launched in ``roots``.

    ``targets`` says what shell commands address: who, call_id, target, access, ord.

    ``records`` is the union of what the readers gave. What several tables are made from is
    staged: the parsed records once, by format and class, then the narrow tables of calls and
    touches. The rest is lazy; save the tables (``sources.store``) before reading them often.
    """
    records = staged(raw.classify(records), "harness", "class")
    people = participants.omp_participants(records).unionByName(participants.claude_participants(records, labels))
    people = people.unionByName(participants.codex_participants(records))
    projects = raw.assign_projects(records, roots, aliases)
    # Sessions launched in a known root, with their helpers; everything else is left out.
    people = staged(people.join(projects.select(F.col("file").alias("session")).distinct(), "session", "left_semi"))
    prefixes = root_prefixes(roots, aliases)
    first = roots.orderBy("root_id").select("path").first()  # one row per checkout
    default_cwd = first["path"] if first else "/"

    # Who someone is joins the narrow tables made from the records, never the records.
    known = people.select("harness", "who", "session", (F.col("kind") == "main").alias("is_main"))
    told = records.drop("project_dir").withColumnRenamed("file", "who")
    by_format = {h: told.where(F.col("harness") == h).drop("harness") for h in ("omp", "claude", "codex")}
    o, c = by_format["omp"], by_format["claude"]
    x = codex.timed(raw.of_class(by_format["codex"], *raw.CLASSES["codex"]), participants.codex_headers(records))
    x = staged(x.join(known.select("who", "session", "is_main"), "who"))

    facts = omp.session_facts(o).unionByName(claude.session_facts(c)).unionByName(codex.session_facts(x))
    sessions = sessions_of(facts.join(merged(known), "who").where("session IS NOT NULL"))
    if title_index is not None:
        listed = title_index.select("id", F.col("title").alias("_t"))
        own = F.when(F.col("harness") == "codex", F.col("_t"))
        sessions = sessions.join(listed, "id", "left").withColumn("title", F.coalesce(own, "title")).drop("_t")
    sessions = staged(sessions)
    project_dir = F.regexp_replace("session", r"/[^/]*\z", "")
    cwds = sessions.select(
        "session", F.coalesce("cwd", F.when(F.col("harness") == "omp", project_dir), F.lit(default_cwd)).alias("cwd")
    )

    def at_home(calls):
        return staged(calls.join(known.select("who", "session"), "who").join(cwds, "session", "left"))

    o_calls = at_home(omp.calls(staged(omp.call_records(o)), block_rows))
    c_calls = at_home(claude.calls(c, block_rows))
    said = omp.touches(o_calls, p, targets).unionByName(claude.touches(c_calls, targets)).unionByName(codex.touches(x, cwds, default_cwd, targets))
    events, snapshots = touches.resolve(staged(said), prefixes, sessions, session_roots, p)
    events, snapshots = staged(events), staged(snapshots)

    ops = omp.window_ops(o_calls).unionByName(claude.window_ops(c_calls))
    windows = open_close(ops, block_rows=block_rows).drop("end_line")
    x_windows = open_close(codex.window_records(x).select("who", "call_id", "line_no", "at_us", "op"), block_rows=block_rows)
    ends = codex.turn_ends(x).withColumn("line_no", F.col("line_no") * 2)
    x_windows = close_at_turn_end(x_windows, ends, open_line="ord", block_rows=block_rows)
    names = ["who", "call_id", "start_us", "end_us", "ord"]

    intervals = union_intervals(
        omp.raw_intervals(o, o_calls), claude.raw_intervals(c, c_calls, block_rows), codex.raw_intervals(x, block_rows)
    )
    intervals = intervals.join(known.select("who"), "who", "left_semi")
    typed = omp.prompts(o).unionByName(claude.prompts(c)).unionByName(codex.prompts(x))
    return Tables(
        participants=people,
        sessions=sessions,
        file_events=file_events(events, block_rows),
        raw_intervals=intervals,
        spans=merge_intervals(intervals, ("who",), gap=p.idle_gap * US, block_rows=block_rows).drop("n_intervals"),
        prompts=main_prompts(typed, known),
        tool_windows=windows.select(*names).unionByName(x_windows.select(*names)),
        calls=omp.call_table(o_calls).unionByName(claude.call_table(c_calls)).unionByName(codex.call_table(x)),
        snapshots=snapshots,
    )


def read_all(
    spark: SparkSession, omp_root: str | None = None, claude_root: str | None = None, codex_root: str | None = None
) -> DataFrame:
    """Records of all transcript folders that are given."""
    parts = [reader(spark, root) for reader, root in ((raw.read_omp, omp_root), (raw.read_claude, claude_root)) if root]
    if codex_root:
        parts.append(raw.read_codex(spark, codex_root, check_headers=False))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def windows_with_roots(tables: Tables, roots: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Tool windows with the root their session works in, as attribution needs them."""
    from tracelane.operators.roots import project_rel

    where = tables.participants.select("who", "session").join(tables.sessions.select("session", "cwd"), "session")
    placed = project_rel(where, root_prefixes(roots, aliases), "cwd").select("who", "root_id")
    return tables.tool_windows.join(placed, "who", "left")
