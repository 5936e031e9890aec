"""The common shape of what the transcript formats say about files.

A touch still carries the path argument as the tool gave it (``raw``), or a final ``scope`` and
``rel`` where no lookup is needed. ``old_text``/``new_text`` are contents known at its start
and end; ``to_raw`` is where a move went.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.config import DEFAULTS, Params
from tracelane.operators.roots import locate
from tracelane.schemas import DETAIL, SOURCES

FIELDS = {
    "who": "string",
    "session": "string",
    "cwd": "string",
    "raw": "string",
    "scope": "string",
    "rel": "string",
    "kind": "string",
    "source": "string",
    "tool": "string",
    "start_us": "bigint",
    "end_us": "bigint",
    "call_id": "string",
    "line_no": "bigint",
    "ord": "bigint",
    "detail": DETAIL,
    "old_text": "string",
    "new_text": "string",
    "to_raw": "string",
}
CARRIED = ("who", "session", "cwd", "start_us", "end_us", "call_id", "line_no")


def detail(kind: str | Column, **fields: Column) -> Column:
    """An event's detail; fields: diff, content, moved_to, fs_change, sources."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    types = {"diff": "string", "content": "string", "moved_to": "string", "fs_change": "string", "sources": SOURCES}
    parts = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]
    return F.struct(kind.alias("type"), *parts)


def touch(df: DataFrame, kind: str, tool: str | Column, source: str = "tool", **fields) -> DataFrame:
    """Rows in the common shape from a calls table; ``fields`` fill the other columns."""
    given = {"kind": F.lit(kind) if isinstance(kind, str) else kind, "source": F.lit(source)}
    given["tool"] = F.lit(tool) if isinstance(tool, str) else tool
    given.setdefault("detail", detail("none"))
    given |= fields
    for name in CARRIED:
        given.setdefault(name, F.col(name))
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])


def inferred(calls: DataFrame, targets: DataFrame | None) -> DataFrame | None:
    """What the shell commands of finished calls address, failed ones included.

    ``targets``: who, call_id, target, access, ord; what a command addresses is an input here.
    """
    if targets is None:
        return None
    named = targets.select("who", "call_id", "target", "access", F.col("ord").cast("bigint").alias("ord"))
    found = calls.select(*CARRIED).join(named, ["who", "call_id"])
    return touch(found, F.col("access"), F.lit(None).cast("string"), "inferred", scope=F.lit("remote"), rel=F.col("target"), ord=F.col("ord"))


def mcp_touch(df: DataFrame, server: Column, tool: Column) -> DataFrame:
    return touch(df, "read", "mcp", scope=F.lit("mcp"), rel=F.concat(server, F.lit("/"), tool))


def one_line(c: Column) -> Column:
    return F.translate(c, "\n\r", "  ")


def recorded(line: Column, ord: Column, side: Column, who: Column, live: int = 0) -> Column:
    """Place of a text among those recorded: transcripts first, by line, position, side and writer."""
    return F.struct(
        F.lit(live).alias("live"),
        line.cast("bigint").alias("line"),
        F.coalesce(ord, F.lit(0)).cast("bigint").alias("ord"),
        side.cast("int").alias("side"),
        F.coalesce(who, F.lit("")).alias("who"),
    )


def union(parts: list[DataFrame | None]) -> DataFrame:
    parts = [x for x in parts if x is not None]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def resolve(
    touches: DataFrame,
    prefixes: DataFrame,
    sessions: DataFrame,
    session_roots: tuple[str, ...] = (),
    p: Params = DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """File events (without ids) and snapshots.

    Touches whose path cannot be placed are dropped. A move is kept if its destination can be
    placed too.
    """
    keep = [c for c in FIELDS if c not in ("scope", "rel")]
    direct = touches.where("scope IS NOT NULL").withColumns(
        {"root_id": F.lit(None).cast("bigint"), "scope_session": F.when(F.col("scope") == "session", F.col("session"))}
    )
    todo = touches.where("scope IS NULL AND raw IS NOT NULL").select(*keep)
    placed = locate(todo, prefixes, sessions, session_roots, p).where("scope IS NOT NULL")
    placed = placed.withColumn("root_id", F.col("root_id").cast("bigint"))
    stay = placed.where("to_raw IS NULL")
    moved = placed.where("to_raw IS NOT NULL").withColumnsRenamed(
        {"scope": "_m_scope", "root_id": "_m_root", "scope_session": "_m_owner", "rel": "_m_rel"}
    )
    moved = locate(moved, prefixes, sessions, session_roots, p, raw="to_raw").where("scope IS NOT NULL")
    moved = moved.withColumn("detail", detail("moved", moved_to=F.col("rel"))).drop("scope", "root_id", "scope_session", "rel")
    moved = moved.withColumnsRenamed({"_m_scope": "scope", "_m_root": "root_id", "_m_owner": "scope_session", "_m_rel": "rel"})
    columns = [*FIELDS, "root_id", "scope_session"]
    events = union([direct.select(*columns), stay.select(*columns), moved.select(*columns)])
    key = F.when(F.col("scope") == "project", F.concat(F.lit("p"), F.col("root_id").cast("string"))).otherwise("other")
    states = F.array(
        F.struct(F.col("start_us").alias("at_us"), F.col("old_text").alias("content"), F.lit(0).alias("side")),
        F.struct(F.col("end_us").alias("at_us"), F.col("new_text").alias("content"), F.lit(1).alias("side")),
    )
    snapshots = (
        events.where("old_text IS NOT NULL OR new_text IS NOT NULL")
        .select(key.alias("scope_key"), "rel", "line_no", "ord", "who", F.inline(states))
        .where("content IS NOT NULL")
        .select("scope_key", "rel", "at_us", recorded(F.col("line_no"), F.col("ord"), F.col("side"), F.col("who")).alias("seq"), "content")
    )
    return events.drop("raw", "cwd", "session", "old_text", "new_text", "to_raw"), snapshots
