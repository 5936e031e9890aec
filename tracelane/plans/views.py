"""The read side over the canonical tables: trees, rasters, lists and facets.

All views share one rule for what is visible (``operators.sessions.visible_events``); persist
its result when several views of the same filter are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.config import DEFAULTS, Params
from tracelane.functions.paths import tree_segments
from tracelane.operators import timeline as T
from tracelane.operators import tree as TR
from tracelane.operators.intervals import activity_union
from tracelane.operators.roots import session_rest
from tracelane.operators.sessions import time_range

# Prefixes of forest keys.
FILES, MERGED, MOUNTS, WEB, MCP, SESSION = "f", "f*", "m", "w", "mcp", "s"


def forest_of(merged: bool) -> Column:
    """The forest an event belongs to: files per root (or merged), mounts, web, MCP, per session."""
    scope = F.col("scope")
    files = F.lit(MERGED) if merged else F.concat(F.lit(FILES), F.col("root_id").cast("string"))
    return (
        F.when(scope == "project", files)
        .when(scope.isin("external", "remote"), MOUNTS)
        .when(scope.isin("websearch", "webfetch"), WEB)
        .when(scope == "mcp", MCP)
        .when(scope == "session", F.concat(F.lit(SESSION), F.col("scope_session")))
    )


def is_compacted(forest: Column) -> Column:
    return (forest == MOUNTS) | forest.startswith(SESSION)


def placed_events(
    events: DataFrame, merged: bool = False, session_roots: tuple[str, ...] = (), p: Params = DEFAULTS
) -> DataFrame:
    """Events with ``forest`` and ``segs``, their place in a tree."""
    segs = tree_segments(F.col("scope"), F.col("rel"), p.home, session_rest(F.col("rel"), session_roots))
    return events.withColumn("forest", forest_of(merged)).withColumn("segs", segs)


def tree_nodes(
    events: DataFrame,
    listing: DataFrame | None = None,
    merged: bool = False,
    n_roots: int = 1,
    session_roots: tuple[str, ...] = (),
    p: Params = DEFAULTS,
) -> DataFrame:
    """Every node of every forest with the events at or below it.

    Columns: forest, key, name, parent_key, is_dir, n_events, n_writes, last_end_us,
    present_in, partial, deleted. Listed files appear without events too. Chains of
    single-child directories are one node in the mounts and session forests; an event on a
    directory that such a chain absorbs belongs to no node.
    """
    placed = placed_events(events, merged, session_roots, p)
    leaves = placed.select("forest", "segs").distinct().withColumn("dir", F.lit(False))
    if listing is not None:
        files = F.lit(MERGED) if merged else F.concat(F.lit(FILES), F.col("root_id").cast("string"))
        listed = listing.select(files.alias("forest"), F.split("rel", "/").alias("segs"), F.col("is_dir").alias("dir"))
        leaves = leaves.unionByName(listed)
    nodes = TR.nodes_of(leaves, F.col("segs"), F.col("dir"))
    chained, plain = nodes.where(is_compacted(F.col("forest"))), nodes.where(~is_compacted(F.col("forest")))
    short = TR.compact(chained)
    up = F.when(F.col("depth") > 0, F.array_join(F.slice("path", F.lit(1), F.col("depth")), "/"))
    shape = plain.select("forest", "path", "key", F.element_at("path", -1).alias("name"), up.alias("parent_key"), "is_dir")
    shape = shape.unionByName(short.select(*shape.columns))

    gone = chained.select("forest", "path").join(short, ["forest", "path"], "left_anti")
    own = placed.join(gone.withColumnRenamed("path", "segs"), ["forest", "segs"], "left_anti")
    stats = TR.path_rollup(own, F.col("segs"), F.col("forest"), by=("forest", "segs"))
    zero = F.lit(0).cast("bigint")
    out = shape.join(stats.select("forest", "path", "n_events", "n_writes", "last_end_us"), ["forest", "path"], "left")
    out = out.drop("path")
    out = out.withColumns({"n_events": F.coalesce("n_events", zero), "n_writes": F.coalesce("n_writes", zero)})
    if listing is None:
        return out.withColumns(
            {"present_in": F.lit(None).cast("array<int>"), "partial": F.lit(False), "deleted": F.lit(False)}
        )
    paths = events.where("scope = 'project'").select("root_id", "rel")
    if merged:
        lost = TR.deleted_merged(paths, listing).select(F.lit(MERGED).alias("forest"), F.col("rel").alias("key"), "deleted")
        there = TR.presence(listing, n_roots).withColumn("forest", F.lit(MERGED))
        out = out.join(there, ["forest", "key"], "left")
    else:
        walked = listing.select("root_id").distinct()
        lost = TR.deleted(paths, listing, walked).select(
            F.concat(F.lit(FILES), F.col("root_id").cast("string")).alias("forest"), F.col("rel").alias("key"), "deleted"
        )
        out = out.withColumns({"present_in": F.lit(None).cast("array<int>"), "partial": F.lit(False)})
    out = out.join(lost, ["forest", "key"], "left")
    gone_file = F.coalesce("deleted", F.lit(False)) & ~F.col("is_dir")
    return out.withColumns({"deleted": gone_file, "partial": F.coalesce("partial", F.lit(False))})


def node_events(events: DataFrame, merged: bool = False, session_roots: tuple[str, ...] = (), p: Params = DEFAULTS) -> DataFrame:
    """The bridge (node, event_id): an event and every ancestor of its path."""
    placed = placed_events(events, merged, session_roots, p)
    steps = TR.path_prefixes(placed.select("event_id", "forest", "segs"), F.col("segs"))
    return steps.select(F.concat("forest", F.lit(":"), "key").alias("node"), "event_id")


def gantt(
    events: DataFrame,
    spans: DataFrame,
    prompts: DataFrame,
    participants: DataFrame,
    n_cols: int,
    now_us: int | None = None,
    filtered: bool = False,
    merged: bool = False,
    p: Params = DEFAULTS,
) -> tuple[DataFrame, DataFrame, int]:
    """Raster of nodes, raster of participants, and the width in seconds that fits ``n_cols``.

    ``events`` are the visible ones. While an action filter is on, lanes come from them.
    """
    shown = activity_union(events) if filtered else activity_union(events, spans, prompts)
    ends = time_range(events, None if filtered else spans, None if filtered else prompts, now_us=now_us, p=p).first()
    if ends["lo_us"] is None:
        width, first, last = p.widths[-1], None, None
    else:
        lo, hi = ends["lo_us"] // 1_000_000, ends["hi_us"] // 1_000_000
        width = T.fit_width(shown, lo, hi, n_cols, p).first()[0]
        first, last = lo // width, hi // width
    named = F.transform(TR.prefixes(F.col("segs")), lambda key: F.concat(F.col("forest"), F.lit(":"), key))
    nodes = T.gantt_nodes(placed_events(events, merged, p=p), width, ("forest", "segs"), named, first, last)
    mine = events.where("who = 'you'")
    lanes = T.gantt_lanes(events if filtered else spans, prompts, mine, participants, width, filtered=filtered, first=first, last=last)
    return nodes, lanes, width
