"""Path hierarchies without building a tree: every ancestor is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.operators.ordered import ordered, running_sum


def prefixes(segments: Column) -> Column:
    """All ancestors of a path and the path itself, shortest first, as strings."""
    return F.transform(
        F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/")
    )


def path_prefixes(df: DataFrame, segments: Column) -> DataFrame:
    """One row per ancestor: adds ``path`` (its segments), ``key``, ``depth`` (from 0), ``is_leaf``.

    Segments may hold slashes themselves, so nodes are told apart by ``path``, not by ``key``.
    """
    steps = F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda n: F.struct(
            F.slice(segments, F.lit(1), n).alias("path"), (n - 1).alias("depth"), (n == F.size(segments)).alias("is_leaf")
        ),
    )
    out = df.where(F.size(segments) > 0).select("*", F.inline(steps))
    return out.withColumn("key", F.array_join("path", "/"))


EVENT_PATH = ("scope", "root_id", "scope_session", "rel")


def _by(events: DataFrame, by) -> list[str]:
    return [c for c in (by or EVENT_PATH) if c in events.columns]


def path_rollup(events: DataFrame, segments: Column, forest: Column, by=None) -> DataFrame:
    """Per tree node the events at or below it.

    An event has one path, so the union over descendants is disjoint and counts add up. Events
    are first reduced to one row per distinct path (the columns ``by``, from which ``segments``
    and ``forest`` follow), on the map side; only those few rows are spread over the ancestors.
    That also takes the weight off the nodes near the top.
    """
    by = _by(events, by)
    leaves = (
        events.select(*by, "end_us", (F.col("kind") == "write").cast("bigint").alias("w"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.max("end_us").alias("e"))
        .select(forest.alias("forest"), segments.alias("_segs"), "n", "w", "e")
    )
    return (
        path_prefixes(leaves, F.col("_segs"))
        .groupBy("forest", "path", "depth")
        .agg(
            F.sum("n").alias("n_events"),
            F.sum("w").alias("n_writes"),
            F.max("e").alias("last_end_us"),
            F.max(~F.col("is_leaf")).alias("is_dir"),
        )
        .withColumn("key", F.array_join("path", "/"))
    )


def presence(listing: DataFrame, n_roots: int) -> DataFrame:
    """Which roots have each path on disk, prefixes included; ``partial`` if not all have it."""
    steps = path_prefixes(listing.select("root_id", "rel"), F.split("rel", "/"))
    return (
        steps.select("key", "root_id")
        .distinct()
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("root_id")).alias("present_in"))  # at most one entry per root
        .withColumn("partial", F.size("present_in") < n_roots)
    )


def merge_listings(*listings: DataFrame) -> DataFrame:
    """Listings of several roots as one table; a path counts as a directory if it is one anywhere."""
    out = listings[0].select("root_id", "rel", "is_dir")
    for other in listings[1:]:
        out = out.unionByName(other.select("root_id", "rel", "is_dir"))
    return out.groupBy("root_id", "rel").agg(F.max("is_dir").alias("is_dir"))


def nodes_of(leaves: DataFrame, segments: Column, is_dir: Column | None = None) -> DataFrame:
    """Distinct nodes of each forest: ``(forest, path, key, depth, is_dir)``."""
    steps = path_prefixes(leaves.withColumn("_dir", F.lit(False) if is_dir is None else is_dir), segments)
    nodes = steps.groupBy("forest", "path", "depth").agg(F.max(~F.col("is_leaf") | F.col("_dir")).alias("is_dir"))
    return nodes.withColumn("key", F.array_join("path", "/"))


def _upto(path: Column, n: Column) -> Column:
    return F.slice(path, F.lit(1), n)


def compact(nodes: DataFrame) -> DataFrame:
    """Chains of single-child directories become one node named ``a/b``.

    A directory whose only child is a directory disappears into that child. A node's display
    name is its path below the nearest ancestor that stays. The nearest one is the deepest of
    the node's ancestors that is kept, found by equality on the exploded ancestors; nothing
    iterates, however deep a chain is.
    """
    path = F.col("path")
    kids = (
        nodes.where("depth > 0")
        .select("forest", _upto(path, F.col("depth")).alias("path"), "is_dir")
        .groupBy("forest", "path")
        .agg(F.count(F.lit(1)).alias("_kids"), F.max("is_dir").alias("_kid_dir"))
    )
    absorbed = kids.where("_kids = 1 AND _kid_dir").select("forest", "path")
    kept = nodes.join(absorbed, ["forest", "path"], "left_anti")
    ancestors = kept.where("depth > 0").select(
        "forest",
        path.alias("node"),
        F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda n: _upto(path, n))).alias("path"),
    )
    stays = ancestors.join(absorbed, ["forest", "path"], "left_anti")
    nearest = stays.groupBy("forest", F.col("node").alias("path")).agg(F.max(F.size("path")).alias("_up"))
    out = kept.join(nearest, ["forest", "path"], "left")
    skip = F.coalesce("_up", F.lit(0))
    return out.select(
        "forest",
        "path",
        "key",
        F.array_join(F.slice(path, skip + 1, F.size(path) - skip), "/").alias("name"),
        F.when(F.col("_up").isNotNull(), F.array_join(_upto(path, skip), "/")).alias("parent_key"),
        "is_dir",
    )


def deleted(paths: DataFrame, listing: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    """Distinct event paths ``(root_id, rel)`` with ``deleted``.

    A path is deleted if its root has been walked and neither the listing nor the disk has it.
    The listing marks ignored files that exist with ``listed = false``.
    """
    each = paths.select("root_id", "rel").distinct()
    if walked is not None:
        each = each.join(walked.select("root_id", F.lit(True).alias("_walked")), "root_id", "left")
    else:
        each = each.withColumn("_walked", F.lit(True))
    there = listing.select("root_id", "rel").distinct().withColumn("_there", F.lit(True))
    out = each.join(there, ["root_id", "rel"], "left")
    return out.select(
        "root_id", "rel", (F.coalesce("_walked", F.lit(False)) & F.col("_there").isNull()).alias("deleted")
    )


def deleted_merged(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Merged view: a path is deleted only if no root has it."""
    each = paths.select("rel").distinct()
    there = listing.select("rel").distinct().withColumn("_there", F.lit(True))
    return each.join(there, "rel", "left").select("rel", F.col("_there").isNull().alias("deleted"))


def tree_order(nodes: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Pre-order position of every node: directories first, then by name without case.

    The sort key is an array with one entry per ancestor, so that a node follows its parent.
    Needs ``is_dir`` of every ancestor, hence the whole node table of the forest.
    """
    segs = F.col("path")
    # An inner segment is a directory by position; only the last can be a file.
    key = F.transform(
        F.sequence(F.lit(1), F.size(segs)),
        lambda n: F.struct(
            ((n == F.size(segs)) & ~F.col("is_dir")).cast("int").alias("f"),
            F.lower(F.element_at(segs, n)).alias("l"),
            F.element_at(segs, n).alias("n"),
        ),
    )
    keyed = nodes.withColumn("_key", key)
    out = ordered(keyed, ("forest",), ("_key",), block_rows).scan(pos=running_sum(F.lit(1).cast("bigint")))
    return out.drop("_key")


def node_touches(events: DataFrame, segments: Column, forest: Column, by=None) -> DataFrame:
    """``(forest, key, is_dir, who)``: who has an event at or below each node."""
    by = _by(events, by)
    leaves = events.select(*by, "who").distinct().select(forest.alias("forest"), segments.alias("_segs"), "who")
    steps = path_prefixes(leaves, F.col("_segs"))
    out = steps.groupBy("forest", "path", "who").agg(F.max(~F.col("is_leaf")).alias("is_dir"))
    return out.select("forest", F.array_join("path", "/").alias("key"), "is_dir", "who")


def touching(touches: DataFrame, participants: DataFrame) -> DataFrame:
    """Authors of a node's events and the mains of their sessions."""
    both = touches.join(participants.select("who", "main"), "who", "left")
    people = F.array_compact(F.array("who", "main"))
    return both.select("forest", "key", F.explode(people).alias("who")).distinct()


def touched_dirs(touches: DataFrame, participants: DataFrame) -> DataFrame:
    """``(focus, forest, key)``: directories with events of a participant; a main stands for its session."""
    dirs = touches.where("is_dir").select("forest", "key", "who")
    both = dirs.join(participants.select("who", "main", "kind"), "who")
    people = F.array_compact(F.array(F.when(F.col("kind") != "main", F.col("who")), "main"))
    return both.select(F.explode(people).alias("focus"), "forest", "key").distinct()


def touched_only(nodes: DataFrame, events: DataFrame, node: str = "node") -> DataFrame:
    """Nodes with at least one visible event."""
    return nodes.join(events.select(node).distinct(), node, "left_semi")
