"""Who wrote each transcript: role, label, session and parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.functions import paths as P
from tracelane.session import staged
from tracelane.sources import variant as V
from tracelane.sources.raw import ADVISOR, is_codex_header, is_top_level, of_class, top_dir_session

COLUMNS = ("harness", "project_dir", "who", "kind", "label", "session", "main", "parent")
YOU = "you"


def _files(raw: DataFrame, harness: str) -> DataFrame:
    return raw.where(F.col("harness") == harness).select("project_dir", F.col("file").alias("who")).distinct()


def omp_participants(raw: DataFrame) -> DataFrame:
    """Role and ancestors follow from the path alone, whatever the depth."""
    who, top = F.col("who"), is_top_level(F.col("who"), F.col("project_dir"))
    advisor = P.base_name(who) == ADVISOR
    kind = F.when(advisor, "advisor").when(top, "main").otherwise("subagent")
    session = F.when(advisor & top, None).otherwise(top_dir_session(who, F.col("project_dir")))
    label = F.when(advisor, "advisor").when(top, "main").otherwise(P.stem(who))
    return _files(raw, "omp").select(
        F.lit("omp").alias("harness"),
        "project_dir",
        "who",
        kind.alias("kind"),
        label.alias("label"),
        session.alias("session"),
        session.alias("main"),
        F.when(~top, F.concat(P.parent(who), F.lit(".jsonl"))).alias("parent"),
    )


def claude_participants(raw: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    who, top = F.col("who"), is_top_level(F.col("who"), F.col("project_dir"))
    files = _files(raw, "claude")
    files = files.withColumn("label", F.lit(None).cast("string")) if labels is None else files.join(labels, "who", "left")
    session = top_dir_session(who, F.col("project_dir"))
    return files.select(
        F.lit("claude").alias("harness"),
        "project_dir",
        "who",
        F.when(top, "main").otherwise("subagent").alias("kind"),
        F.when(top, "main").otherwise(F.coalesce("label", P.stem(who))).alias("label"),
        session.alias("session"),
        session.alias("main"),
        F.when(~top, session).alias("parent"),
    )


def codex_headers(raw: DataFrame) -> DataFrame:
    p = "$.payload"
    spawn = f"{p}.source.subagent.thread_spawn"
    mode = V.text("rec", f"{p}.history_mode")
    """The first line of each rollout; a file without a complete one is no rollout."""
    return of_class(raw, "session_meta").where((F.col("harness") == "codex") & is_codex_header()).select(
        "project_dir",
        F.col("file").alias("who"),
        V.text("rec", f"{p}.id").alias("id"),
        F.coalesce(V.text("rec", f"{p}.parent_thread_id"), V.text("rec", f"{spawn}.parent_thread_id")).alias("parent_id"),
        F.coalesce(V.text("rec", f"{spawn}.agent_nickname"), V.text("rec", f"{spawn}.agent_role")).alias("label"),
        F.when(mode.isin("legacy", "paginated"), mode).alias("mode"),
    )


def tops(pairs: DataFrame) -> DataFrame:
    """The top of every chain of parents: (who, parent, top, depth).

    ``pairs``: who (unique), parent (null, or not among ``who``: a top of its own). Each round doubles the steps that
    every row looks up, and rows that have arrived are not joined again; so the rounds grow with the logarithm of the
    longest chain. What has not arrived after as many steps as there are rows runs in a cycle: its top is the least member of
    that cycle, its depth null.
    """
    known = pairs.select(F.col("who").alias("_w"))
    linked = pairs.join(known, F.col("parent") == F.col("_w"), "left")
    start = linked.select("who", "parent", F.coalesce("_w", "who").alias("to"), F.col("_w").isNotNull().cast("bigint").alias("steps"), F.least("who", F.coalesce("_w", "who")).alias("low"))
    rows = staged(start)
    ends = rows.where("steps = 0").select("who", "parent", F.col("who").alias("top"), F.lit(0).cast("bigint").alias("depth"))
    done, running = [ends], rows.where("steps > 0")
    arrived = staged(ends.select(F.col("who").alias("_e"), F.lit(0).cast("bigint").alias("_d"), F.col("who").alias("_t")))
    count, reach = rows.count(), 1
    while reach <= 2 * count and running.limit(1).count():
        # Those whose next stop has arrived arrive too; the others double their step.
        looked = staged(running.join(arrived, F.col("to") == F.col("_e"), "left"))
        new = looked.where("_e IS NOT NULL").select("who", "parent", F.col("_t").alias("top"), (F.col("steps") + F.col("_d")).alias("depth"))
        left = looked.where("_e IS NULL").select("who", "parent", "to", "steps", "low")
        ahead = running.select(F.col("who").alias("_n"), F.col("to").alias("_to"), F.col("steps").alias("_s"), F.col("low").alias("_l"))
        running = staged(left.join(ahead, F.col("to") == F.col("_n")).select("who", "parent", F.col("_to").alias("to"), (F.col("steps") + F.col("_s")).alias("steps"), F.least("low", "_l").alias("low")))
        arrived = staged(arrived.unionByName(new.select(F.col("who").alias("_e"), F.col("depth").alias("_d"), F.col("top").alias("_t"))))
        done.append(new)
        reach *= 2
    # The next stop lies in the cycle, and its own way has been all round it.
    cycle = running.select(F.col("who").alias("_n"), F.col("low").alias("_l"))
    done.append(running.join(cycle, F.col("to") == F.col("_n")).select("who", "parent", F.col("_l").alias("top"), F.lit(None).cast("bigint").alias("depth")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def codex_participants(raw: DataFrame) -> DataFrame:
    """A rollout belongs to the earlier one whose file name ends in its parent's id.

    Without such a file it is a session of its own; chains of parents are followed by ``tops``.
    """
    heads = staged(codex_headers(raw))
    words = F.split(P.stem(F.col("who")), "-")
    tails = F.transform(
        F.sequence(F.lit(2), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), "-")
    )
    named = heads.select("project_dir", F.col("who").alias("_up"), F.explode(F.when(F.size(words) > 1, tails)).alias("parent_id"))
    child = heads.where("parent_id IS NOT NULL").select("project_dir", "who", "parent_id")
    parents = (
        child.join(named, ["project_dir", "parent_id"])
        .where(F.col("_up") < F.col("who"))
        .groupBy("who")
        .agg(F.min("_up").alias("parent"))
    )
    roots = tops(heads.join(parents, "who", "left").select("who", "parent"))
    child = F.col("parent").isNotNull()
    return heads.join(roots, "who").select(
        F.lit("codex").alias("harness"),
        "project_dir",
        "who",
        F.when(child, "subagent").otherwise("main").alias("kind"),
        F.when(child, F.coalesce("label", F.lit("subagent"))).otherwise("main").alias("label"),
        F.col("top").alias("session"),
        F.col("top").alias("main"),
        "parent",
    )
