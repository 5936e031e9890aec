"""What happens to a batch of settled file changes: placed, compared, filtered, attributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.config import DEFAULTS, Params
from tracelane.operators.attribution import attribute, suppress_echoes, with_provenance
from tracelane.operators.content import asof_prev, version_diff
from tracelane.operators.roots import project_rel
from tracelane.session import staged
from tracelane.sources.participants import YOU
from tracelane.sources.touches import detail, recorded


def classify_changes(
    changes: DataFrame,
    prefixes: DataFrame,
    file_events: DataFrame,
    windows: DataFrame,
    calls: DataFrame,
    snapshots: DataFrame,
    now_us: int,
    p: Params = DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """Attributed events and new snapshots of a batch of coalesced changes.

    ``changes``: event_id, path, at_us, change, and of the file ``exists`` and ``content``
    (NULL if unreadable). A creation or modification of a file that is gone by
    now is dropped. Contents are recorded before echoes are: an echo still moves the baseline.
    ``windows`` carry ``root_id`` (NULL where their session names none).
    """
    real = changes.where((F.col("change") == "removed") | F.col("exists"))
    placed = project_rel(real, prefixes).where("root_id IS NOT NULL").withColumn("root_id", F.col("root_id").cast("bigint"))
    text = F.when(F.col("change") == "removed", "").otherwise(F.col("content"))
    placed = placed.withColumn("content", text).withColumn("scope_key", F.concat(F.lit("p"), F.col("root_id").cast("string")))
    placed = staged(placed)  # the lookups below read it several times
    # Snapshots that carry a plain number keep it; the builder's carry a place among the transcripts.
    plain = snapshots.schema["seq"].dataType.typeName() == "long"
    place = F.col("event_id").cast("bigint") if plain else recorded(F.col("event_id"), F.lit(0), F.lit(0), F.lit(""), live=1)
    seen = placed.where("content IS NOT NULL").select("scope_key", "rel", "at_us", place.alias("seq"), "content")
    history = snapshots.select("scope_key", "rel", "at_us", "seq", "content").unionByName(seen)
    # Echoes are told from narrow rows; contents are fetched and compared for what is left.
    writes = file_events.where("source = 'tool' AND kind = 'write' AND scope = 'project'")
    heard = staged(suppress_echoes(placed.drop("content"), writes, p=p))
    before = asof_prev(heard, history, ("scope_key", "rel"), "at_us", "at_us", "seq")
    own = placed.select(F.col("event_id").alias("_e"), "content")
    before = before.join(own, F.col("event_id") == F.col("_e"), "left").drop("_e")
    kept = staged(version_diff(before, created=F.col("change") == "created", by=("event_id",)))
    found = attribute(kept, windows, now_us, p=p, nullable_root=True)
    named = with_provenance(found.withColumn("who", F.coalesce("window_who", F.lit(YOU))), calls, None)
    has_call = F.col("call_id").isNotNull()
    events = named.select(
        "event_id",
        "who",
        F.lit("project").alias("scope"),
        "root_id",
        F.lit(None).cast("string").alias("scope_session"),
        "rel",
        F.lit("write").alias("kind"),
        F.when(has_call, "window").otherwise("watcher").alias("source"),
        F.when(has_call, F.coalesce("tool", F.lit("bash"))).alias("tool"),
        F.col("at_us").alias("start_us"),
        F.col("at_us").alias("end_us"),
        "call_id",
        detail("fs", fs_change=F.col("change"), diff=F.col("diff")).alias("detail"),
        "input",
    )
    return events, seen


def as_log(events: DataFrame) -> DataFrame:
    """Attributed events in the columns of the change log."""
    return events.select(
        "root_id",
        "rel",
        F.col("start_us").alias("at_us"),
        F.col("detail.fs_change").alias("change"),
        "who",
        "call_id",
        "tool",
        "input",
        F.col("detail.diff").alias("diff"),
    )
