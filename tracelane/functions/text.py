"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a capped text ends with.
TRUNCATED = "\n… (truncated)"


def utf8_cap(c: Column, limit: int = 4096) -> Column:
    """At most ``limit`` bytes of UTF-8, cut between characters and marked as cut."""
    raw = c.cast("binary")
    heads = [F.substring(raw, 1, n) for n in range(limit, max(limit - 4, 0), -1)]
    head = F.coalesce(*[F.when(F.is_valid_utf8(h.cast("string")), h.cast("string")) for h in heads], F.lit(""))
    return F.when(F.octet_length(c) > limit, F.concat(head, F.lit(TRUNCATED))).otherwise(c)


def smartcase(c: Column, query: str) -> Column:
    """Contains; upper-case letters in the query make it case-sensitive. Empty matches nothing."""
    if not query:
        return F.lit(False)
    if any(ch.isupper() for ch in query):
        return c.contains(query)
    return F.lower(c).contains(query.lower())


def replace_first(s: Column, old: Column, new: Column) -> Column:
    at = F.call_function("position", old, s)
    return F.when(at == 0, s).otherwise(
        F.concat(s.substr(F.lit(1), at - 1), new, s.substr(at + F.length(old), F.length(s)))
    )


def apply_edits(text: Column, edits: Column) -> Column:
    """Replay ordered edits ``struct(old, new, all)``; an empty ``old`` only fills an empty text."""
    return F.aggregate(
        edits,
        text,
        lambda s, e: F.when(e["old"] == "", F.when(s == "", e["new"]).otherwise(s))
        .when(e["all"], F.replace(s, e["old"], e["new"]))
        .otherwise(replace_first(s, e["old"], e["new"])),
    )
