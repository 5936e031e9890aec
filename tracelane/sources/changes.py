"""File-system changes as an input table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise_fs(raw: DataFrame) -> DataFrame:
    """Observed operations as plain changes.

    Input: ``op`` (create, modify, remove, rename, rename_from, rename_to), ``path``,
    ``to_path`` (rename only) and, per side, whether the path is a directory or ignored. A
    rename is a removal and a creation. Directories only matter as removals (what was removed
    cannot be asked any more), ignored paths never.
    """
    op = F.col("op")
    here = F.when(op.isin("create", "rename_to"), "created").when(op == "modify", "modified").otherwise("removed")

    def side(path, change, is_dir, ignored):
        return F.struct(
            F.col(path).alias("path"), change.alias("change"), F.col(is_dir).alias("is_dir"), F.col(ignored).alias("ignored")
        )

    one = side("path", here, "is_dir", "ignored")
    two = side("to_path", F.lit("created"), "to_is_dir", "to_ignored")
    keep = [c for c in raw.columns if c not in {"op", "path", "to_path", "is_dir", "ignored", "to_is_dir", "to_ignored"}]
    sides = F.when(op == "rename", F.array(one, two)).otherwise(F.array(one))
    return (
        raw.select(*keep, F.explode(sides).alias("c"))
        .where(~F.col("c.ignored") & ((F.col("c.change") == "removed") | ~F.col("c.is_dir")))
        .select(*keep, "c.path", "c.change")
    )
