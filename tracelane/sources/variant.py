"""Reading drift-tolerant JSON records kept as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def node(v, path: str) -> Column:
    """The value at ``path``; NULL where it is missing or JSON null."""
    got = F.try_variant_get(_c(v), path, "variant")
    return F.when(~F.is_variant_null(got), got)


def text(v, path: str) -> Column:
    """A string; NULL for any other type."""
    return F.when(F.schema_of_variant(F.try_variant_get(_c(v), path, "variant")) == "STRING", F.try_variant_get(_c(v), path, "string"))


def whole(v, path: str) -> Column:
    """An integer; NULL for any other type."""
    return F.when(
        F.schema_of_variant(F.try_variant_get(_c(v), path, "variant")) == "BIGINT", F.try_variant_get(_c(v), path, "bigint")
    )


def flag(v, path: str) -> Column:
    return F.try_variant_get(_c(v), path, "boolean")


def items(v, path: str) -> Column:
    """An array of VARIANT; NULL for any other type."""
    return F.try_variant_get(_c(v), path, "array<variant>")


def texts(array: Column, path: str = "$") -> Column:
    """The strings among the elements (or at ``path`` in them), in order."""
    return F.filter(F.transform(array, lambda e: text(e, path)), lambda s: s.isNotNull())


def json(v, path: str = "$") -> Column:
    """Compact JSON text of a value; NULL where it is missing or JSON null."""
    return F.to_json(node(v, path))


def web_sources(array: Column) -> Column:
    """Search hits as (title, url): a hit needs a url, a missing title is empty."""
    hits = F.transform(
        array, lambda e: F.struct(F.coalesce(text(e, "$.title"), F.lit("")).alias("title"), text(e, "$.url").alias("url"))
    )
    return F.coalesce(
        F.filter(hits, lambda h: h["url"].isNotNull()), F.array().cast("array<struct<title:string,url:string>>")
    )
