"""Exact integer arithmetic on BIGINT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(x, w) -> Column:
    """Floor division without a detour through DOUBLE; ``w`` is positive."""
    x = F.col(x) if isinstance(x, str) else x
    w = w if isinstance(w, Column) else F.lit(w).cast("bigint")
    return F.call_function("div", x - F.pmod(x, w), w)


def ceil_div(x, w) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return -floor_div(-x, w)
