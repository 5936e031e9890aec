"""Small rules that several transcript formats share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def emitted(tool: Column, failed: Column) -> dict[str, Column]:
    """What a finished call still gives when it failed.

    Its time always counts, its window closes, and what its command or cell says is kept;
    only the file events are dropped. Shells and cells give no file event of their own.
    """
    shell, cell = tool == "bash", tool == "eval"
    return {
        "intervals": F.lit(True),
        "closed": shell | cell | tool.startswith("mcp__"),
        "inferred": shell,
        "cells": cell,
        "events": ~failed & ~shell & ~cell,
    }


def prompt_text_ok(text: Column) -> Column:
    """A person's own words: not blank, and not one of the wrappers that start with ``<``."""
    body = F.trim(F.regexp_replace(text, r"\A\s+|\s+\z", ""))
    return text.isNotNull() & (body != "") & ~body.startswith("<")
