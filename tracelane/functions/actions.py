"""Action classes of file events and the filter over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelane.functions.paths import extension

# Action classes, in display order.
ACTIONS = ("eval", "read", "write", "edit", "search", "fetch", "mcp", "inferred", "fs")
# The classes whose target is a file path (besides "fs during ...").
FILE_ACTIONS = ("read", "write", "edit", "fs", "inferred")
# Extensions that make a file a script.
SCRIPT_EXTENSIONS = ("sh", "bash", "zsh", "fish", "py", "js", "mjs", "cjs", "ts", "rb", "pl", "lua", "ps1")

DURING = "fs during "


def action_key(
    source: Column | str = "source", tool: Column | str = "tool", scope: Column | str = "scope", kind: Column | str = "kind"
) -> Column:
    source, tool, scope, kind = (F.col(c) if isinstance(c, str) else c for c in (source, tool, scope, kind))
    by_tool = (
        F.when((tool == "read") & (scope == "webfetch"), "fetch")
        .when(tool.isin("eval", "read", "write", "edit", "mcp"), tool)
        .when(tool == "web_search", "search")
        .when(kind == "read", "read")
        .otherwise("write")
    )
    return (
        F.when(source == "tool", by_tool)
        .when(source == "window", F.concat(F.lit(DURING), tool))
        .when(source == "inferred", "inferred")
        .otherwise("fs")
    )


def is_script(rel: Column | str = "rel") -> Column:
    rel = F.col(rel) if isinstance(rel, str) else rel
    return F.coalesce(F.lower(extension(rel)).isin(*SCRIPT_EXTENSIONS), F.lit(False))


@dataclass(frozen=True)
class ActionFilter:
    """Checked classes, checked ``fs during`` tools, and whether only scripts count."""

    actions: frozenset = field(default_factory=frozenset)
    fs_during: frozenset = field(default_factory=frozenset)
    scripts_only: bool = False

    def keys(self) -> list[str]:
        return [a for a in ACTIONS if a in self.actions] + [DURING + t for t in sorted(self.fs_during)]

    def matches(self) -> Column:
        key = action_key()
        checked = key.isin(*self.keys()) if self.keys() else F.lit(False)
        if not self.scripts_only:
            return checked
        about_file = key.isin(*FILE_ACTIONS) | key.startswith(DURING)
        return checked & (~about_file | is_script())
