"""Tool calls: names, inputs, labels, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Tools whose calls open an attribution window under their own name.
WINDOW_TOOLS = ("bash", "eval", "ast_edit", "lsp")
# The argument that holds a tool's input.
INPUT_FIELD = {"bash": "command", "eval": "code", "write": "content"}
# Shells whose -c / -lc argument is the script.
SHELLS = ("sh", "bash", "zsh")
SHELL_FLAGS = ("-c", "-lc")
# Cell languages that name their own extension.
CELL_EXTENSIONS = ("py", "js")

RFC3339 = r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z"


def parse_ts(text: Column) -> Column:
    """RFC3339 text to epoch microseconds; NULL when malformed."""
    return F.when(text.rlike(RFC3339), F.unix_micros(F.try_to_timestamp(F.upper(text))))


def parse_ms(ms: Column) -> Column:
    return ms.cast("bigint") * 1000


def split_mcp(name: Column) -> Column:
    """``mcp__server__tool`` as struct(server, tool); the server defaults to ``mcp``."""
    rest = F.regexp_replace(name, r"\Amcp__", "")
    at = F.instr(rest, "__")
    server = F.when(at > 0, F.substring_index(rest, "__", 1)).otherwise("mcp")
    tool = F.when(at > 0, rest.substr(at + 2, F.length(rest))).otherwise(rest)
    return F.struct(server.alias("server"), tool.alias("tool"))


def mcp_label(server: Column, tool: Column) -> Column:
    return F.concat(F.lit("mcp:"), server, F.lit("/"), tool)


def window_label(tool: Column, path: Column) -> Column:
    """The label under which a call opens a window, NULL if it opens none.

    Shell-like tools and MCP tools do; a write only to a device (``xd://name``).
    """
    device = F.regexp_extract(path, r"\Axd://([^/?]*)", 1)
    return F.when(tool.isin(*WINDOW_TOOLS) | tool.startswith("mcp__"), tool).when(
        (tool == "write") & path.startswith("xd://"), device
    )


def argv_script(argv: Column) -> Column:
    """The script of ``sh -c script``, else the words joined with spaces."""
    program = F.element_at(F.split(F.try_element_at(argv, F.lit(1)), "/"), -1)
    unwrap = (F.size(argv) >= 3) & program.isin(*SHELLS) & F.try_element_at(argv, F.lit(2)).isin(*SHELL_FLAGS)
    return F.when(unwrap, F.coalesce(F.try_element_at(argv, F.lit(3)), F.lit(""))).otherwise(F.array_join(argv, " "))


def eval_cell_name(title: Column, intent: Column, language: Column, start_us: Column, tz: str) -> Column:
    """``HH:MM:SS label.ext`` of a notebook-like cell, in the given time zone."""
    blank = F.lit(None).cast("string")
    pick = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)).otherwise(blank) for c in (title, intent)], F.lit(""))
    safe = F.regexp_replace(F.translate(pick, "/\\", "--"), r"\p{Cntrl}", " ")
    label = F.trim(safe)
    ext = F.when(language.isin(*CELL_EXTENSIONS), language).otherwise("txt")
    clock = F.date_format(F.from_utc_timestamp(F.timestamp_micros(start_us), tz), "HH:mm:ss")
    return F.concat(clock, F.when(label != "", F.concat(F.lit(" "), label)).otherwise(""), F.lit("."), ext)


