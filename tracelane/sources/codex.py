"""Items, touches, windows and session facts of the third transcript format.

Rollouts may hold two shapes of the same facts: completed items, and older event messages. A
header that declares its history mode picks one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.functions import calls as K
from tracelane.functions.paths import file_url_path
from tracelane.operators.intervals import turn_intervals
from tracelane.sources import touches as T
from tracelane.sources import variant as V

# Functions that run a shell.
SHELL_TOOLS = ("exec", "exec_command", "write_stdin", "shell", "shell_command")
# Message types that begin and end a turn.
TURN_START = ("task_started", "turn_started")
TURN_END = ("task_complete", "turn_complete", "turn_aborted")


def timed(raw: DataFrame, headers: DataFrame) -> DataFrame:
    """Records with a time, their types, and the file's declared history mode."""
    out = raw.withColumns(
        {
            "at_us": F.col("at_us") if "at_us" in raw.columns else K.parse_ts(V.text("rec", "$.timestamp")),
            "ty": F.coalesce(V.text("rec", "$.type"), F.lit("")),
            "pty": F.coalesce(V.text("rec", "$.payload.type"), F.lit("")),
        }
    ).where("at_us IS NOT NULL")
    return out.join(headers.select("who", "mode"), "who", "left")


def history_ok(producer: str) -> Column:
    """Whether a record shape counts: always, unless the file declares the other one."""
    return F.col("mode").isNull() | (F.col("mode") == producer)


def _event(pty: str, producer: str | None = None) -> Column:
    out = (F.col("ty") == "event_msg") & (F.col("pty") == pty)
    return out if producer is None else out & history_ok(producer)


def session_facts(rows: DataFrame) -> DataFrame:
    head = F.col("ty") == "session_meta"
    return rows.select(
        "who",
        "line_no",
        "at_us",
        F.when(head, V.text("rec", "$.payload.id")).alias("id"),
        F.when(head, V.text("rec", "$.payload.cwd")).alias("cwd"),
        F.lit(None).cast("bigint").alias("header_us"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("title_kind"),
        F.lit(False).alias("is_exit"),
        F.lit(None).cast("bigint").alias("recorded_us"),
    )


def _marker() -> Column:
    message = F.col("ty") == "event_msg"
    return F.when(message & F.col("pty").isin(*TURN_START), "start").when(message & F.col("pty").isin(*TURN_END), "end")


def raw_intervals(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    return turn_intervals(rows.select("who", "at_us", "line_no", _marker().alias("marker")), block_rows=block_rows)


def turn_ends(rows: DataFrame) -> DataFrame:
    return rows.where(_marker() == "end").select("who", "line_no", "at_us")


def _items(rows: DataFrame, *types: str) -> DataFrame:
    """Completed items with their own id, start and end."""
    p = "$.payload"
    return (
        rows.where(_event("item_completed", "paginated") & V.text("rec", f"{p}.item.type").isin(*types))
        .withColumns(
            {
                "call_id": V.text("rec", f"{p}.item.id"),
                "start_us": F.coalesce(K.parse_ms(V.whole("rec", f"{p}.started_at_ms")), F.col("at_us")),
                "end_us": F.coalesce(K.parse_ms(V.whole("rec", f"{p}.completed_at_ms")), F.col("at_us")),
                "status": F.coalesce(V.text("rec", f"{p}.item.status"), F.lit("")),
                "item": V.node("rec", f"{p}.item"),
            }
        )
    )


def prompts(rows: DataFrame) -> DataFrame:
    """(who, at_us) of what a person typed; only those of main transcripts are prompts."""
    parts = F.filter(V.items("item", "$.content"), lambda b: V.text(b, "$.type") == "text")
    new = _items(rows, "UserMessage").select("who", "at_us", F.array_join(V.texts(parts, "$.text"), "\n").alias("text"))
    old = rows.where(_event("user_message", "legacy")).select("who", "at_us", V.text("rec", "$.payload.message").alias("text"))
    return new.unionByName(old).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("who", "at_us")


def call_input() -> Column:
    """What a shell function was given, by record shape."""
    p = "$.payload"
    given = F.coalesce(V.text("rec", f"{p}.arguments"), F.lit(""))
    args = F.try_parse_json(given)
    words = V.texts(V.items(args, "$.command"))
    from_args = F.when(args.isNull(), given).otherwise(
        F.coalesce(V.text(args, "$.cmd"), F.array_join(words, " "), V.text(args, "$.command"), F.lit(""))
    )
    action = F.array_join(V.texts(V.items("rec", f"{p}.action.command")), " ")
    return (
        F.when(F.col("pty") == "custom_tool_call", F.coalesce(V.text("rec", f"{p}.input"), F.lit("")))
        .when(F.col("pty") == "function_call", from_args)
        .when(F.col("pty") == "local_shell_call", F.coalesce(action, F.lit("")))
        .otherwise("")
    )


def window_records(rows: DataFrame) -> DataFrame:
    """Opens and closes in reading order, with what an open says about its call."""
    p = "$.payload"
    cid = V.text("rec", f"{p}.call_id")
    response = F.col("ty") == "response_item"
    shell = response & (
        (F.col("pty") == "local_shell_call")
        | (F.col("pty").isin("custom_tool_call", "function_call") & V.text("rec", f"{p}.name").isin(*SHELL_TOOLS))
    )
    def invoked(k):
        return F.coalesce(V.text("rec", f"{p}.invocation.{k}"), F.lit(""))

    ids = ("who", "line_no")
    opens = rows.where(shell).select(
        *ids, F.lit(0).alias("sub"), "at_us", cid.alias("call_id"), F.lit("open").alias("op"), F.lit("bash").alias("tool"), call_input().alias("input")
    )
    begins = rows.where(_event("mcp_tool_call_begin", "legacy")).select(
        *ids, F.lit(0).alias("sub"), "at_us", cid.alias("call_id"), F.lit("open").alias("op"),
        K.mcp_label(invoked("server"), invoked("tool")).alias("tool"),
        F.coalesce(V.json("rec", f"{p}.invocation.arguments"), F.lit("")).alias("input"),
    )
    output = response & F.col("pty").isin("custom_tool_call_output", "function_call_output")
    closes = rows.where(output | _event("mcp_tool_call_end", "legacy")).select(
        *ids, F.lit(0).alias("sub"), "at_us", cid.alias("call_id"), F.lit("close").alias("op")
    )
    items = _items(rows, "McpToolCall").where("status IN ('completed', 'failed') AND call_id IS NOT NULL")
    label = K.mcp_label(F.coalesce(V.text("item", "$.server"), F.lit("")), F.coalesce(V.text("item", "$.tool"), F.lit("")))
    given = F.coalesce(V.json("item", "$.arguments"), F.lit("null"))
    item_open = items.select(
        *ids, F.lit(0).alias("sub"), F.col("start_us").alias("at_us"), "call_id", F.lit("open").alias("op"), label.alias("tool"), given.alias("input")
    )
    item_close = items.select(*ids, F.lit(1).alias("sub"), F.col("end_us").alias("at_us"), "call_id", F.lit("close").alias("op"))
    out = T.union([opens, begins, item_open]).unionByName(T.union([closes, item_close]), allowMissingColumns=True)
    return out.where("call_id IS NOT NULL").withColumn("line_no", F.col("line_no") * 2 + F.col("sub")).drop("sub")


def commands(rows: DataFrame) -> DataFrame:
    """Finished shell commands with their script, from both shapes."""
    items = _items(rows, "CommandExecution").where(F.coalesce(V.text("item", "$.source") != "user_shell", F.lit(True)))
    script = K.argv_script(F.coalesce(V.texts(V.items("item", "$.command")), F.array().cast("array<string>")))
    keep = ("who", "session", "line_no", "call_id", "start_us", "end_us")
    new = items.where("status IN ('completed', 'failed') AND call_id IS NOT NULL").select(*keep, script.alias("script"))
    old_script = K.argv_script(F.coalesce(V.texts(V.items("rec", "$.payload.command")), F.array().cast("array<string>")))
    old = rows.where(_event("exec_command_end", "legacy")).select(
        "who", "session", "line_no", V.text("rec", "$.payload.call_id").alias("call_id"), F.col("at_us").alias("end_us"), old_script.alias("script")
    )
    return new.unionByName(old.where("call_id IS NOT NULL"), allowMissingColumns=True)


def call_table(rows: DataFrame) -> DataFrame:
    """Known calls; what a finished command says about itself comes later in the file and wins."""
    opened = window_records(rows).where("op = 'open'").select("who", "call_id", "line_no", "tool", "input")
    ran = commands(rows).select(
        "who", "call_id", (F.col("line_no") * 2).alias("line_no"), F.lit("bash").alias("tool"), F.col("script").alias("input")
    )
    last = F.max_by(F.struct("tool", "input"), F.col("line_no"))
    return (
        opened.unionByName(ran).groupBy("who", "call_id").agg(last.alias("c")).select("who", "call_id", "c.tool", "c.input")
    )


def _opened_at(df: DataFrame, rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Adds ``start_us``: when the call's window first opened before this record, else its end."""
    opens = window_records(rows).where("op = 'open'").select("who", "call_id", (F.col("line_no") / 2).cast("bigint").alias("_l"), "at_us")
    first = opens.groupBy("who", "call_id").agg(F.min_by("at_us", "_l").alias("_o"), F.min("_l").alias("_l"))
    out = df.join(first, ["who", "call_id"], "left")
    start = F.when(F.col("_l") <= F.col("line_no"), F.col("_o"))
    return out.withColumn("start_us", F.coalesce(start, F.col("end_us"))).drop("_o", "_l")


def touches(rows: DataFrame, cwds: DataFrame, default_cwd: str, targets: DataFrame | None = None) -> DataFrame:
    """File touches. ``cwds``: (session, cwd)."""

    def placed(df):
        known = cwds.select("session", F.nullif("cwd", F.lit("")).alias("_cwd"))
        return df.join(known, "session", "left").withColumn("cwd", F.coalesce("_cwd", F.lit(default_cwd))).drop("_cwd")

    ran = commands(rows)
    both = ran.where("start_us IS NOT NULL").unionByName(_opened_at(ran.where("start_us IS NULL").drop("start_us"), rows))
    reads = placed(_items(rows, "CommandExecution").where("status = 'completed'")).where(
        F.coalesce(V.text("item", "$.source") != "user_shell", F.lit(True))
    )
    reads = reads.withColumn("cwd", F.coalesce(file_url_path(V.text("item", "$.cwd")), F.col("cwd")))
    reads = reads.select(*T.CARRIED, F.posexplode(V.items("item", "$.parsed_cmd")).alias("ord", "c"))
    reads = reads.where(V.text("c", "$.type") == "read")

    p = "$.payload"
    new_changes = _items(rows, "FileChange").where("status NOT IN ('failed', 'declined')").withColumn("changes", V.node("item", "$.changes"))
    bad = F.coalesce(V.text("rec", f"{p}.status").isin("failed", "declined"), F.lit(False)) | ~F.coalesce(
        V.flag("rec", f"{p}.success"), F.lit(True)
    )
    old_changes = rows.where(_event("patch_apply_end", "legacy") & ~bad).withColumns(
        {"call_id": V.text("rec", f"{p}.call_id"), "start_us": F.col("at_us"), "end_us": F.col("at_us"), "changes": V.node("rec", f"{p}.changes")}
    )
    keep = ("who", "session", "line_no", "call_id", "start_us", "end_us")
    changes = placed(new_changes.select(*keep, "changes").unionByName(old_changes.select(*keep, "changes")))

    searches = _items(rows, "WebSearch").select(*keep, F.col("item").alias("s")).unionByName(
        rows.where(_event("web_search_end", "legacy")).select(
            "who", "session", "line_no", V.text("rec", f"{p}.call_id").alias("call_id"),
            F.col("at_us").alias("start_us"), F.col("at_us").alias("end_us"), V.node("rec", p).alias("s"),
        )
    )
    done = _items(rows, "McpToolCall").where("status = 'completed' AND call_id IS NOT NULL").select(
        *keep, F.coalesce(V.text("item", "$.server"), F.lit("")).alias("server"), F.coalesce(V.text("item", "$.tool"), F.lit("")).alias("mcp_tool")
    )
    failed = V.node("rec", f"{p}.result.Err").isNotNull() | F.coalesce(V.flag("rec", f"{p}.result.Ok.isError"), F.lit(False))
    ended = rows.where(_event("mcp_tool_call_end", "legacy") & ~failed).select(
        "who", "session", "line_no", V.text("rec", f"{p}.call_id").alias("call_id"), F.col("at_us").alias("end_us"),
        F.coalesce(V.text("rec", f"{p}.invocation.server"), F.lit("")).alias("server"),
        F.coalesce(V.text("rec", f"{p}.invocation.tool"), F.lit("")).alias("mcp_tool"),
    ).where("call_id IS NOT NULL")
    mcp = placed(done.unionByName(_opened_at(ended, rows)))
    return T.union(
        [
            T.inferred(placed(both), targets),
            T.touch(reads, "read", "read", raw=V.text("c", "$.path"), ord=F.col("ord")),
            change_touches(changes),
            search_touches(placed(searches)),
            T.mcp_touch(mcp, F.col("server"), F.col("mcp_tool")),
        ]
    )


def change_touches(changes: DataFrame) -> DataFrame:
    """A map of path to change: added, deleted or updated, the last possibly with a move."""
    each = changes.select(
        *T.CARRIED, F.posexplode(F.map_entries(F.try_variant_get("changes", "$", "map<string,variant>"))).alias("ord", "e")
    ).select(*T.CARRIED, (F.col("ord") * 2).alias("ord"), F.col("e.key").alias("path"), F.col("e.value").alias("c"))
    kind, content = V.text("c", "$.type"), V.text("c", "$.content")
    text = F.coalesce(content, F.lit(""))
    change = (
        F.when(kind == "add", T.detail("written", content=text))
        .when(kind == "delete", T.detail("removed"))
        .otherwise(T.detail("diff", diff=F.coalesce(V.text("c", "$.unified_diff"), F.lit(""))))
    )
    known = each.where(kind.isin("add", "delete", "update"))
    moved = known.where((kind == "update") & V.text("c", "$.move_path").isNotNull())
    return T.touch(
        known,
        "write",
        F.when(kind == "add", "write").otherwise("edit"),
        raw=F.col("path"),
        ord=F.col("ord"),
        detail=change,
        old_text=F.when(kind == "delete", content),
        new_text=F.when(kind == "add", text),
    ).unionByName(
        T.touch(moved, "write", "edit", raw=F.col("path"), ord=F.col("ord") + 1, to_raw=V.text("c", "$.move_path"))
    )


def search_touches(searches: DataFrame) -> DataFrame:
    """A page that was opened is a fetch; else the first query there is."""

    def filled(c):
        return F.nullif(c, F.lit(""))

    url = F.when(V.text("s", "$.action.type").isin("open_page", "find_in_page"), filled(V.text("s", "$.action.url")))
    first = V.text(F.try_element_at(V.items("s", "$.action.queries"), F.lit(1)), "$")
    query = F.coalesce(filled(V.text("s", "$.query")), filled(V.text("s", "$.action.query")), filled(first))
    return T.touch(searches.where(url.isNotNull()), "read", "read", scope=F.lit("webfetch"), rel=url).unionByName(
        T.touch(
            searches.where(url.isNull() & query.isNotNull()),
            "read",
            "web_search",
            scope=F.lit("websearch"),
            rel=T.one_line(query),
            detail=T.detail("search", sources=F.array()),
        )
    )
