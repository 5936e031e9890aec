"""Calls, touches, windows and session facts of the first transcript format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.config import DEFAULTS, Params
from tracelane.functions import calls as K
from tracelane.functions import paths as P
from tracelane.operators.ordered import ordered, running_last, running_sum
from tracelane.sources import touches as T
from tracelane.sources import variant as V
from tracelane.sources.raw import of_class
from tracelane.sources.rules import emitted


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def entry_ts() -> Column:
    return K.parse_ts(V.text("rec", "$.timestamp"))


def message_ts(field: str = "timestamp") -> Column:
    return K.parse_ms(V.whole("rec", f"$.message.{field}"))


def _type() -> Column:
    return V.text("rec", "$.type")


def _role() -> Column:
    return V.text("rec", "$.message.role")


def session_facts(raw: DataFrame) -> DataFrame:
    """Rows for the session roll-up (see ``model.sessions_of``).

    Every record counts as activity; what headers, titles and exits say is read from those
    records alone.
    """
    is_exit = (_type() == "custom") & (V.text("rec", "$.customType") == "session_exit")
    if "class" not in raw.columns:
        return _told(raw, entry_ts(), is_exit)
    seen = raw.where(~F.col("class").isin("header", "title", "exit"))
    none = {n: F.lit(None).cast(t) for n, t in (("id", "string"), ("cwd", "string"), ("header_us", "bigint"), ("title", "string"), ("title_kind", "string"))}
    plain = seen.select("who", "line_no", "at_us").withColumns(
        {**none, "is_exit": F.lit(False), "recorded_us": F.lit(None).cast("bigint")}
    )
    return plain.unionByName(_told(of_class(raw, "header", "title", "exit"), F.col("at_us"), is_exit))


def _told(raw: DataFrame, at: Column, is_exit: Column) -> DataFrame:
    kind = F.when(_type() == "session", "header").when(_type().isin("title", "title_change"), "title")
    return raw.select(
        "who",
        "line_no",
        at.alias("at_us"),
        F.when(kind == "header", V.text("rec", "$.id")).alias("id"),
        F.when(kind == "header", V.text("rec", "$.cwd")).alias("cwd"),
        F.when(kind == "header", entry_ts()).alias("header_us"),
        F.when(kind == "title", V.text("rec", "$.title")).alias("title"),
        F.when(kind == "title", "custom").alias("title_kind"),
        F.coalesce(is_exit, F.lit(False)).alias("is_exit"),
        F.when(is_exit, K.parse_ts(V.text("rec", "$.data.recordedAt"))).alias("recorded_us"),
    )


def prompts(raw: DataFrame) -> DataFrame:
    """(who, at_us) of what a person typed; only those of main transcripts are prompts."""
    said = (_type() == "message") & (_role() == "user") & (V.text("rec", "$.message.attribution") == "user")
    return of_class(raw, "user").where(said).select("who", message_ts().alias("at_us")).where("at_us IS NOT NULL")


def call_records(raw: DataFrame) -> DataFrame:
    """Everything that starts or ends a call, one row each, in reading order.

    ``op``: exec (execution started), block (the assistant asked for it), result.
    """
    ids = ("who", "line_no")
    custom = (_type() == "custom") & (V.text("rec", "$.customType") == "tool_execution_start")
    execs = of_class(raw, "exec").where(custom).select(
        *ids,
        _zero().alias("sub"),
        F.lit("exec").alias("op"),
        V.text("rec", "$.data.toolCallId").alias("call_id"),
        F.coalesce(V.text("rec", "$.data.toolName"), F.lit("")).alias("tool"),
        V.json("rec", "$.data.args").alias("args"),
        F.coalesce(K.parse_ts(V.text("rec", "$.data.startedAt")), entry_ts()).alias("at_us"),
    )
    asked = of_class(raw, "assistant").where((_type() == "message") & (_role() == "assistant")).select(
        *ids,
        F.coalesce(entry_ts(), message_ts()).alias("at_us"),
        F.posexplode(V.items("rec", "$.message.content")).alias("pos", "b"),
    )
    blocks = asked.where(V.text("b", "$.type") == "toolCall").select(
        *ids,
        F.col("pos").cast("bigint").alias("sub"),
        F.lit("block").alias("op"),
        V.text("b", "$.id").alias("call_id"),
        F.coalesce(V.text("b", "$.name"), F.lit("")).alias("tool"),
        V.json("b", "$.arguments").alias("args"),
        "at_us",
    )
    results = of_class(raw, "result").where((_type() == "message") & (_role() == "toolResult")).select(
        *ids,
        _zero().alias("sub"),
        F.lit("result").alias("op"),
        V.text("rec", "$.message.toolCallId").alias("call_id"),
        F.lit(None).cast("string").alias("tool"),
        F.lit(None).cast("string").alias("args"),
        F.coalesce(message_ts(), entry_ts()).alias("at_us"),
        V.json("rec", "$.message.details").alias("details"),
        F.coalesce(V.flag("rec", "$.message.isError"), F.lit(False)).alias("failed"),
    )
    starts = execs.unionByName(blocks)
    return starts.unionByName(results, allowMissingColumns=True).where("call_id IS NOT NULL")


def calls(records: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row per call and use of its id, merged from its records in one shuffle.

    The last execution start sets tool and start time, else the first request does. Arguments:
    the last request that has any, else the first execution start that has any.
    """
    is_result = (F.col("op") == "result").cast("bigint")
    order = F.struct("line_no", "sub")
    exec_, block, result = (F.col("op") == o for o in ("exec", "block", "result"))
    asked = F.when(block & F.col("args").isNotNull(), F.struct("args"))
    numbered = (
        ordered(records, ("who", "call_id"), ("line_no", "sub"), block_rows)
        .scan(_g=running_sum(is_result, inclusive=False))
        .with_column("gen", F.coalesce("_g", _zero()))
        .with_column("_asked", F.when(asked.isNotNull(), F.struct("gen", "args")))
        .scan(_known=running_last("_asked"))
        .df
    )
    seen = F.when(F.col("_known.gen") == F.col("gen"), F.col("_known.args"))
    at_start = F.try_parse_json(F.coalesce(seen, F.col("args")))
    label = F.when(exec_, K.window_label(F.col("tool"), V.text(at_start, "$.path")))
    grouped = (
        numbered.withColumn("_label", label)
        .groupBy("who", "call_id", "gen")
        .agg(
            F.coalesce(F.max_by("tool", F.when(exec_, order)), F.min_by("tool", F.when(block, order))).alias("tool"),
            F.coalesce(F.max_by("at_us", F.when(exec_, order)), F.min_by("at_us", F.when(block, order))).alias("start_us"),
            F.coalesce(
                F.max_by("args", F.when(block & F.col("args").isNotNull(), order)),
                F.min_by("args", F.when(exec_ & F.col("args").isNotNull(), order)),
            ).alias("args_json"),
            F.max_by("_label", F.when(F.col("_label").isNotNull(), order)).alias("label"),
            F.min_by("at_us", F.when(F.col("_label").isNotNull(), order)).alias("opened_us"),
            F.min(F.when(F.col("_label").isNotNull(), F.col("line_no"))).alias("open_line"),
            F.min(F.when(~result, F.col("line_no"))).alias("call_line"),
            F.min(F.when(result, F.col("line_no"))).alias("line_no"),
            F.min(F.when(result, F.col("at_us"))).alias("end_us"),
            F.max("details").alias("details_json"),
            F.max("failed").alias("failed"),
        )
        .where("call_line IS NOT NULL")
    )
    return grouped.withColumns(
        {"args": F.try_parse_json("args_json"), "details": F.try_parse_json("details_json")}
    ).drop("args_json", "details_json")


def window_ops(done: DataFrame) -> DataFrame:
    opens = done.where("label IS NOT NULL").select(
        "who", "call_id", F.col("open_line").alias("line_no"), F.col("opened_us").alias("at_us"), F.lit("open").alias("op")
    )
    closes = done.where("line_no IS NOT NULL").select(
        "who", "call_id", "line_no", F.col("end_us").alias("at_us"), F.lit("close").alias("op")
    )
    return opens.unionByName(closes)


def call_input(tool: Column, args: Column) -> Column:
    """What the call was given: its command, code or content, else all arguments as JSON."""
    picked = None
    for name, field in K.INPUT_FIELD.items():
        value = V.text(args, f"$.{field}")
        picked = F.when(tool == name, value) if picked is None else picked.when(tool == name, value)
    return F.coalesce(picked, V.json(args), F.lit(""))


def call_table(done: DataFrame) -> DataFrame:
    """Known calls: (who, call_id, tool, input). A result may name the tool better."""
    d, tool, finished = F.col("details"), F.col("tool"), F.col("line_no").isNotNull()
    device = finished & (tool == "write") & (V.text(d, "$.xdev.tool") == "resolve")
    inner = F.when(device, V.text(d, "$.xdev.inner.sourceToolName"))
    said = F.concat_ws("\n", V.text(d, "$.xdev.inner.label"), V.text(d, "$.xdev.args.reason"))
    is_mcp = finished & tool.startswith("mcp__")
    server, name = mcp_names()
    label = F.when(inner.isNotNull(), inner).when(is_mcp, K.mcp_label(server, name)).otherwise(F.col("label"))
    given = (
        F.when(inner.isNotNull(), said)
        .when(is_mcp, F.coalesce(V.json("args"), F.lit("null")))
        .otherwise(call_input(tool, F.col("args")))
    )
    rows = done.select("who", "call_id", "gen", label.alias("tool"), given.alias("input")).where("tool IS NOT NULL")
    last = F.max_by(F.struct("tool", "input"), F.col("gen"))
    return rows.groupBy("who", "call_id").agg(last.alias("c")).select("who", "call_id", "c.tool", "c.input")


def mcp_names() -> tuple[Column, Column]:
    server = F.coalesce(V.text("details", "$.serverName"), F.lit("mcp"))
    tool = F.coalesce(V.text("details", "$.mcpToolName"), F.regexp_replace("tool", r"\Amcp__", ""))
    return server, tool


def raw_intervals(raw: DataFrame, done: DataFrame) -> DataFrame:
    answered = of_class(raw, "assistant").where((_type() == "message") & (_role() == "assistant")).select(
        "who", message_ts().alias("start_us"), message_ts("completedAt").alias("end_us")
    )
    return answered.unionByName(done.select("who", "start_us", "end_us")).where(
        "start_us IS NOT NULL AND end_us IS NOT NULL"
    )


def read_paths() -> Column:
    """What a read really read: its source, else its resolved path, else its links, else the argument."""
    none = F.lit(None).cast("array<string>")
    source = F.when(V.text("details", "$.meta.source.type") == "path", V.text("details", "$.meta.source.value"))
    resolved = V.text("details", "$.resolvedPath")
    links = V.texts(V.items("details", "$.displayReadTargetLinks"))
    asked = V.text("args", "$.path")
    return F.coalesce(
        F.when(source.isNotNull(), F.array(source)).otherwise(none),
        F.when(resolved.isNotNull(), F.array(resolved)).otherwise(none),
        F.when(F.size(links) > 0, links).otherwise(none),
        F.when(asked.isNotNull(), F.array(asked)).otherwise(none),
    )


HEADER = r"\A\[(.*)#[0-9A-Fa-f]{4}\]\s*\z"


def edit_blocks(edits: DataFrame, text: str = "input", block_rows: int | None = None) -> DataFrame:
    """Blocks of an edit script: one row per header line ``[path#abcd]`` with what follows.

    Adds ``block``, ``path``, ``body``, ``moved_to`` and ``removed``. The block number is a
    running count of header lines; each block then aggregates its own lines, which all come
    from one record.
    """
    keys = [c for c in edits.columns if c != text]
    edits = edits.withColumn("_id", F.monotonically_increasing_id()) if not keys else edits
    body = F.regexp_replace(F.col(text), r"\r?\n\z", "")
    lines = edits.select(*keys, F.posexplode(F.split(body, r"\r?\n")).alias("pos", "line"))
    line = F.col("line")
    path = F.when(line.rlike(HEADER), F.regexp_extract(line, HEADER, 1))
    numbered = ordered(lines, keys, ("pos",), block_rows).scan(block=running_sum(line.rlike(HEADER).cast("bigint")))
    is_move, is_gone = line.startswith("MV "), F.trim(line) == "REM"
    plain = F.when(path.isNull() & ~is_move & ~is_gone, F.struct("pos", "line"))
    blocks = numbered.df.where("block > 0").groupBy(*keys, "block").agg(
        F.max(path).alias("path"),
        F.max_by(F.trim(F.substring("line", 4, 1 << 30)), F.when(is_move, F.col("pos"))).alias("moved_to"),
        F.max(is_gone).alias("removed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(plain)), lambda s: s["line"]), "\n").alias("body"),
    )
    # A body starts with its first line that is not empty.
    return blocks.withColumn("body", F.regexp_replace("body", r"\A\n+", ""))


def touches(done: DataFrame, p: Params = DEFAULTS, targets: DataFrame | None = None) -> DataFrame:
    """File touches of finished calls. ``done`` carries the session's cwd as ``cwd``."""
    done = done.where("line_no IS NOT NULL")
    gives = emitted(F.col("tool"), F.col("failed"))
    ok = done.where(gives["events"])
    arg = lambda name: V.text("args", f"$.{name}")
    shells = done.where(gives["inferred"]).withColumn("script", arg("command"))
    cells = done.where(gives["cells"] & F.col("session").isNotNull() & arg("code").isNotNull())
    cell = K.eval_cell_name(arg("title"), arg("i"), arg("language"), F.col("start_us"), p.tz)
    server, mcp_tool = mcp_names()
    web = F.coalesce(arg("path").rlike(r"\Ahttps?://"), F.lit(False))
    reads = ok.where((F.col("tool") == "read") & ~F.coalesce(V.flag("details", "$.isDirectory"), F.lit(False)))
    files = reads.where(~web).select(*T.CARRIED, F.posexplode(read_paths()).alias("ord", "raw"))
    writes = ok.where("tool = 'write'").withColumn("_text", F.coalesce(arg("content"), F.lit("")))
    searches = ok.where((F.col("tool") == "web_search") & arg("query").isNotNull())
    return T.union(
        [
            T.inferred(shells, targets),
            T.touch(
                cells,
                "write",
                "eval",
                scope=F.lit("session"),
                rel=F.concat(P.without_extension(F.col("session")), F.lit("/eval/"), cell),
                detail=T.detail("written", content=arg("code")),
            ),
            T.mcp_touch(ok.where(F.col("tool").startswith("mcp__")), server, mcp_tool),
            T.touch(reads.where(web), "read", "read", scope=F.lit("webfetch"), rel=F.coalesce(V.text("details", "$.url"), arg("path"))),
            T.touch(files, "read", "read", raw=F.col("raw"), ord=F.col("ord")),
            T.touch(
                writes,
                "write",
                "write",
                raw=F.coalesce(V.text("details", "$.resolvedPath"), arg("path")),
                detail=T.detail("written", content=F.col("_text")),
                new_text=F.col("_text"),
            ),
            T.touch(
                searches,
                "read",
                "web_search",
                scope=F.lit("websearch"),
                rel=T.one_line(arg("query")),
                detail=T.detail("search", sources=V.web_sources(V.items("details", "$.response.sources"))),
            ),
            edit_touches(ok.where("tool = 'edit'")),
        ]
    )


def edit_touches(edits: DataFrame) -> DataFrame:
    """Edits: results per file, else one result, else the blocks of the script itself."""
    per_file = V.items("details", "$.perFileResults")
    many = edits.where(per_file.isNotNull()).select(*T.CARRIED, F.posexplode(per_file).alias("ord", "r"))
    rest = edits.where(per_file.isNull())
    one = rest.where(V.text("details", "$.path").isNotNull()).select(
        *T.CARRIED, F.lit(0).alias("ord"), F.col("details").alias("r")
    )
    results = many.unionByName(one)
    old, new = V.text("r", "$.oldText"), V.text("r", "$.newText")
    both = old.isNotNull() & new.isNotNull()
    script = rest.where(V.text("details", "$.path").isNull() & V.text("args", "$.input").isNotNull())
    blocks = edit_blocks(script.select(*T.CARRIED, V.text("args", "$.input").alias("input")))
    blocks = blocks.withColumn("ord", F.col("block") * 2)
    change = F.when(F.col("removed"), T.detail("removed")).otherwise(T.detail("diff", diff=F.col("body")))
    return T.union(
        [
            T.touch(
                results,
                "write",
                "edit",
                raw=V.text("r", "$.path"),
                ord=F.col("ord"),
                detail=T.detail("diff", diff=F.coalesce(V.text("r", "$.diff"), F.lit(""))),
                old_text=F.when(both, old),
                new_text=F.when(both, new),
            ),
            T.touch(blocks, "write", "edit", raw=F.col("path"), ord=F.col("ord"), detail=change),
            T.touch(
                blocks.where("moved_to IS NOT NULL"),
                "write",
                "edit",
                raw=F.col("path"),
                ord=F.col("ord") + 1,
                to_raw=F.col("moved_to"),
            ),
        ]
    )
