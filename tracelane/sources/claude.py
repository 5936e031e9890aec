"""Calls, touches, windows and session facts of the second transcript format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.functions import calls as K
from tracelane.functions.text import apply_edits
from tracelane.operators.content import patch_text, unified_diff
from tracelane.operators.intervals import generation_intervals
from tracelane.operators.ordered import ordered, running_sum
from tracelane.sources import touches as T
from tracelane.sources import variant as V
from tracelane.sources.raw import of_class
from tracelane.sources.rules import emitted, prompt_text_ok


def _type() -> Column:
    return V.text("rec", "$.type")


def entry_ts() -> Column:
    return K.parse_ts(V.text("rec", "$.timestamp"))


def session_facts(raw: DataFrame) -> DataFrame:
    """Rows for the session roll-up; only title records are read in full."""
    if "class" not in raw.columns:
        return _told(raw, entry_ts(), V.text("rec", "$.cwd"))
    plain = raw.where("class <> 'title'").withColumn("rec", F.lit(None).cast("variant"))
    return _told(plain, F.col("at_us"), F.col("cwd")).unionByName(
        _told(of_class(raw, "title"), F.col("at_us"), F.col("cwd"))
    )


def _told(raw: DataFrame, at: Column, cwd: Column) -> DataFrame:
    custom, auto = _type() == "custom-title", _type() == "ai-title"
    return raw.select(
        "who",
        "line_no",
        at.alias("at_us"),
        F.lit(None).cast("string").alias("id"),
        cwd.alias("cwd"),
        F.lit(None).cast("bigint").alias("header_us"),
        F.when(custom, V.text("rec", "$.customTitle")).when(auto, V.text("rec", "$.aiTitle")).alias("title"),
        F.when(custom, "custom").when(auto, "auto").alias("title_kind"),
        F.lit(False).alias("is_exit"),
        F.lit(None).cast("bigint").alias("recorded_us"),
    )


def entries(raw: DataFrame) -> DataFrame:
    """User and assistant records with a time."""
    if "class" in raw.columns:
        return of_class(raw, "user", "assistant").where("at_us IS NOT NULL")
    return raw.where(_type().isin("user", "assistant")).withColumn("at_us", entry_ts()).where("at_us IS NOT NULL")


def blocks(raw: DataFrame) -> DataFrame:
    """One row per content block of an entry, with the number of results in its record."""
    content = V.items("rec", "$.message.content")
    results = F.size(F.filter(content, lambda b: V.text(b, "$.type") == "tool_result"))
    return entries(raw).select(
        "who",
        "line_no",
        "at_us",
        _type().alias("entry"),
        results.alias("n_results"),
        F.when(results == 1, V.json("rec", "$.toolUseResult")).alias("result_json"),
        F.posexplode(content).alias("sub", "b"),
    )


def prompts(raw: DataFrame) -> DataFrame:
    """(who, at_us) of what a person typed: no tool results, nothing injected, no command wrappers.

    Only those of main transcripts are prompts.
    """
    parts = V.items("rec", "$.message.content")
    said = F.array_join(V.texts(F.filter(parts, lambda b: V.text(b, "$.type") == "text"), "$.text"), "\n")
    text = F.coalesce(F.when(parts.isNotNull(), said), V.text("rec", "$.message.content"))
    origin = V.text("rec", "$.origin.kind")
    own = (
        (_type() == "user")
        & ~F.coalesce(V.flag("rec", "$.isMeta"), F.lit(False))
        & (origin.isNull() | (origin == "human"))
        & ~F.coalesce(F.exists(parts, lambda b: F.coalesce(V.text(b, "$.type") == "tool_result", F.lit(False))), F.lit(False))
    )
    return entries(of_class(raw, "user")).where(own & prompt_text_ok(text)).select("who", "at_us")


def calls(raw: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row per call and use of its id; the first request counts while it is pending."""
    each = blocks(raw)
    uses = each.where((F.col("entry") == "assistant") & (V.text("b", "$.type") == "tool_use")).select(
        "who", "line_no", "sub", "at_us",
        F.lit("call").alias("op"),
        V.text("b", "$.id").alias("call_id"),
        F.coalesce(V.text("b", "$.name"), F.lit("")).alias("tool"),
        V.json("b", "$.input").alias("args"),
    )
    results = each.where((F.col("entry") == "user") & (V.text("b", "$.type") == "tool_result")).select(
        "who", "line_no", "sub", "at_us",
        F.lit("result").alias("op"),
        V.text("b", "$.tool_use_id").alias("call_id"),
        F.coalesce(V.flag("b", "$.is_error"), F.lit(False)).alias("failed"),
        F.col("result_json").alias("details"),
    )
    both = uses.unionByName(results, allowMissingColumns=True).where("call_id IS NOT NULL")
    is_result = (F.col("op") == "result").cast("bigint")
    order = F.struct("line_no", "sub")
    call, result = F.when(F.col("op") == "call", order), F.when(F.col("op") == "result", order)
    return (
        ordered(both, ("who", "call_id"), ("line_no", "sub"), block_rows)
        .scan(_g=running_sum(is_result, inclusive=False))
        .with_column("gen", F.coalesce("_g", F.lit(0).cast("bigint")))
        .df.groupBy("who", "call_id", "gen")
        .agg(
            F.min_by("tool", call).alias("tool"),
            F.min_by("args", call).alias("args_json"),
            F.min_by("at_us", call).alias("start_us"),
            F.min_by("line_no", call).alias("call_line"),
            F.min_by("line_no", result).alias("line_no"),
            F.min_by("at_us", result).alias("end_us"),
            F.min_by("details", result).alias("details_json"),
            F.coalesce(F.max("failed"), F.lit(False)).alias("failed"),
        )
        .where("call_line IS NOT NULL")
        .withColumns({"args": F.try_parse_json("args_json"), "details": F.try_parse_json("details_json")})
        .drop("details_json")
    )


def _label() -> Column:
    m = K.split_mcp(F.col("tool"))
    return F.when(F.col("tool") == "Bash", "bash").when(
        F.col("tool").startswith("mcp__"), K.mcp_label(m["server"], m["tool"])
    )


def window_ops(done: DataFrame) -> DataFrame:
    opens = done.where(_label().isNotNull()).select(
        "who", "call_id", F.col("call_line").alias("line_no"), F.col("start_us").alias("at_us"), F.lit("open").alias("op")
    )
    closes = done.where("line_no IS NOT NULL").select(
        "who", "call_id", "line_no", F.col("end_us").alias("at_us"), F.lit("close").alias("op")
    )
    return opens.unionByName(closes)


def call_table(done: DataFrame) -> DataFrame:
    given = F.when(F.col("tool") == "Bash", F.coalesce(V.text("args", "$.command"), F.lit(""))).otherwise(
        F.coalesce("args_json", F.lit("null"))
    )
    rows = done.select("who", "call_id", "gen", _label().alias("tool"), given.alias("input")).where("tool IS NOT NULL")
    last = F.max_by(F.struct("tool", "input"), F.col("gen"))
    return rows.groupBy("who", "call_id").agg(last.alias("c")).select("who", "call_id", "c.tool", "c.input")


def raw_intervals(raw: DataFrame, done: DataFrame, block_rows: int | None = None) -> DataFrame:
    is_assistant = F.col("class") == "assistant" if "class" in raw.columns else _type() == "assistant"
    timed = entries(raw).select("who", "at_us", "line_no", is_assistant.alias("is_assistant"))
    thinking = generation_intervals(timed, block_rows=block_rows)
    return thinking.unionByName(done.where("end_us IS NOT NULL").select("who", "start_us", "end_us"))


def _edits() -> Column:
    def one(e):
        return F.struct(
            F.coalesce(V.text(e, "$.old_string"), F.lit("")).alias("old"),
            F.coalesce(V.text(e, "$.new_string"), F.lit("")).alias("new"),
            F.coalesce(V.flag(e, "$.replace_all"), F.lit(False)).alias("all"),
        )

    many = F.coalesce(V.items("args", "$.edits"), F.array().cast("array<variant>"))
    return F.when(F.col("tool") == "Edit", F.array(one(F.col("args")))).otherwise(F.transform(many, one))


def _patch() -> Column:
    def hunk(h):
        n = lambda k: F.coalesce(V.whole(h, f"$.{k}"), F.lit(0).cast("bigint")).alias(k)
        lines = F.coalesce(V.texts(V.items(h, "$.lines")), F.array().cast("array<string>")).alias("lines")
        return F.struct(n("oldStart"), n("oldLines"), n("newStart"), n("newLines"), lines)

    return patch_text(F.transform(V.items("details", "$.structuredPatch"), hunk))


def touches(done: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """File touches of finished calls. ``done`` carries the session's cwd as ``cwd``."""
    done = done.where("line_no IS NOT NULL")
    arg = lambda name: V.text("args", f"$.{name}")
    res = lambda name: V.text("details", f"$.{name}")
    gives = emitted(F.when(F.col("tool") == "Bash", "bash").otherwise(F.col("tool")), F.col("failed"))
    shells = done.where(gives["inferred"]).withColumn("script", arg("command"))
    ok = done.where(gives["events"])
    m = K.split_mcp(F.col("tool"))
    path = F.coalesce(res("filePath"), arg("file_path"))
    original = res("originalFile")
    content = F.coalesce(arg("content"), res("content"), F.lit(""))
    edited = ok.where("tool IN ('Edit', 'MultiEdit')").withColumns({"_old": original, "_new": apply_edits(original, _edits())})
    written = ok.where("tool = 'Write'").withColumns({"_old": original, "_new": content})
    # Python compares texts only where the record has no patch of its own.
    plain = F.when((_patch() == "") & F.col("_old").isNotNull(), unified_diff("_old", "_new"))
    diff = F.coalesce(F.nullif(_patch(), F.lit("")), plain, F.lit(""))
    searches = ok.where((F.col("tool") == "WebSearch") & arg("query").isNotNull())
    hits = F.flatten(
        F.filter(
            F.transform(V.items("details", "$.results"), lambda r: V.items(r, "$.content")), lambda a: a.isNotNull()
        )
    )
    return T.union(
        [
            T.inferred(shells, targets),
            T.mcp_touch(ok.where(F.col("tool").startswith("mcp__")), m["server"], m["tool"]),
            T.touch(ok.where("tool = 'Read'"), "read", "read", raw=arg("file_path")),
            T.touch(
                written,
                "write",
                "write",
                raw=path,
                detail=F.when(F.col("_old").isNotNull(), T.detail("diff", diff=diff)).otherwise(
                    T.detail("written", content=F.col("_new"))
                ),
                old_text=F.col("_old"),
                new_text=F.col("_new"),
            ),
            T.touch(
                edited,
                "write",
                "edit",
                raw=path,
                detail=T.detail("diff", diff=diff),
                old_text=F.col("_old"),
                new_text=F.col("_new"),
            ),
            T.touch(ok.where("tool = 'NotebookEdit'"), "write", "edit", raw=arg("notebook_path")),
            T.touch(
                ok.where((F.col("tool") == "WebFetch") & arg("url").isNotNull()), "read", "read", scope=F.lit("webfetch"), rel=arg("url")
            ),
            T.touch(
                searches,
                "read",
                "web_search",
                scope=F.lit("websearch"),
                rel=T.one_line(arg("query")),
                detail=T.detail("search", sources=V.web_sources(hits)),
            ),
        ]
    )
