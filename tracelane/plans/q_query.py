"""Queries on events, sessions, filters and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelane.functions.actions import ActionFilter, action_key, is_script
from tracelane.functions.text import smartcase
from tracelane.operators import pairing as PR
from tracelane.operators import sessions as Q
from tracelane.plans import shims as S
from tracelane.plans.shims import with_sql

REGISTERED: dict = {}


def register(name, sql=None):
    def add(fn):
        REGISTERED[name] = (fn, sql)
        return fn

    return add


_SCRIPT = "lower(regexp_extract(rel, '[^/]\\.([^./]+)$', 1)) IN ('sh','bash','zsh','fish','py','js','mjs','cjs','ts','rb','pl','lua','ps1')"
_KEY = """CASE source WHEN 'tool' THEN CASE WHEN tool = 'read' AND scope = 'webfetch' THEN 'fetch'
    WHEN tool IN ('eval', 'read', 'write', 'edit', 'mcp') THEN tool WHEN tool = 'web_search' THEN 'search'
    WHEN kind = 'read' THEN 'read' ELSE 'write' END
    WHEN 'window' THEN 'fs during ' || tool WHEN 'inferred' THEN 'inferred' ELSE 'fs' END"""

FILTER = ActionFilter(frozenset({"write", "fetch", "fs", "eval"}), frozenset({"bash"}), scripts_only=True)
_MATCH = f"""(({_KEY}) IN ('write', 'fetch', 'fs', 'eval', 'fs during bash')
    AND (({_KEY}) IN ('fetch', 'eval') OR {_SCRIPT}))"""
_HIDDEN = "who IN (SELECT who FROM parts WHERE session % 3 = 1)"


@register("action_class", with_sql("fx", f"SELECT event_id, {_KEY} AS action FROM fx"))
def action_class(spark, sf):
    return S.fx(spark, sf).select("event_id", action_key().alias("action"))


@register("script_files", with_sql("fx", f"SELECT rel, CAST({_SCRIPT} AS BIGINT) AS script, count(*) AS n FROM fx GROUP BY ALL"))
def script_files(spark, sf):
    return (
        S.fx(spark, sf)
        .groupBy("rel", is_script().cast("bigint").alias("script"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register("action_filter", with_sql("fx", f"SELECT event_id FROM fx WHERE {_MATCH}"))
def action_filter(spark, sf):
    return S.fx(spark, sf).where(FILTER.matches()).select("event_id")


def _selected(spark, sf):
    """The sessions picked in the session filter."""
    return S.participants(spark, sf).where("session % 3 <> 1").select("session").distinct()


@register("session_filter", with_sql("fx parts", f"SELECT event_id, who FROM fx WHERE NOT {_HIDDEN}"))
def session_filter(spark, sf):
    shown = Q.session_filter(S.fx(spark, sf), S.participants(spark, sf), _selected(spark, sf), you=-1)
    return shown.select("event_id", "who")


def _visible(spark, sf):
    return Q.visible_events(S.fx(spark, sf), S.participants(spark, sf), _selected(spark, sf), FILTER, you=-1)


@register(
    "active_participants",
    with_sql("fx parts", f"SELECT who, session, kind FROM parts WHERE who IN (SELECT who FROM fx WHERE {_MATCH} AND NOT {_HIDDEN})"),
)
def active_participants(spark, sf):
    active, _ = Q.active_participants(_visible(spark, sf), S.participants(spark, sf))
    return active.select("who", "session", "kind")


@register(
    "active_sessions",
    with_sql(
        "fx parts",
        f"SELECT DISTINCT session FROM parts WHERE who IN (SELECT who FROM fx WHERE {_MATCH} AND NOT {_HIDDEN})",
    ),
)
def active_sessions(spark, sf):
    return Q.active_participants(_visible(spark, sf), S.participants(spark, sf))[1]


@register(
    "touched_only",
    """SELECT p_partkey, p_brand || '/' || p_type || '/' || p_name AS rel FROM part
    WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def touched_only(spark, sf):
    from tracelane.operators.tree import touched_only as keep

    touches = S.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return keep(S.tp(spark, sf), touches, "p_partkey")


@register(
    "error_rules",
    with_sql(
        "ev",
        """
    WITH r AS (SELECT *, k % 4 = 0 AS failed, ['read', 'bash', 'eval', 'mcp__a__b'][k % 3 + 1 + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END] AS tool
      FROM ev)
    SELECT tool, failed, count(*) AS calls, count(*) AS intervals,
      count(*) FILTER (WHERE tool IN ('bash', 'eval') OR tool LIKE 'mcp__%') AS closed,
      count(*) FILTER (WHERE tool = 'bash') AS inferred, count(*) FILTER (WHERE tool = 'eval') AS cells,
      count(*) FILTER (WHERE NOT failed AND tool NOT IN ('bash', 'eval')) AS events FROM r GROUP BY ALL""",
    ),
)
def error_rules(spark, sf):
    from tracelane.sources.rules import emitted

    k = F.col("k")
    tools = F.array(*[F.lit(t) for t in ("read", "bash", "eval", "mcp__a__b")])
    pick = k % 3 + 1 + F.when(k % 8 == 0, 1).otherwise(0)
    results = (
        S.ev(spark, sf)
        .select((k % 4 == 0).alias("failed"), F.element_at(tools, pick).alias("tool"))
    )
    out = emitted(F.col("tool"), F.col("failed"))
    return results.groupBy("tool", "failed").agg(
        F.count(F.lit(1)).alias("calls"), *[F.count_if(c).alias(n) for n, c in out.items()]
    )


@register(
    "prompts",
    """SELECT conv_id AS session, turn AS line_no FROM conversations
    WHERE role = 'user' AND trim(text) <> '' AND NOT starts_with(trim(text), '<')""",
)
def prompts(spark, sf):
    from tracelane.sources.rules import prompt_text_ok

    return S.conv(spark, sf).where((F.col("role") == "user") & prompt_text_ok(F.col("text"))).select("session", "line_no")


@register(
    "session_rollup",
    with_sql(
        "ev parts",
        """SELECT p.session, min(at_us) AS start_us, max(at_us) AS last_seen_us, min_by('/p/' || (k % 5), (at_us, event_id)) FILTER (WHERE k % 2 = 0) AS cwd,
      count(*) FILTER (WHERE event_type = 'click') AS n_prompts, count(*) FILTER (WHERE event_type <> 'click') AS n_events,
      count(DISTINCT e.who) FILTER (WHERE e.who <> p.main) AS n_subagents
    FROM ev e JOIN parts p USING (who) GROUP BY p.session""",
    ),
)
def session_rollup(spark, sf):
    e = S.ev(spark, sf).join(S.participants(spark, sf).select("who", "session", "main"), "who")
    records = e.select(
        "session",
        "who",
        "at_us",
        F.col("event_id").alias("ord"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("/p/"), (F.col("k") % 5).cast("string"))).alias("cwd"),
        (F.col("event_type") == "click").alias("is_prompt"),
        (F.col("event_type") != "click").alias("is_event"),
        (F.col("who") == F.col("main")).alias("is_main"),
    )
    return Q.session_rollup(records)


@register(
    "conversation_rollup",
    """SELECT conv_id AS session, min(turn) AS start_us, max(turn) AS last_seen_us, CAST(NULL AS VARCHAR) AS cwd,
      count(*) FILTER (WHERE role = 'user') AS n_prompts, count(*) FILTER (WHERE role = 'assistant') AS n_events, CAST(0 AS BIGINT) AS n_subagents
    FROM conversations GROUP BY conv_id""",
)
def conversation_rollup(spark, sf):
    c = S.conv(spark, sf)
    records = c.select(
        "session",
        F.lit("main").alias("who"),
        F.col("line_no").alias("at_us"),
        F.col("line_no").alias("ord"),
        F.lit(None).cast("string").alias("cwd"),
        (F.col("role") == "user").alias("is_prompt"),
        (F.col("role") == "assistant").alias("is_event"),
        F.lit(True).alias("is_main"),
    )
    return Q.session_rollup(records)


@register(
    "action_facets",
    with_sql(
        "fx parts",
        f"""SELECT action, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {_KEY} AS action, count(*) AS n FROM fx WHERE NOT {_HIDDEN} GROUP BY ALL
      UNION ALL SELECT unnest(['eval', 'write', 'fetch', 'fs', 'fs during bash']), 0) GROUP BY action""",
    ),
)
def action_facets(spark, sf):
    shown = Q.session_filter(S.fx(spark, sf), S.participants(spark, sf), _selected(spark, sf), you=-1)
    return Q.action_facets(shown, FILTER)


@register(
    "time_range",
    with_sql(
        "fx",
        f"""SELECT min(lo) AS lo_us, CASE WHEN abs(1706659195000000 - max(hi)) <= 60000000 THEN 1706659195000000 ELSE max(hi) END AS hi_us FROM (
      SELECT min(start_us) AS lo, max(end_us) AS hi FROM fx
      UNION ALL SELECT min(start_us), max(start_us) FROM fx WHERE source = 'watcher')""",
    ),
)
def time_range(spark, sf):
    f = S.fx(spark, sf)
    said = f.where("source = 'watcher'").select(F.col("start_us").alias("at_us"))
    return Q.time_range(f, None, said, None, now_us=1_706_659_195_000_000)


@register(
    "time_range_filtered",
    with_sql("fx", f"SELECT min(start_us) AS lo_us, max(end_us) AS hi_us FROM fx WHERE {_MATCH}"),
)
def time_range_filtered(spark, sf):
    return Q.time_range(S.fx(spark, sf).where(FILTER.matches()))


@register(
    "session_end",
    with_sql(
        "ev parts",
        """
    WITH r AS (SELECT p.session, event_id AS ord, event_type = 'error' AS x, CASE WHEN k % 9 <> 0 THEN at_us END AS rec FROM ev JOIN parts p USING (who)),
    a AS (SELECT session, max(ord) FILTER (WHERE x AND rec IS NOT NULL) AS xo, max(ord) FILTER (WHERE NOT x) AS oo,
      max_by(rec, ord) FILTER (WHERE x AND rec IS NOT NULL) AS rec FROM r GROUP BY session)
    SELECT session, CASE WHEN xo IS NOT NULL AND (oo IS NULL OR xo > oo) THEN rec END AS end_us FROM a""",
    ),
)
def session_end(spark, sf):
    e = S.ev(spark, sf).join(S.participants(spark, sf).select("who", "session"), "who")
    records = e.select(
        "session",
        F.col("event_id").alias("ord"),
        (F.col("event_type") == "error").alias("is_exit"),
        F.when(F.col("k") % 9 != 0, F.col("at_us")).alias("recorded_us"),
    )
    return Q.session_end(records)


_TITLE = "CASE WHEN length(text) % 5 = 0 THEN '' ELSE text END"


@register(
    "title_precedence",
    f"""
    WITH r AS (SELECT conv_id AS session, turn AS ord, {_TITLE} AS title,
      CASE WHEN length(text) % 3 = 0 THEN 'custom' WHEN length(text) % 3 = 1 THEN 'auto' END AS kind FROM conversations)
    SELECT session, coalesce(max_by(title, ord) FILTER (WHERE kind = 'custom' AND title <> ''),
      min_by(title, ord) FILTER (WHERE kind = 'auto' AND title <> ''), '(untitled)') AS title FROM r GROUP BY session""",
)
def title_precedence(spark, sf):
    n = F.length("text")
    records = S.conv(spark, sf).select(
        "session",
        F.col("line_no").alias("ord"),
        F.when(n % 5 == 0, "").otherwise(F.col("text")).alias("title"),
        F.when(n % 3 == 0, "custom").when(n % 3 == 1, "auto").alias("title_kind"),
    )
    return Q.titles(records)


def _sessions(spark, sf):
    e = S.ev(spark, sf)
    return e.groupBy(F.col("who").alias("session")).agg(
        F.min("at_us").alias("start_us"),
        F.max("at_us").alias("last_seen_us"),
        F.max(F.when((F.col("event_type") == "error") & (F.col("who") % 2 == 0), F.col("at_us"))).alias("end_us"),
    )


_SESSIONS = """s AS (SELECT who AS session, min(at_us) AS start_us, max(at_us) AS last_seen_us,
    max(CASE WHEN event_type = 'error' AND who % 2 = 0 THEN at_us END) AS end_us FROM ev GROUP BY who)"""


@register(
    "recency_rank",
    with_sql(
        "ev",
        f"WITH {_SESSIONS} SELECT session, row_number() OVER (ORDER BY last_seen_us DESC, start_us DESC, session) - 1 AS rank FROM s",
    ),
)
def recency_rank(spark, sf):
    return Q.recency(_sessions(spark, sf)).select("session", "rank")


@register(
    "subagent_ordinals",
    with_sql(
        "parts",
        "SELECT who, session, row_number() OVER (PARTITION BY session ORDER BY who) - 1 AS ordinal FROM parts WHERE kind <> 'main'",
    ),
)
def subagent_ordinals(spark, sf):
    people = S.participants(spark, sf).withColumn("ord", F.col("who"))
    return Q.subagent_ordinals(people).select("who", "session", "ordinal")


_NOW = 1_706_659_100_000_000


@register(
    "session_status",
    with_sql(
        "ev",
        f"""WITH {_SESSIONS}, l AS (SELECT *, end_us IS NULL AND {_NOW} - last_seen_us < 86400000000 AS live FROM s)
      SELECT session, start_us, CASE WHEN live THEN 'live' ELSE 'ended' END AS status,
      CASE WHEN NOT live THEN coalesce(end_us, last_seen_us) END AS shown_end_us FROM l""",
    ),
)
def session_status(spark, sf):
    from dataclasses import replace

    from tracelane.config import DEFAULTS

    out = Q.session_status(_sessions(spark, sf), _NOW, replace(DEFAULTS, live_within=86400))
    return out.select("session", "start_us", "status", "shown_end_us").orderBy("start_us")


@register(
    "detail_list",
    with_sql(
        "fx",
        "SELECT event_id, rel, end_us, row_number() OVER (PARTITION BY rel ORDER BY end_us DESC, event_id) AS pos FROM fx",
    ),
)
def detail_list(spark, sf):
    return Q.detail_items(S.fx(spark, sf).select("event_id", "rel", "end_us"), ("rel",))


@register(
    "row_lists",
    with_sql(
        "fx parts",
        """
    WITH i AS (SELECT who, 'span' AS item, start_us, end_us FROM fx WHERE source = 'tool'
      UNION ALL SELECT p.main, 'prompt', f.start_us, f.start_us FROM fx f JOIN parts p ON p.who = f.who WHERE f.source = 'window')
    SELECT who, item, start_us, end_us, row_number() OVER (PARTITION BY who ORDER BY end_us DESC, item DESC, start_us) AS pos FROM i""",
    ),
)
def row_lists(spark, sf):
    """Every participant's own list: their spans, and for a main the prompts of its session."""
    people = S.participants(spark, sf)
    prompts = S.fx(spark, sf, "signup").select("who", F.col("start_us").alias("at_us")).join(people.select("who", "session"), "who").select("session", "at_us")
    mains = people.select("session", F.col("main").alias("who")).distinct()
    return Q.row_lists(S.fx(spark, sf, "click", "view", "purchase"), prompts, mains)


@register(
    "nearest",
    with_sql(
        "fx",
        """
    WITH p AS (SELECT event_id AS probe_id, who, start_us AS at_us FROM fx WHERE source = 'window'),
    i AS (SELECT event_id, who, end_us FROM fx WHERE source = 'tool'),
    j AS (SELECT p.probe_id, p.who, p.at_us, i.event_id, i.end_us, row_number() OVER (PARTITION BY probe_id
      ORDER BY abs(i.end_us - p.at_us) // 1000000, i.end_us DESC, i.event_id) AS n FROM p JOIN i USING (who))
    SELECT probe_id, who, at_us, event_id, end_us FROM j WHERE n = 1""",
    ),
)
def nearest(spark, sf):
    f = S.fx(spark, sf)
    probes = f.where("source = 'window'").select(F.col("event_id").alias("probe_id"), "who", F.col("start_us").alias("at_us"))
    return Q.nearest(f.where("source = 'tool'").select("event_id", "who", "end_us"), probes)


def _nth_sql(forward: bool) -> str:
    test, order, far = (">", "", "max") if forward else ("<", "DESC", "min")
    return f"""
    WITH t AS (SELECT DISTINCT who, start_us AS t FROM fx WHERE source = 'tool'),
    p AS (SELECT event_id AS probe_id, who, start_us AS at_us FROM fx WHERE source = 'watcher'),
    j AS (SELECT probe_id, who, at_us, t, row_number() OVER (PARTITION BY probe_id ORDER BY t {order}) AS n FROM p JOIN t USING (who) WHERE t {test} at_us)
    SELECT probe_id, who, at_us, {far}(t) AS target_us FROM j WHERE n <= 4 GROUP BY ALL"""


def _nth(spark, sf, forward):
    f = S.fx(spark, sf)
    times = f.where("source = 'tool'").select("who", F.col("start_us").alias("at_us"))
    probes = f.where("source = 'watcher'").select(
        F.col("event_id").alias("probe_id"), "who", F.col("start_us").alias("at_us")
    )
    return Q.nth_activity(times, probes, 4, forward)


@register("nth_activity", with_sql("fx", _nth_sql(True)))
def nth_activity(spark, sf):
    return _nth(spark, sf, True)


@register("nth_activity_back", with_sql("fx", _nth_sql(False)))
def nth_activity_back(spark, sf):
    return _nth(spark, sf, False)


@register(
    "event_union",
    with_sql(
        "fx chg",
        """SELECT 'transcript' AS producer, source, kind, count(*) AS n, count(tool) AS with_tool FROM fx GROUP BY ALL
      UNION ALL SELECT 'changes', NULL, NULL, count(*), 0 FROM chg""",
    ),
)
def event_union(spark, sf):
    logs = S.fx(spark, sf).withColumn("producer", F.lit("transcript"))
    seen = S.chg(spark, sf).withColumn("producer", F.lit("changes"))
    return (
        Q.union_events(logs, seen)
        .groupBy("producer", "source", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.count("tool").alias("with_tool"))
    )


@register(
    "state_changes",
    with_sql(
        "ev",
        """SELECT event_id, who, at_us, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY who ORDER BY at_us, event_id) AS p,
      row_number() OVER (PARTITION BY who ORDER BY at_us, event_id) AS n FROM ev) WHERE n = 1 OR p IS DISTINCT FROM event_type""",
    ),
)
def state_changes(spark, sf):
    from tracelane.operators.content import dedup_states

    e = S.ev(spark, sf).select("event_id", "who", "at_us", "event_type")
    return dedup_states(e, ("who",), "at_us", "event_type", order=("at_us", "event_id"))


@register(
    "smartcase",
    with_sql(
        "tp",
        """SELECT p_partkey, contains(lower(rel), 'red') AS any_case, contains(rel, 'STAND') AS exact FROM tp
      WHERE contains(lower(rel), 'red') OR contains(rel, 'STAND')""",
    ),
)
def smartcase_match(spark, sf):
    rel = F.col("rel")
    hits = S.tp(spark, sf).select("p_partkey", smartcase(rel, "red").alias("any_case"), smartcase(rel, "STAND").alias("exact"))
    return hits.where("any_case OR exact")


# --- calls -----------------------------------------------------------------------------


@register(
    "call_pairs",
    with_sql(
        "ev",
        """
    WITH r AS (SELECT who, k % 5 AS call_id, event_id, at_us, event_type = 'purchase' AS res FROM ev WHERE event_type IN ('click', 'purchase')),
    g AS (SELECT *, coalesce(sum(CAST(res AS INT)) OVER (PARTITION BY who, call_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gen FROM r)
    SELECT who, call_id, min_by(at_us, event_id) FILTER (WHERE NOT res) AS start_us, min_by(at_us, event_id) FILTER (WHERE res) AS end_us,
      min(event_id) FILTER (WHERE NOT res) AS call_line, min(event_id) FILTER (WHERE res) AS result_line
    FROM g GROUP BY who, call_id, gen HAVING count(*) FILTER (WHERE NOT res) > 0""",
    ),
)
def call_pairs(spark, sf):
    t = F.col("event_type")
    records = (
        S.ev(spark, sf)
        .where(t.isin("click", "purchase"))
        .select(
            "who",
            (F.col("k") % 5).alias("call_id"),
            F.col("event_id").alias("line_no"),
            "at_us",
            F.when(t == "purchase", "result").otherwise("call").alias("role"),
        )
    )
    return PR.pair_calls(records)


_OPEN_CLOSE = """
    o AS (SELECT who, k % 20 AS call_id, event_id, at_us, event_type = 'click' AS op FROM ev WHERE event_type IN ('click', 'view')),
    f AS (SELECT who, call_id, min(event_id) AS ord, min_by(at_us, event_id) AS start_us FROM o WHERE op GROUP BY ALL),
    w AS (SELECT f.who, f.call_id, f.ord, f.start_us, min_by(o.at_us, o.event_id) AS end_us, min(o.event_id) AS end_line
      FROM f LEFT JOIN o ON o.who = f.who AND o.call_id = f.call_id AND NOT o.op AND o.event_id > f.ord GROUP BY ALL)"""


def _windows(spark, sf):
    t = F.col("event_type")
    records = (
        S.ev(spark, sf)
        .where(t.isin("click", "view"))
        .select(
            "who",
            (F.col("k") % 20).alias("call_id"),
            F.col("event_id").alias("line_no"),
            "at_us",
            F.when(t == "click", "open").otherwise("close").alias("op"),
        )
    )
    return PR.open_close(records)


@register("open_close", with_sql("ev", f"WITH {_OPEN_CLOSE} SELECT who, call_id, start_us, ord, end_us, end_line FROM w"))
def open_close(spark, sf):
    return _windows(spark, sf)


@register(
    "turn_close",
    with_sql(
        "ev",
        f"""
    WITH {_OPEN_CLOSE},
    t AS (SELECT who, event_id AS line, at_us FROM ev WHERE event_type = 'purchase'),
    n AS (SELECT w.who, w.call_id, w.ord, w.start_us, w.end_us, w.end_line, min(t.line) AS tl, min_by(t.at_us, t.line) AS ta
      FROM w LEFT JOIN t ON t.who = w.who AND t.line > w.ord GROUP BY ALL)
    SELECT who, call_id, start_us, CASE WHEN tl IS NOT NULL AND (end_line IS NULL OR tl < end_line) THEN ta ELSE end_us END AS end_us FROM n""",
    ),
)
def turn_close(spark, sf):
    ends = S.ev(spark, sf).where("event_type = 'purchase'").select("who", F.col("event_id").alias("line_no"), "at_us")
    out = PR.close_at_turn_end(_windows(spark, sf), ends, open_line="ord")
    return out.select("who", "call_id", "start_us", "end_us")


@register(
    "window_label",
    with_sql(
        "ev",
        """
    WITH c AS (SELECT event_id, ['bash', 'eval', 'ast_edit', 'lsp', 'write', 'write', 'task', 'mcp__git__log', 'read'][k % 9 + 1] AS tool,
      CASE WHEN k % 9 = 4 THEN '/src/a.py' WHEN k % 9 = 5 THEN 'xd://dev' || (k % 4) || '/x?y' END AS path FROM ev)
    SELECT event_id, CASE WHEN tool IN ('bash', 'eval', 'ast_edit', 'lsp') OR tool LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN tool
      WHEN tool = 'write' AND path LIKE 'xd://%' THEN regexp_extract(path, '^xd://([^/?]*)', 1) END AS label FROM c""",
    ),
)
def window_label(spark, sf):
    from tracelane.functions.calls import window_label as label

    k = F.col("k")
    names = ("bash", "eval", "ast_edit", "lsp", "write", "write", "task", "mcp__git__log", "read")
    tool = F.element_at(F.array(*[F.lit(n) for n in names]), k % 9 + 1)
    path = F.when(k % 9 == 4, "/src/a.py").when(
        k % 9 == 5, F.concat(F.lit("xd://dev"), (k % 4).cast("string"), F.lit("/x?y"))
    )
    return S.ev(spark, sf).select("event_id", label(tool, path).alias("label"))


@register(
    "activity_report",
    with_sql(
        "fx parts",
        f"""
    WITH v AS (SELECT * FROM fx WHERE NOT {_HIDDEN})
    SELECT p.session, count(*) AS n_events, count(DISTINCT v.rel) AS n_paths, count(DISTINCT v.who) AS n_people,
      count(*) FILTER (WHERE v.kind = 'write') AS n_writes, max(v.end_us) AS last_end_us
    FROM v JOIN parts p USING (who) GROUP BY p.session""",
    ),
)
def activity_report(spark, sf):
    """Visible events per session."""
    people = S.participants(spark, sf)
    shown = Q.session_filter(S.fx(spark, sf), people, _selected(spark, sf), you=-1)
    return (
        shown.join(people.select("who", "session"), "who")
        .groupBy("session")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_distinct("rel").alias("n_paths"),
            F.count_distinct("who").alias("n_people"),
            F.count_if(F.col("kind") == "write").alias("n_writes"),
            F.max("end_us").alias("last_end_us"),
        )
    )
