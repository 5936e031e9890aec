"""Queries on transcript records and streams.

The records are made from the benchmark's tables: each row becomes one JSON line of a
transcript, which the readers' operators then parse like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.config import US
from tracelane.functions import calls as K
from tracelane.functions import paths as P
from tracelane.operators import content as C
from tracelane.operators import roots as R
from tracelane.plans import shims as S
from tracelane.plans.model import main_prompts, sessions_of
from tracelane.plans.shims import with_sql
from tracelane.session import merged, shared_folder, staged
from tracelane.sources import changelog, claude, codex, omp, participants, raw
from tracelane.sources import touches as T
from tracelane.sources import variant as V
from tracelane.sources.committed import Committed
from tracelane.streaming import flows

REGISTERED: dict = {}


def register(name, sql=None):
    def add(fn):
        REGISTERED[name] = (fn, sql)
        return fn

    return add


def obj(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def line(value: Column) -> Column:
    """A struct as the VARIANT that its JSON line parses to; NULL fields are left out."""
    return F.try_parse_json(F.to_json(value))


def _records(df: DataFrame) -> DataFrame:
    """Parsed records are staged before use, as the model builder does: parsed once, read often."""
    return staged(df)


def iso(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


_CALLS = """
    r AS (SELECT who, 'c' || (k % 5) AS call_id, event_id, at_us, k, event_type AS t FROM ev),
    g AS (SELECT *, coalesce(sum(CASE WHEN t = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY who, call_id ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gen FROM r WHERE t IN ('click', 'view', 'purchase')),
    c AS (SELECT who, call_id, gen,
      coalesce(max_by('tool' || (k % 3), event_id) FILTER (WHERE t = 'view'), min_by('ask' || (k % 3), event_id) FILTER (WHERE t = 'click')) AS tool,
      coalesce(max_by(at_us, event_id) FILTER (WHERE t = 'view'), min_by(at_us, event_id) FILTER (WHERE t = 'click')) AS start_us,
      coalesce(max_by(k, event_id) FILTER (WHERE t = 'click' AND k % 4 <> 0), min_by(k, event_id) FILTER (WHERE t = 'view' AND k % 2 = 0)) AS n,
      min(at_us) FILTER (WHERE t = 'purchase') // 1000 * 1000 AS end_us, bool_or(t = 'purchase' AND k % 7 = 0) AS failed
      FROM g GROUP BY ALL HAVING count(*) FILTER (WHERE t <> 'purchase') > 0)"""


def _omp_records(spark, sf) -> DataFrame:
    """Clicks ask for a call, views start its execution, purchases bring its result."""
    e, t, k = S.ev(spark, sf), F.col("event_type"), F.col("k")
    cid, at = F.concat(F.lit("c"), (k % 5).cast("string")), iso(F.col("at_us"))
    args = obj(n=k)
    asked = obj(type="toolCall", id=cid, name=F.concat(F.lit("ask"), (k % 3).cast("string")), arguments=F.when(k % 4 != 0, args))
    message = obj(type="message", timestamp=at, message=obj(role="assistant", content=F.array(asked)))
    start = obj(
        type="custom", customType="tool_execution_start", timestamp=at,
        data=obj(toolCallId=cid, toolName=F.concat(F.lit("tool"), (k % 3).cast("string")), startedAt=at, args=F.when(k % 2 == 0, args)),
    )
    result = obj(
        type="message", timestamp=at,
        message=obj(role="toolResult", toolCallId=cid, timestamp=F.floor(F.col("at_us") / 1000), isError=k % 7 == 0),
    )
    user = obj(
        type="message", timestamp=at,
        message=obj(role="user", timestamp=F.floor(F.col("at_us") / 1000), attribution=F.when(k % 3 != 0, "user").otherwise("hook")),
    )
    other = obj(type="custom", customType="session_exit", timestamp=at, data=obj(recordedAt=at))
    rec = (
        F.when(t == "click", F.to_json(message))
        .when(t == "view", F.to_json(start))
        .when(t == "purchase", F.to_json(result))
        .when(t == "signup", F.to_json(user))
        .otherwise(F.to_json(other))
    )
    return _records(e.select(
        F.col("who").cast("string").alias("who"),
        F.floor(F.col("who") / 5).cast("string").alias("session"),
        (F.col("who") % 5 == 0).alias("is_main"),
        F.col("event_id").alias("line_no"),
        F.try_parse_json(rec).alias("rec"),
    ))


@register(
    "log_calls",
    with_sql(
        "ev",
        "WITH " + _CALLS.strip() + " SELECT CAST(who AS VARCHAR) AS who, call_id, tool, start_us, end_us, n, CASE WHEN end_us IS NOT NULL THEN failed END AS failed FROM c",
    ),
)
def log_calls(spark, sf):
    """Calls merged from their request, execution start and result records."""
    done = omp.calls(omp.call_records(_omp_records(spark, sf)))
    return done.select("who", "call_id", "tool", "start_us", "end_us", V.whole("args", "$.n").cast("int").alias("n"), "failed")


@register(
    "log_prompts",
    with_sql(
        "ev",
        "SELECT CAST(who // 5 AS VARCHAR) AS session, at_us // 1000 * 1000 AS at_us FROM ev WHERE event_type = 'signup' AND k % 3 <> 0 AND who % 5 = 0",
    ),
)
def log_prompts(spark, sf):
    records = _omp_records(spark, sf)
    return main_prompts(omp.prompts(records), records.select("who", "session", "is_main").distinct())


@register(
    "log_sessions",
    with_sql(
        "ev",
        """SELECT CAST(who // 5 AS VARCHAR) AS session, min(at_us) AS start_us, max(at_us) AS last_seen_us,
      CASE WHEN max(event_id) FILTER (WHERE event_type = 'error') > max(event_id) FILTER (WHERE event_type <> 'error')
        THEN max_by(at_us, event_id) FILTER (WHERE event_type = 'error') END AS end_us, '(untitled)' AS title FROM ev GROUP BY who // 5""",
    ),
)
def log_sessions(spark, sf):
    records = _omp_records(spark, sf)
    known = records.select("who", "session", "is_main", F.lit("omp").alias("harness")).distinct()
    return sessions_of(omp.session_facts(records).join(merged(known), "who")).select("session", "start_us", "last_seen_us", "end_us", "title")


@register(
    "log_intervals",
    with_sql(
        "ev",
        "WITH " + _CALLS.strip() + " SELECT CAST(who AS VARCHAR) AS who, start_us, end_us FROM c WHERE end_us IS NOT NULL",
    ),
)
def log_intervals(spark, sf):
    records = _omp_records(spark, sf)
    return omp.raw_intervals(records, omp.calls(omp.call_records(records)))


@register(
    "first_value_bounded",
    with_sql(
        "ev",
        """
    WITH n AS (SELECT who, k, row_number() OVER (PARTITION BY who ORDER BY event_id) - 1 AS line_no FROM ev)
    SELECT CAST(who AS VARCHAR) AS file, min_by('/p/' || (k % 5), line_no) AS cwd FROM n WHERE line_no < 50 AND k % 6 = 0 GROUP BY who""",
    ),
)
def first_value_bounded(spark, sf):
    """The launch folder: the first one mentioned within a transcript's first lines."""
    from tracelane.operators.ordered import ordered, running_sum

    n = ordered(S.ev(spark, sf), ("who",), ("event_id",)).scan(n=running_sum(F.lit(1).cast("bigint"))).df
    cwd = F.when(F.col("k") % 6 == 0, F.concat(F.lit("/p/"), (F.col("k") % 5).cast("string")))
    records = n.select(
        F.lit("claude").alias("harness"),
        F.lit("/t").alias("project_dir"),
        F.col("who").cast("string").alias("file"),
        (F.col("n") - 1).alias("line_no"),
        line(obj(type="user", cwd=cwd)).alias("rec"),
    )
    return raw.launch_cwds(records).select("file", "cwd")


_FILES = """f AS (SELECT page_id, ['/s/p/s' || (page_id // 8) || '.jsonl', '/s/p/s' || (page_id // 8) || '/__advisor.jsonl',
    '/s/p/s' || (page_id // 8) || '/h' || page_id || '.jsonl', '/s/p/s' || (page_id // 8) || '/h/deep' || page_id || '.v2.jsonl'][page_id % 4 + 1] AS who FROM pages)"""


@register(
    "file_roles",
    f"""WITH {_FILES}, d AS (SELECT DISTINCT who, page_id // 8 AS s FROM f JOIN (SELECT page_id FROM pages) USING (page_id))
    SELECT who, CASE WHEN who LIKE '%/\\_\\_advisor.jsonl' ESCAPE '\\' THEN 'advisor' WHEN who = '/s/p/s' || s || '.jsonl' THEN 'main' ELSE 'subagent' END AS kind,
      CASE WHEN who LIKE '%/\\_\\_advisor.jsonl' ESCAPE '\\' THEN 'advisor' WHEN who = '/s/p/s' || s || '.jsonl' THEN 'main' ELSE regexp_extract(who, '([^/]*)\\.jsonl$', 1) END AS label,
      '/s/p/s' || s || '.jsonl' AS session, CASE WHEN who <> '/s/p/s' || s || '.jsonl' THEN regexp_replace(who, '/[^/]*$', '') || '.jsonl' END AS parent FROM d""",
)
def file_roles(spark, sf):
    n = F.col("page_id")
    top = F.concat(F.lit("/s/p/s"), F.floor(n / 8).cast("string"))
    names = F.array(
        F.concat(top, F.lit(".jsonl")),
        F.concat(top, F.lit("/__advisor.jsonl")),
        F.concat(top, F.lit("/h"), n.cast("string"), F.lit(".jsonl")),
        F.concat(top, F.lit("/h/deep"), n.cast("string"), F.lit(".v2.jsonl")),
    )
    files = S.pg(spark, sf).select(
        F.lit("omp").alias("harness"), F.lit("/s/p").alias("project_dir"), F.element_at(names, (n % 4 + 1).cast("int")).alias("file")
    )
    return participants.omp_participants(files).select("who", "kind", "label", "session", "parent")


def _entries(spark, sf) -> DataFrame:
    """Conversations as transcripts: every answer asks for two calls, the next turn answers."""
    c, n = S.conv(spark, sf), F.col("line_no")
    size = F.length("text")
    none = F.lit(None)

    def block(type, text=none, id=none, name=none, command=none, number=none):
        given = obj(command=command.cast("string"), n=number.cast("int"))
        given = F.when(F.lit(type == "tool_use"), given)
        return obj(type=type, text=text.cast("string"), id=id.cast("string"), name=name.cast("string"), input=given)

    uses = F.array(
        block("text", text=F.col("text")),
        block("tool_use", id=F.concat(F.lit("a"), n.cast("string")), name=F.lit("Bash"), command=F.concat(F.lit("ssh h"), size.cast("string"))),
        block("tool_use", id=F.concat(F.lit("b"), n.cast("string")), name=F.lit("mcp__srv__do"), number=size),
    )
    results = F.array(
        *[
            obj(type="tool_result", tool_use_id=F.concat(F.lit(p), (n - 1).cast("string")), is_error=size % 3 == 0)
            for p in "ab"
        ]
    )
    at = iso(n * US)
    role = F.col("role")
    rec = F.when(role == "assistant", F.to_json(obj(type="assistant", timestamp=at, message=obj(content=uses)))).when(
        (role == "user") & (n > 0), F.to_json(obj(type="user", timestamp=at, message=obj(content=results)))
    )
    first = obj(type="user", timestamp=at, message=obj(content=F.col("text")))
    return _records(c.select(
        F.col("session").cast("string").alias("who"),
        F.col("session").cast("string").alias("session"),
        F.lit(True).alias("is_main"),
        "line_no",
        F.try_parse_json(F.coalesce(rec, F.to_json(first))).alias("rec"),
    ))


@register(
    "content_blocks",
    """
    WITH c AS (SELECT conv_id, turn, role FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS who, turn AS line_no, unnest(CASE WHEN role = 'assistant' THEN ['text', 'tool_use', 'tool_use'] WHEN turn > 0 THEN ['tool_result', 'tool_result'] ELSE [] END) AS block,
      unnest(CASE WHEN role = 'assistant' THEN [0, 1, 2] WHEN turn > 0 THEN [0, 1] ELSE [] END) AS sub,
      CASE WHEN role = 'assistant' OR turn = 0 THEN 0 ELSE 2 END AS n_results FROM c WHERE role IN ('user', 'assistant')""",
)
def content_blocks(spark, sf):
    out = claude.blocks(_entries(spark, sf))
    return out.select("who", "line_no", V.text("b", "$.type").alias("block"), "sub", "n_results")


_ANSWERED = """
    a AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'assistant'),
    u AS (SELECT conv_id, turn, length(text) % 3 = 0 AS failed FROM conversations WHERE role = 'user' AND turn > 0),
    p AS (SELECT a.conv_id, a.turn, a.n, u.turn AS done, u.failed FROM a LEFT JOIN u ON u.conv_id = a.conv_id AND u.turn = a.turn + 1)"""


@register(
    "entry_calls",
    "WITH " + _ANSWERED.strip() + """
    SELECT CAST(conv_id AS VARCHAR) AS who, unnest(['a' || turn, 'b' || turn]) AS call_id, unnest(['Bash', 'mcp__srv__do']) AS tool,
      turn * 1000000 AS start_us, done * 1000000 AS end_us, coalesce(failed, false) AS failed FROM p""",
)
def entry_calls(spark, sf):
    return claude.calls(_entries(spark, sf)).select("who", "call_id", "tool", "start_us", "end_us", "failed")


@register(
    "entry_touches",
    "WITH " + _ANSWERED.strip() + """
    SELECT CAST(conv_id AS VARCHAR) AS who, 'a' || turn AS call_id, 'remote' AS scope, 'ssh://h' || n AS rel, 'inferred' AS source, done * 1000000 AS end_us FROM p WHERE done IS NOT NULL
    UNION ALL SELECT CAST(conv_id AS VARCHAR), 'b' || turn, 'mcp', 'srv/do', 'tool', done * 1000000 FROM p WHERE NOT failed""",
)
def entry_touches(spark, sf):
    """File events of finished calls: commands still count when they failed, MCP calls do not."""
    done = claude.calls(_entries(spark, sf)).withColumns({"cwd": F.lit("/"), "session": F.col("who")})
    size = V.text("args", "$.command")
    targets = done.where("tool = 'Bash'").select("who", "call_id", F.regexp_replace(size, "^ssh ", "ssh://").alias("target"), F.lit("read").alias("access"), F.lit(0).alias("ord"))
    return claude.touches(done, targets).select("who", "call_id", "scope", "rel", "source", "end_us")


@register(
    "entry_prompts",
    """SELECT CAST(conv_id AS VARCHAR) AS session, turn * 1000000 AS at_us FROM conversations
    WHERE (turn = 0 OR role NOT IN ('user', 'assistant')) AND trim(text) <> '' AND NOT starts_with(trim(text), '<')""",
)
def entry_prompts(spark, sf):
    records = _entries(spark, sf)
    return main_prompts(claude.prompts(records), records.select("who", "session", "is_main").distinct())


def _rollout(spark, sf) -> DataFrame:
    """Documents as changed files: each row is one finished item with one to three changes."""
    d, n = S.table(spark, sf, "documents"), F.col("doc_id")
    kind = F.when(n % 3 == 0, "add").when(n % 3 == 1, "delete").otherwise("update")
    change = obj(
        type=kind,
        content=F.when(n % 3 != 2, F.col("text")),
        unified_diff=F.when(n % 3 == 2, F.concat(F.lit("@@ -1 +1 @@\n-"), F.col("text"))),
        move_path=F.when(n % 6 == 5, F.concat(F.lit("moved/"), n.cast("string"))),
    )
    item = obj(
        type="FileChange",
        id=F.concat(F.lit("f"), n.cast("string")),
        status=F.when(n % 10 == 9, "failed").otherwise("completed"),
        changes=F.create_map(F.concat("source", F.lit("/"), n.cast("string")), change),
    )
    payload = obj(type="item_completed", started_at_ms=n * 1000, completed_at_ms=n * 1000 + 500, item=item)
    rec = obj(timestamp=iso(n * US), type="event_msg", payload=payload)
    return _records(d.select(
        F.col("source").alias("who"),
        F.col("source").alias("session"),
        F.lit(True).alias("is_main"),
        F.col("doc_id").alias("line_no"),
        line(rec).alias("rec"),
        F.when(n % 2 == 0, "paginated").alias("mode"),
        (n * US).alias("at_us"),
        F.lit("event_msg").alias("ty"),
        F.lit("item_completed").alias("pty"),
    ))


@register(
    "file_changes",
    """
    WITH d AS (SELECT *, doc_id % 3 AS m FROM documents WHERE doc_id % 10 <> 9)
    SELECT source AS who, 'f' || doc_id AS call_id, source || '/' || doc_id AS raw, CASE m WHEN 0 THEN 'write' ELSE 'edit' END AS tool,
      CASE m WHEN 0 THEN 'written' WHEN 1 THEN 'removed' ELSE 'diff' END AS type, md5(CASE WHEN m = 0 THEN text END) AS new_digest,
      md5(CASE WHEN m = 1 THEN text END) AS old_digest, CAST(NULL AS VARCHAR) AS to_raw, doc_id * 1000000 AS start_us, doc_id * 1000000 + 500000 AS end_us FROM d
    UNION ALL SELECT source, 'f' || doc_id, source || '/' || doc_id, 'edit', 'none', NULL, NULL, 'moved/' || doc_id, doc_id * 1000000, doc_id * 1000000 + 500000 FROM d WHERE doc_id % 6 = 5""",
)
def file_changes(spark, sf):
    cwds = S.table(spark, sf, "documents").select(F.col("source").alias("session"), F.lit("/w").alias("cwd")).distinct()
    out = codex.touches(_rollout(spark, sf), cwds, "/").where("kind = 'write'")
    return out.select(
        "who", "call_id", "raw", "tool", "detail.type", F.md5("new_text").alias("new_digest"), F.md5("old_text").alias("old_digest"), "to_raw", "start_us", "end_us"
    )


@register(
    "history_mode",
    """SELECT doc_id AS line_no FROM documents WHERE doc_id % 4 <> 2""",
)
def history_mode(spark, sf):
    """Records of one shape, unless their file declares the other."""
    d = S.table(spark, sf, "documents")
    mode = F.when(F.col("doc_id") % 4 == 2, "legacy").when(F.col("doc_id") % 4 == 1, "paginated")
    return d.select(F.col("doc_id").alias("line_no"), mode.alias("mode")).where(codex.history_ok("paginated")).select("line_no")


# --- names and arguments ---------------------------------------------------------------


@register(
    "mcp_names",
    with_sql(
        "ev",
        """SELECT event_id, ['srv', 'mcp', 'a'][k % 3 + 1] AS server, ['do_it', 'plain', 'b__c'][k % 3 + 1] AS tool,
      'mcp:' || ['srv/do_it', 'mcp/plain', 'a/b__c'][k % 3 + 1] AS label FROM ev""",
    ),
)
def mcp_names(spark, sf):
    names = F.array(*[F.lit(n) for n in ("mcp__srv__do_it", "mcp__plain", "mcp__a__b__c")])
    out = S.ev(spark, sf).select("event_id", K.split_mcp(F.element_at(names, F.col("k") % 3 + 1)).alias("m"))
    return out.select("event_id", "m.server", "m.tool", K.mcp_label(F.col("m.server"), F.col("m.tool")).alias("label"))


@register(
    "argv_scripts",
    with_sql(
        "pg",
        """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'curl ' || url WHEN 1 THEN 'curl ' || url WHEN 2 THEN 'bash -x curl ' || url ELSE 'sh -c' END AS script FROM pg""",
    ),
)
def argv_scripts(spark, sf):
    n = F.col("page_id") % 4
    get = F.concat(F.lit("curl "), F.col("url"))
    argv = (
        F.when(n == 0, F.array(F.lit("/bin/bash"), F.lit("-lc"), get))
        .when(n == 1, F.array(F.lit("curl"), F.col("url")))
        .when(n == 2, F.array(F.lit("bash"), F.lit("-x"), F.lit("curl"), F.col("url")))
        .otherwise(F.array(F.lit("sh"), F.lit("-c")))
    )
    return S.pg(spark, sf).select("page_id", K.argv_script(argv).alias("script"))


@register(
    "call_inputs",
    with_sql(
        "pg",
        """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN '{"n":' || page_id || ',"path":"' || url || '"}' ELSE '' END AS input FROM pg""",
    ),
)
def call_inputs(spark, sf):
    n, url = F.col("page_id") % 4, F.col("url")
    tool = F.when(n == 0, "bash").when(n == 1, "eval").when(n == 2, "read").otherwise("write")
    args = F.when(n == 0, F.to_json(obj(command=url))).when(n == 1, F.to_json(obj(code=url, language="py"))).when(
        n == 2, F.to_json(obj(path=url, n=F.col("page_id")))
    )
    calls = S.pg(spark, sf).select("page_id", tool.alias("tool"), F.try_parse_json(args).alias("args"))
    return calls.select("page_id", omp.call_input(F.col("tool"), F.col("args")).alias("input"))


@register(
    "eval_cells",
    with_sql(
        "ev",
        """
    WITH c AS (SELECT event_id, at_us, CASE k % 4 WHEN 0 THEN 'plot a-b-c' WHEN 1 THEN repeat('x', 80) WHEN 2 THEN 'line one' ELSE '' END AS label, CASE k % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'js' ELSE 'txt' END AS ext FROM ev)
    SELECT event_id, strftime(make_timestamp(at_us + 3600000000), '%H:%M:%S') || CASE WHEN label <> '' THEN ' ' || label ELSE '' END || '.' || ext AS name FROM c""",
    ),
)
def eval_cells(spark, sf):
    k = F.col("k")
    title = F.when(k % 4 == 0, "plot a/b\\c").when(k % 4 == 1, F.repeat(F.lit("x"), 80)).when(k % 4 == 2, " line\tone ").otherwise(" ")
    language = F.when(k % 3 == 0, "py").when(k % 3 == 1, "js").otherwise("rust")
    name = K.eval_cell_name(title, F.lit(None).cast("string"), language, F.col("at_us"), "+01:00")
    return S.ev(spark, sf).select("event_id", name.alias("name"))


@register(
    "file_urls",
    with_sql(
        "pg",
        """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/w/' || host || '/a b+c%zz' WHEN 1 THEN '/plain/' || host WHEN 2 THEN NULL WHEN 3 THEN '/é/' || host ELSE NULL END AS path
      FROM (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host FROM pg)""",
    ),
)
def file_urls(spark, sf):
    n, host = F.col("page_id") % 5, F.regexp_extract("url", "//([^/]*)", 1)
    url = (
        F.when(n == 0, F.concat(F.lit("file:///w/"), host, F.lit("/a%20b+c%zz")))
        .when(n == 1, F.concat(F.lit("/plain/"), host))
        .when(n == 2, F.concat(F.lit("relative/"), host))
        .when(n == 3, F.concat(F.lit("file:///%C3%a9/"), host))
        .otherwise(F.concat(F.lit("file:///%ff/"), host))
    )
    return S.pg(spark, sf).select("page_id", P.file_url_path(url).alias("path"))


@register(
    "timestamps",
    with_sql(
        "ev",
        """SELECT event_id, CASE k % 5 WHEN 0 THEN at_us WHEN 1 THEN at_us - 7200000000 WHEN 2 THEN at_us // 1000000 * 1000000 ELSE NULL END AS parsed_us,
      at_us // 1000 * 1000 AS ms_us FROM ev""",
    ),
)
def timestamps(spark, sf):
    k, at = F.col("k"), F.timestamp_micros("at_us")
    text = (
        F.when(k % 5 == 0, iso(F.col("at_us")))
        .when(k % 5 == 1, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")))
        .when(k % 5 == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'z'"))
        .when(k % 5 == 3, F.date_format(at, "yyyy-MM-dd"))
        .otherwise("yesterday")
    )
    return S.ev(spark, sf).select(
        "event_id", K.parse_ts(text).alias("parsed_us"), K.parse_ms(F.floor(F.col("at_us") / 1000)).alias("ms_us")
    )


@register(
    "read_targets",
    with_sql(
        "pg",
        """SELECT page_id, unnest(CASE page_id % 5 WHEN 0 THEN ['src/' || page_id] WHEN 1 THEN ['res/' || page_id] WHEN 2 THEN ['a', 'b' || page_id] WHEN 3 THEN ['arg'] ELSE [] END) AS path FROM pg""",
    ),
)
def read_targets(spark, sf):
    n = F.col("page_id")
    pid = n.cast("string")
    empty = F.array().cast("array<string>")
    details = (
        F.when(n % 5 == 0, F.to_json(obj(meta=obj(source=obj(type="path", value=F.concat(F.lit("src/"), pid))), resolvedPath="x")))
        .when(n % 5 == 1, F.to_json(obj(meta=obj(source=obj(type="url", value="u")), resolvedPath=F.concat(F.lit("res/"), pid))))
        .when(n % 5 == 2, F.to_json(obj(displayReadTargetLinks=F.array(F.lit("a"), F.lit(None).cast("string"), F.concat(F.lit("b"), pid)))))
        .otherwise(F.to_json(obj(displayReadTargetLinks=empty)))
    )
    args = F.when(n % 5 != 4, F.to_json(obj(path="arg")))
    calls = S.pg(spark, sf).select("page_id", F.try_parse_json(details).alias("details"), F.try_parse_json(args).alias("args"))
    return calls.select("page_id", F.explode(omp.read_paths()).alias("path"))


@register(
    "search_sources",
    with_sql(
        "pg",
        """SELECT page_id, unnest(['T', '']) AS title, unnest([url, 'u2']) AS url FROM pg""",
    ),
)
def search_sources(spark, sf):
    hits = F.array(obj(title=F.lit("T"), url=F.col("url")), obj(title=F.lit("no url"), url=F.lit(None).cast("string")), obj(title=F.lit(None).cast("string"), url="u2"))
    found = V.web_sources(V.items(F.try_parse_json(F.to_json(obj(sources=hits))), "$.sources"))
    return S.pg(spark, sf).select("page_id", F.inline(found))


@register(
    "edit_blocks",
    with_sql(
        "pg",
        """SELECT page_id, CAST(b AS BIGINT) AS block, CASE b WHEN 1 THEN 'dir/' || page_id ELSE 'gone' END AS path, CASE b WHEN 1 THEN '+' || url || chr(10) || '-old' ELSE '' END AS body,
      CASE b WHEN 1 THEN 'to/' || page_id END AS moved_to, b = 2 AS removed FROM pg, (SELECT unnest([1, 2]) AS b)""",
    ),
)
def edit_blocks(spark, sf):
    pid = F.col("page_id").cast("string")
    script = F.concat(
        F.lit("preamble\n[dir/"), pid, F.lit("#0aF9]\n+"), F.col("url"), F.lit("\nMV  to/"), pid, F.lit("\n-old\n[gone#1234]\nREM\n")
    )
    return omp.edit_blocks(S.pg(spark, sf).select("page_id", script.alias("input")))


# --- diffs -----------------------------------------------------------------------------

_OPS = "[' ', '-', '+', '+', ' '][(i * 7 + doc_id) % 5 + 1]"
_DIFF = f"""
    l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    o AS (SELECT doc_id, i, line, i // 9 AS h, {_OPS} AS op FROM l),
    p AS (SELECT *, count(*) FILTER (WHERE op <> '+') OVER w AS olds, count(*) FILTER (WHERE op <> '-') OVER w AS news FROM o
      WINDOW w AS (PARTITION BY doc_id, h ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    facts AS (SELECT doc_id AS event_id, h + 1 AS hunk, op, 100 * h + 10 + olds AS old_line, 100 * h + 20 + news AS new_line, i, line FROM p)"""


def _diffs(spark, sf) -> DataFrame:
    """The lines of each document with a mark in front, nine to a hunk."""
    d = S.table(spark, sf, "documents").select(F.col("doc_id"), F.split("text", "\n").alias("ls"))
    marks = F.array(*[F.lit(m) for m in (" ", "-", "+", "+", " ")])
    mark = lambda i: F.element_at(marks, ((i * 7 + F.col("doc_id")) % 5 + 1).cast("int"))
    start = lambda i, n: (F.floor(i / 9) * 100 + n).cast("string")
    head = lambda i: F.concat(F.lit("@@ -"), start(i, 10), F.lit(",9 +"), start(i, 20), F.lit(",9 @@\n"))
    body = F.transform("ls", lambda s, i: F.concat(F.when(i % 9 == 0, head(i)).otherwise(""), mark(i), s))
    return d.select(F.col("doc_id").alias("event_id"), F.array_join(body, "\n").alias("diff"))


@register(
    "diff_lines",
    "WITH " + _DIFF.strip() + " SELECT event_id, hunk, op, old_line, new_line, line AS text FROM facts",
)
def diff_lines(spark, sf):
    return C.unified_lines(_diffs(spark, sf)).drop("pos")


@register(
    "first_changes",
    "WITH " + _DIFF.strip() + " SELECT event_id, min_by(new_line, i) AS first_line FROM facts WHERE op <> ' ' GROUP BY event_id",
)
def first_changes(spark, sf):
    return C.first_changed_line(C.unified_lines(_diffs(spark, sf)))


@register(
    "diff_churn",
    "WITH " + _DIFF.strip() + """ SELECT source AS rel, make_date(2024, 1, 1 + CAST(doc_id % 5 AS INT)) AS day, count(*) FILTER (WHERE op = '+') AS added, count(*) FILTER (WHERE op = '-') AS removed
    FROM facts JOIN documents ON doc_id = event_id GROUP BY ALL""",
)
def diff_churn(spark, sf):
    d = S.table(spark, sf, "documents").select(
        F.col("doc_id").alias("event_id"),
        F.col("source").alias("rel"),
        (F.lit(1_704_067_200_000_000) + F.col("doc_id") % 5 * S.DAY_US).alias("end_us"),
    )
    return C.churn(C.unified_lines(_diffs(spark, sf)), d)


@register(
    "numbered_diff_lines",
    """
    WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    o AS (SELECT doc_id, i, line, ['+', '-', '+', ' '][(i * 3 + doc_id) % 4 + 1] AS op FROM l),
    p AS (SELECT *, count(*) FILTER (WHERE op <> '+') OVER w AS olds, count(*) FILTER (WHERE op <> '-') OVER w AS news FROM o
      WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT doc_id FROM o GROUP BY doc_id HAVING bool_or(op <> ' '))
    SELECT doc_id AS event_id, op, 50 + olds AS old_line, 50 + news AS new_line, line AS text, CAST(1 AS BIGINT) AS hunk FROM p WHERE doc_id IN (SELECT doc_id FROM c)""",
)
def numbered_diff_lines(spark, sf):
    """Edits whose lines carry their numbers, in one hunk each."""
    d = S.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    marks = F.array(*[F.lit(m) for m in ("+", "-", "+", " ")])
    mark = lambda i: F.element_at(marks, ((i * 3 + F.col("doc_id")) % 4 + 1).cast("int"))
    step = F.aggregate(
        F.transform("ls", lambda s, i: F.struct(mark(i).alias("m"), s.alias("s"))),
        F.struct(F.lit(50).alias("o"), F.lit(50).alias("n"), F.array().cast("array<string>").alias("out")),
        lambda acc, m: F.struct(
            (acc["o"] + F.when(m.m == "+", 0).otherwise(1)).alias("o"),
            (acc["n"] + F.when(m.m == "-", 0).otherwise(1)).alias("n"),
            F.concat(
                acc["out"],
                F.array(
                    F.concat(
                        m.m,
                        F.when(m.m == "+", acc["n"]).otherwise(acc["o"]).cast("string"),
                        F.lit("|"),
                        m.s,
                    )
                ),
            ).alias("out"),
        ),
    )
    events = d.select(F.col("doc_id").alias("event_id"), F.array_join(step["out"], "\n").alias("diff"))
    return C.numbered_lines(events).drop("pos")


# --- roots -----------------------------------------------------------------------------


@register(
    "nested_roots",
    """
    WITH r AS (SELECT DISTINCT '/w/' || p_brand AS path, '/w/' || p_brand || '/' || p_type AS sub FROM part)
    SELECT DISTINCT path AS root_id, sub AS nested_id FROM r""",
)
def nested_roots(spark, sf):
    p = S.table(spark, sf, "part").select(F.concat(F.lit("/w/"), "p_brand").alias("a"), F.concat(F.lit("/w/"), F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("b"))
    roots = p.select(F.explode(F.array("a", "b")).alias("path")).distinct().withColumn("root_id", F.col("path"))
    return R.nested_roots(roots)


@register(
    "remap_roots",
    """SELECT event_id, user_id % 3 AS old_root, 10 + user_id % 3 * 2 AS root_id FROM events""",
)
def remap_roots(spark, sf):
    """Events under their roots' new ids after an unrelated root was added."""
    old = spark.createDataFrame([(0, "/a"), (1, "/b"), (2, "/c")], "root_id bigint, path string")
    new = spark.createDataFrame([(10, "/a"), (11, "/x"), (12, "/b"), (14, "/c")], "root_id bigint, path string")
    e = S.ev(spark, sf).select("event_id", "root_id", F.col("root_id").alias("old_root"))
    return R.apply_remap(e, R.remap_roots(old, new)).select("event_id", "old_root", "root_id")


@register(
    "seed_content",
    """SELECT source AS rel, doc_id AS seq, CAST(5 AS BIGINT) AS at_us, md5(text) AS digest FROM documents
    UNION ALL SELECT 'seed/' || doc_id, 0, 77, md5(text) FROM documents""",
)
def seed_content(spark, sf):
    d = S.table(spark, sf, "documents")
    known = d.select(F.col("source").alias("rel"), F.lit(5).cast("bigint").alias("at_us"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    seed = d.select(F.concat(F.lit("seed/"), F.col("doc_id").cast("string")).alias("rel"), F.lit(0).alias("root_id"), F.col("text").alias("content"))
    out = C.seed_content(known, seed, 77, 0)
    return out.select("rel", "seq", "at_us", F.md5("content").alias("digest"))


@register(
    "change_log_lines",
    with_sql(
        "chg",
        """SELECT event_id, root_id, rel AS path, change, at_us, CASE WHEN event_id % 4 = 0 THEN 'you' ELSE 's' || (event_id % 7) END AS who,
      CASE WHEN event_id % 4 <> 0 THEN 'c' || event_id END AS call_id, CASE WHEN event_id % 4 <> 0 THEN 'bash' END AS tool FROM chg""",
    ),
)
def change_log_lines(spark, sf):
    """Changes written as log lines and read back."""
    n = F.col("event_id")
    agent = n % 4 != 0
    changes = S.chg(spark, sf).select(
        "root_id",
        "rel",
        "at_us",
        "change",
        F.when(agent, F.concat(F.lit("s"), (n % 7).cast("string"))).otherwise("you").alias("who"),
        F.when(agent, F.concat(F.lit("c"), n.cast("string"))).alias("call_id"),
        F.lit(None).cast("string").alias("tool"),
        F.lit(None).cast("string").alias("input"),
        n.cast("string").alias("diff"),
    )
    back = changelog.parse_lines(changelog.log_lines(changes))
    return back.select(
        F.col("diff").cast("bigint").alias("event_id"), "root_id", "path", "change", "at_us", "who", "call_id", "tool"
    )


# --- streams ---------------------------------------------------------------------------


def _run(stream: DataFrame, columns: str) -> DataFrame:
    """Run a stream over what there is and read back what it gave."""
    base = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(columns).parquet(f"{base}/out")


def _event_stream(spark, sf) -> DataFrame:
    schema = S.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


_STREAM_QUIET = 43_200


@register(
    "stream_coalesce_closed",
    with_sql(
        "ev",
        f"""
    WITH e AS (SELECT 'f' || k AS path, at_us, event_id, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS s FROM ev WHERE event_type = 'error'),
    o AS (SELECT *, lag(at_us) OVER (PARTITION BY path ORDER BY at_us, event_id) AS prev FROM e),
    b AS (SELECT *, sum(CASE WHEN prev IS NULL OR at_us - prev >= {_STREAM_QUIET}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM o),
    c AS (SELECT path, min(event_id) AS event_id, max(at_us) AS at_us, max(s) AS top, min_by(s, event_id) AS begin, count(*) AS n_raw FROM b GROUP BY path, burst)
    SELECT path, event_id, at_us, CASE top WHEN 2 THEN 'removed' WHEN 1 THEN 'created' ELSE 'modified' END AS change, n_raw FROM c
    WHERE NOT (begin = 1 AND top = 2) AND (at_us + {_STREAM_QUIET}000000 - 1) // 1000 <= (SELECT max(at_us) FROM e) // 1000 - 10000""",
    ),
)
def stream_coalesce_closed(spark, sf):
    """The debounced change stream; what the watermark has not passed yet is still open."""
    from dataclasses import replace

    from tracelane.config import DEFAULTS

    k = F.get_json_object("props", "$.k")
    m = F.col("event_id") % 3
    changes = _event_stream(spark, sf).where("event_type = 'error'").select(
        F.concat(F.lit("f"), k).alias("path"),
        F.col("ts").cast("timestamp").alias("at"),
        "event_id",
        F.when(m == 0, "modified").when(m == 1, "created").otherwise("removed").alias("change"),
    )
    out = flows.debounce(changes, p=replace(DEFAULTS, debounce=_STREAM_QUIET))
    got = _run(out, "path string, event_id bigint, at timestamp, change string, n_raw bigint")
    return got.select("path", "event_id", F.unix_micros("at").alias("at_us"), "change", "n_raw")


@register(
    "stream_spans_closed",
    with_sql(
        "fx",
        """
    WITH o AS (SELECT who, start_us, end_us, max(end_us) OVER (PARTITION BY who ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us - reach > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY who ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run FROM o),
    s AS (SELECT who, min(start_us) AS start_us, max(end_us) AS end_us FROM n GROUP BY who, run)
    SELECT * FROM s WHERE (end_us + 3600000000) // 1000 <= (SELECT max(start_us) FROM fx) // 1000 - 10000""",
    ),
)
def stream_spans_closed(spark, sf):
    """Activity spans of the event stream, closed ones only."""
    from dataclasses import replace

    from tracelane.config import DEFAULTS

    start = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + S.minutes(F.col("value")))
    parts = _event_stream(spark, sf).select(F.col("user_id").alias("who"), start.alias("start"), end.alias("end"))
    got = _run(flows.span_stream(parts, replace(DEFAULTS, idle_gap=3600)), "who bigint, start timestamp, end timestamp")
    return got.select("who", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@register(
    "stream_pairs_closed",
    with_sql(
        "ev",
        """
    WITH r AS (SELECT who, k % 5 AS call_id, event_id, at_us, event_type = 'purchase' AS res FROM ev WHERE event_type IN ('click', 'purchase')),
    g AS (SELECT *, coalesce(sum(CAST(res AS INT)) OVER (PARTITION BY who, call_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gen FROM r)
    SELECT CAST(who AS VARCHAR) AS who, CAST(call_id AS VARCHAR) AS call_id, min_by(at_us, event_id) FILTER (WHERE NOT res) AS start_us, min_by(at_us, event_id) FILTER (WHERE res) AS end_us
    FROM g GROUP BY who, call_id, gen HAVING count(*) FILTER (WHERE NOT res) > 0 AND count(*) FILTER (WHERE res) > 0""",
    ),
)
def stream_pairs_closed(spark, sf):
    """Calls and results of the event stream, paired however far apart they are."""
    t, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    records = _event_stream(spark, sf).where(t.isin("click", "purchase")).select(
        F.col("user_id").cast("string").alias("who"),
        (k % 5).cast("string").alias("call_id"),
        F.when(t == "purchase", "result").otherwise("call").alias("role"),
        F.col("event_id").alias("line_no"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
    )
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    flows.pair_batches(records, base, f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/pairs").drop("batch")


@register(
    "stream_activity",
    with_sql(
        "ev",
        """SELECT who AS session, min(at_us) AS start_us, max(at_us) AS last_seen_us,
      CASE WHEN max(at_us) FILTER (WHERE event_type = 'error') >= max(at_us) FILTER (WHERE event_type <> 'error') THEN max(at_us) FILTER (WHERE event_type = 'error') END AS end_us
    FROM ev GROUP BY who""",
    ),
)
def stream_activity(spark, sf):
    """Start, last activity and recorded end per session, kept up to date by a stream."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    is_exit = F.col("event_type") == "error"
    records = _event_stream(spark, sf).select(
        F.col("user_id").alias("session"), at.alias("at_us"), is_exit.alias("is_exit"), F.when(is_exit, at).alias("recorded_us")
    )
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    updates = flows.keep_updates(flows.last_activity(records), f"{base}/out", f"{base}/state")
    updates.trigger(availableNow=True).start().awaitTermination()
    changed = Committed(spark, f"{base}/out").read("session bigint, start_us bigint, last_seen_us bigint, end_us bigint, batch bigint")
    return changed.groupBy("session").agg(F.max_by(F.struct("start_us", "last_seen_us", "end_us"), "batch").alias("s")).select("session", "s.*")


_REPLAY_ROOTS = [(0, "/r0"), (1, "/r1"), (2, "/r2"), (3, "/r0/src/m3")]


@register(
    "replayed_changes",
    with_sql(
        "chg",
        """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'you' ELSE 's' || (event_id % 7) END AS who,
      CASE WHEN root_id = 0 AND starts_with(rel, 'src/m3/') THEN 3 ELSE root_id END AS root_id,
      CASE WHEN root_id = 0 AND starts_with(rel, 'src/m3/') THEN substring(rel, 8) ELSE rel END AS rel,
      CASE WHEN event_id % 4 = 0 THEN 'watcher' ELSE 'window' END AS source, at_us AS start_us, change
      FROM chg WHERE event_id % 4 = 0 OR event_id % 7 <> 6""",
    ),
)
def replayed_changes(spark, sf):
    """Logged changes placed among today's roots; those of unknown transcripts are dropped."""
    n = F.col("event_id")
    agent = n % 4 != 0
    log = S.chg(spark, sf).select(
        "root_id",
        F.col("rel").alias("path"),
        "at_us",
        "change",
        F.when(agent, F.concat(F.lit("s"), (n % 7).cast("string"))).otherwise("you").alias("who"),
        F.when(agent, F.concat(F.lit("c"), n.cast("string"))).alias("call_id"),
        F.when(agent, "bash").alias("tool"),
        F.lit(None).cast("string").alias("input"),
        n.cast("string").alias("diff"),
    )
    people = S.ev(spark, sf).select(F.concat(F.lit("s"), (F.col("event_id") % 6).cast("string")).alias("who")).distinct()
    roots = spark.createDataFrame(_REPLAY_ROOTS, "root_id int, path string")
    events, _ = changelog.resolve_replay(log, people, roots)
    return events.select(
        F.col("detail.diff").cast("bigint").alias("event_id"), "who", "root_id", "rel", "source", "start_us", F.col("detail.fs_change").alias("change")
    )


_CONTENTS = """
    line AS (SELECT doc_id, string_split(text, chr(10))[1] || chr(10) AS content, (SELECT count(*) FROM documents) AS many FROM documents),
    seen AS (SELECT c.*, CASE WHEN change = 'removed' THEN '' ELSE content END AS content FROM chg c JOIN line ON doc_id = event_id % many WHERE change = 'removed' OR event_id % 5 <> 0),
    history AS (SELECT root_id, rel, end_us AS at_us, event_id, content FROM fx JOIN line ON doc_id = event_id * 7 % many WHERE source = 'tool' AND kind = 'write'
      UNION ALL SELECT root_id, rel, at_us, event_id, content FROM seen WHERE content IS NOT NULL)"""


@register(
    "live_changes",
    with_sql(
        "chg win",
        f"""
    WITH {_CONTENTS.strip()},
    kept AS (SELECT * FROM seen c WHERE NOT EXISTS (SELECT 1 FROM fx w WHERE w.source = 'tool' AND w.kind = 'write' AND w.root_id = c.root_id
      AND w.rel = c.rel AND w.end_us BETWEEN c.at_us - 36000000000 AND c.at_us + 3600000000)),
    prev AS (SELECT k.event_id, arg_max(h.content, (h.at_us, h.event_id)) AS old FROM kept k JOIN history h ON h.root_id = k.root_id AND h.rel = k.rel AND h.at_us < k.at_us GROUP BY k.event_id),
    texts AS (SELECT k.event_id, k.content AS new, CASE WHEN p.event_id IS NULL AND k.change = 'created' THEN '' ELSE p.old END AS old FROM kept k LEFT JOIN prev p USING (event_id)),
    diffs AS (SELECT event_id, CASE WHEN old <> new THEN '@@ ' || CASE old WHEN '' THEN '-0,0 ' ELSE '-1 ' END || CASE new WHEN '' THEN '+0,0 ' ELSE '+1 ' END || '@@' || chr(10)
      || CASE old WHEN '' THEN '' ELSE '-' || old END || CASE new WHEN '' THEN '' ELSE '+' || new END END AS diff FROM texts),
    hit AS (SELECT c.event_id, c.root_id, c.rel, c.change, w.who, w.call_id,
      row_number() OVER (PARTITION BY c.event_id ORDER BY w.start_us DESC NULLS LAST, w.ord) AS n
      FROM kept c LEFT JOIN win w ON w.root_id = c.root_id AND c.at_us >= w.start_us - 60000000 AND c.at_us <= coalesce(w.end_us, {S.NOW_US}) + 480000000)
    SELECT event_id, root_id, rel, change, coalesce(CAST(who AS VARCHAR), 'you') AS who, CAST(call_id AS VARCHAR) AS call_id,
      CASE WHEN call_id IS NOT NULL THEN 'window' ELSE 'watcher' END AS source, diff FROM hit JOIN diffs USING (event_id) WHERE n = 1""",
    ),
)
def live_changes(spark, sf):
    """The whole way of a batch of settled changes: placed, compared with what was known, filtered, attributed."""
    from tracelane.config import Params
    from tracelane.operators.roots import root_prefixes
    from tracelane.plans.live import classify_changes

    f, w, n = S.fx(spark, sf), S.win(spark, sf), F.col("event_id")
    line = S.table(spark, sf, "documents").select("doc_id", F.concat(F.split("text", "\n")[0], F.lit("\n")).alias("content"))
    many = line.count()
    changes = S.chg(spark, sf).join(line, F.col("doc_id") == n % many).select(
        "event_id",
        F.concat(F.lit("/r"), F.col("root_id").cast("string"), F.lit("/"), F.col("rel")).alias("path"),
        "at_us",
        "change",
        (n % 5 != 0).alias("exists"),
        "content",
    )
    roots = spark.createDataFrame([(0, "/r0"), (1, "/r1"), (2, "/r2")], "root_id int, path string")
    windows = w.withColumns({"who": F.col("who").cast("string"), "call_id": F.col("call_id").cast("string")})
    calls = windows.select("who", "call_id", F.lit("bash").alias("tool"), F.lit("").alias("input"))
    written = f.where("source = 'tool' AND kind = 'write'").join(line, F.col("doc_id") == n * 7 % many)
    history = written.select(F.concat(F.lit("p"), F.col("root_id").cast("string")).alias("scope_key"), "rel", F.col("end_us").alias("at_us"), n.cast("bigint").alias("seq"), "content")
    p = Params(echo_before=36_000, echo_after=3_600, slack_start=60, slack_end=480)
    events, _ = classify_changes(changes, root_prefixes(roots), f, windows, calls, history, S.NOW_US, p)
    return events.select("event_id", "root_id", "rel", F.col("detail.fs_change").alias("change"), "who", "call_id", "source", "detail.diff")


# --- what calls and items say about files ----------------------------------------------


def _calls_of_pages(spark, sf) -> DataFrame:
    """Finished calls of seven kinds, one per page; every fifth of a kind failed."""
    n, url, pid = F.col("page_id"), F.col("url"), F.col("page_id").cast("string")
    kinds = ("read", "write", "web_search", "eval", "edit", "read", "mcp__srv__do")
    kind = n % len(kinds)
    args = (
        F.when(kind == 0, F.to_json(obj(path=F.concat(F.lit("src/"), pid))))
        .when(kind == 1, F.to_json(obj(path=F.concat(F.lit("out/"), pid), content=url)))
        .when(kind == 2, F.to_json(obj(query=F.concat(F.lit("a\n"), pid))))
        .when(kind == 3, F.to_json(obj(code=url, i=F.concat(F.lit("cell "), pid), language="js")))
        .when(kind == 5, F.to_json(obj(path=url)))
    )
    one = obj(path=F.concat(F.lit("m/"), pid), oldText="o", newText=url, diff="+1|x")
    details = F.when(kind == 4, F.to_json(obj(perFileResults=F.array(one, one)))).otherwise("{}")
    return S.pg(spark, sf).select(
        F.lit("s1").alias("who"),
        F.lit("/s/p/s1.jsonl").alias("session"),
        F.lit("/w").alias("cwd"),
        pid.alias("call_id"),
        n.alias("line_no"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (kind + 1).cast("int")).alias("tool"),
        (n * US).alias("start_us"),
        (n * US + 5).alias("end_us"),
        (F.floor(n / 7) % 5 == 0).alias("failed"),
        F.try_parse_json(args).alias("args"),
        F.try_parse_json(details).alias("details"),
    )


@register(
    "log_touches",
    with_sql(
        "pg",
        """
    WITH c AS (SELECT page_id, url, page_id % 7 AS kind, page_id // 7 % 5 = 0 AS failed, CAST(page_id AS VARCHAR) AS p,
      ['read', 'write', 'web_search', 'eval', 'edit', 'read', 'mcp'][page_id % 7 + 1] AS tool FROM pg)
    SELECT p AS call_id, tool, CASE WHEN kind IN (1, 3, 4) THEN 'write' ELSE 'read' END AS kind,
      CASE kind WHEN 2 THEN 'websearch' WHEN 3 THEN 'session' WHEN 5 THEN 'webfetch' WHEN 6 THEN 'mcp' END AS scope,
      CASE kind WHEN 2 THEN 'a ' || p WHEN 3 THEN '/s/p/s1/eval/' || strftime(make_timestamp(page_id * 1000000), '%H:%M:%S') || ' cell ' || p || '.js' WHEN 5 THEN url WHEN 6 THEN 'srv/do' END AS rel,
      CASE kind WHEN 0 THEN 'src/' || p WHEN 1 THEN 'out/' || p WHEN 4 THEN 'm/' || p END AS raw,
      CASE kind WHEN 1 THEN 'written' WHEN 2 THEN 'search' WHEN 3 THEN 'written' WHEN 4 THEN 'diff' ELSE 'none' END AS type,
      CASE WHEN kind IN (1, 4) THEN url END AS new_text, i AS ord
    FROM c, (SELECT unnest([0, 1]) AS i) WHERE (i = 0 OR kind = 4) AND (NOT failed OR kind = 3)""",
    ),
)
def log_touches(spark, sf):
    """File touches of finished calls by tool; failed ones keep only their cells."""
    calls = _records(_calls_of_pages(spark, sf)).withColumn("details", F.when(F.col("tool").startswith("mcp"), F.try_parse_json(F.lit('{"serverName":"srv","mcpToolName":"do"}'))).otherwise(F.col("details")))
    out = omp.touches(calls)
    return out.select("call_id", "tool", "kind", "scope", "rel", "raw", "detail.type", "new_text", F.coalesce("ord", F.lit(0)).cast("int").alias("ord"))


def _items_of_pages(spark, sf) -> DataFrame:
    """Completed items of four kinds, one per page."""
    n, url, pid = F.col("page_id"), F.col("url"), F.col("page_id").cast("string")
    host = F.regexp_extract("url", "//([^/]*)", 1)
    read = obj(type="read", path=F.concat(F.lit("f"), pid))
    status = F.when(n % 3 == 0, "failed").otherwise("completed")
    run = obj(type="CommandExecution", id=pid, status=status, command=F.array(F.lit("bash"), F.lit("-lc"), F.concat(F.lit("ssh "), host)), cwd="file:///w%20d", parsed_cmd=F.array(read))
    mcp = obj(type="McpToolCall", id=pid, status=status, server="srv", tool="t", arguments=obj(n=n))
    page = obj(type="WebSearch", id=pid, query="ignored", action=obj(type="open_page", url=url))
    find = obj(type="WebSearch", id=pid, query="", action=obj(type="search", queries=F.array(F.concat(F.lit("q\n"), pid), F.lit("second"))))
    kind = n % 4
    item = F.when(kind == 0, F.to_json(run)).when(kind == 1, F.to_json(mcp)).when(kind == 2, F.to_json(page)).otherwise(F.to_json(find))
    text = F.concat(F.lit('{"payload":{"type":"item_completed","item":'), item, F.lit("}}"))
    return _records(
        S.pg(spark, sf).select(
            host.alias("who"),
            host.alias("session"),
            F.lit(True).alias("is_main"),
            n.alias("line_no"),
            F.try_parse_json(text).alias("rec"),
            F.lit(None).cast("string").alias("mode"),
            (n * US).alias("at_us"),
            F.lit("event_msg").alias("ty"),
            F.lit("item_completed").alias("pty"),
        )
    )


@register(
    "rollout_touches",
    with_sql(
        "pg",
        """
    WITH c AS (SELECT page_id, url, regexp_extract(url, '//([^/]*)', 1) AS host, page_id % 4 AS kind, page_id % 3 = 0 AS failed, CAST(page_id AS VARCHAR) AS p FROM pg)
    SELECT host AS who, p AS call_id, 'remote' AS scope, 'ssh://' || host AS rel, NULL AS raw, 'inferred' AS source, NULL AS tool FROM c WHERE kind = 0
    UNION ALL SELECT host, p, NULL, NULL, 'f' || p, 'tool', 'read' FROM c WHERE kind = 0 AND NOT failed
    UNION ALL SELECT host, p, 'mcp', 'srv/t', NULL, 'tool', 'mcp' FROM c WHERE kind = 1 AND NOT failed
    UNION ALL SELECT host, p, 'webfetch', url, NULL, 'tool', 'read' FROM c WHERE kind = 2
    UNION ALL SELECT host, p, 'websearch', 'q ' || p, NULL, 'tool', 'web_search' FROM c WHERE kind = 3""",
    ),
)
def rollout_touches(spark, sf):
    rows = _items_of_pages(spark, sf)
    cwds = rows.select("session", F.lit("/w").alias("cwd")).distinct()
    host = F.regexp_extract("url", "//([^/]*)", 1)
    targets = S.pg(spark, sf).where("page_id % 4 = 0").select(host.alias("who"), F.col("page_id").cast("string").alias("call_id"), F.concat(F.lit("ssh://"), host).alias("target"), F.lit("read").alias("access"), F.lit(0).alias("ord"))
    return codex.touches(rows, cwds, "/", targets).select("who", "call_id", "scope", "rel", "raw", "source", "tool")


@register(
    "rollout_calls",
    with_sql(
        "pg",
        """
    WITH c AS (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host, page_id % 4 AS kind, CAST(page_id AS VARCHAR) AS p FROM pg)
    SELECT host AS who, p AS call_id, CASE kind WHEN 0 THEN 'bash' ELSE 'mcp:srv/t' END AS tool,
      CASE kind WHEN 0 THEN 'ssh ' || host ELSE '{"n":' || p || '}' END AS input FROM c WHERE kind < 2""",
    ),
)
def rollout_calls(spark, sf):
    return codex.call_table(_items_of_pages(spark, sf))


@register(
    "rollout_inputs",
    with_sql(
        "pg",
        """SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN 'curl ' || url WHEN 3 THEN 'curl ' || url WHEN 4 THEN 'not json' ELSE url END AS input FROM pg""",
    ),
)
def rollout_inputs(spark, sf):
    """What a shell function was given, in each of its record shapes."""
    n, url = F.col("page_id") % 6, F.col("url")
    argv = F.array(F.lit("curl"), url)
    pty = F.when(n == 0, "custom_tool_call").when(n == 3, "local_shell_call").otherwise("function_call")
    payload = (
        F.when(n == 0, F.to_json(obj(payload=obj(input=url))))
        .when(n == 1, F.to_json(obj(payload=obj(arguments=F.to_json(obj(cmd=url))))))
        .when(n == 2, F.to_json(obj(payload=obj(arguments=F.to_json(obj(command=argv))))))
        .when(n == 3, F.to_json(obj(payload=obj(action=obj(command=argv)))))
        .when(n == 4, F.to_json(obj(payload=obj(arguments="not json"))))
        .otherwise(F.to_json(obj(payload=obj(arguments=F.to_json(obj(command=url))))))
    )
    rows = S.pg(spark, sf).select("page_id", pty.alias("pty"), F.try_parse_json(payload).alias("rec"))
    return rows.select("page_id", codex.call_input().alias("input"))


@register(
    "rollout_windows",
    with_sql(
        "ev",
        """
    WITH r AS (SELECT CAST(who AS VARCHAR) AS who, 'c' || (k % 20) AS call_id, event_id, at_us, event_type AS t FROM ev),
    f AS (SELECT who, call_id, min(event_id) AS ord, min_by(at_us, event_id) AS start_us FROM r WHERE t = 'click' GROUP BY ALL),
    w AS (SELECT f.who, f.call_id, f.ord, f.start_us, min_by(r.at_us, r.event_id) AS end_us, min(r.event_id) AS line
      FROM f LEFT JOIN r ON r.who = f.who AND r.call_id = f.call_id AND r.t = 'view' AND r.event_id > f.ord GROUP BY ALL),
    n AS (SELECT w.*, t.tl, t.ta FROM w LEFT JOIN (SELECT w.who, w.call_id, min(r.event_id) AS tl, min_by(r.at_us, r.event_id) AS ta FROM w JOIN r ON r.who = w.who AND r.t = 'purchase' AND r.event_id > w.ord GROUP BY ALL) t
      ON t.who = w.who AND t.call_id = w.call_id)
    SELECT who, call_id, start_us, CASE WHEN tl IS NOT NULL AND (line IS NULL OR tl < line) THEN ta ELSE end_us END AS end_us FROM n""",
    ),
)
def rollout_windows(spark, sf):
    """Shell calls open windows, outputs close them, and so does the end of a turn."""
    from tracelane.operators.pairing import close_at_turn_end, open_close

    t, cid = F.col("event_type"), F.concat(F.lit("c"), (F.col("k") % 20).cast("string"))
    payload = (
        F.when(t == "click", F.to_json(obj(payload=obj(call_id=cid, name="shell", arguments="{}"))))
        .when(t == "view", F.to_json(obj(payload=obj(call_id=cid))))
        .otherwise("{}")
    )
    rows = _records(
        S.ev(spark, sf).select(
            F.col("who").cast("string").alias("who"),
            F.col("event_id").alias("line_no"),
            "at_us",
            F.when(t.isin("click", "view"), "response_item").otherwise("event_msg").alias("ty"),
            F.when(t == "click", "function_call").when(t == "view", "function_call_output").when(t == "purchase", "task_complete").otherwise("other").alias("pty"),
            F.lit(None).cast("string").alias("mode"),
            F.try_parse_json(payload).alias("rec"),
        )
    )
    windows = open_close(codex.window_records(rows).select("who", "call_id", "line_no", "at_us", "op"))
    ends = codex.turn_ends(rows).withColumn("line_no", F.col("line_no") * 2)
    return close_at_turn_end(windows, ends, open_line="ord").select("who", "call_id", "start_us", "end_us")


def _entry_calls_of_pages(spark, sf) -> DataFrame:
    """Finished calls of the second format, one per page: every file and web tool, a ninth of each failed."""
    n, url, pid = F.col("page_id"), F.col("url"), F.col("page_id").cast("string")
    kinds = ("Read", "Write", "Write", "Edit", "MultiEdit", "NotebookEdit", "WebFetch", "WebSearch", "mcp__srv__do", "Edit")
    kind = n % len(kinds)
    path = F.concat(F.lit("f/"), pid)
    swap = lambda old, new: obj(old_string=old, new_string=new)
    args = (
        F.when(kind == 0, F.to_json(obj(file_path=path)))
        .when(kind.isin(1, 2), F.to_json(obj(file_path=path, content=url)))
        .when(kind == 3, F.to_json(obj(file_path=path, old_string="<", new_string="[")))
        .when(kind == 4, F.to_json(obj(file_path=path, edits=F.array(swap("<", "["), swap(">", "]")))))
        .when(kind == 5, F.to_json(obj(notebook_path=F.concat(path, F.lit(".ipynb")), new_source=url)))
        .when(kind == 6, F.to_json(obj(url=url)))
        .when(kind == 7, F.to_json(obj(query=F.concat(F.lit("a\n"), pid))))
        .when(kind == 9, F.to_json(obj(file_path=path, old_string="/", new_string="|", replace_all=True)))
        .otherwise("{}")
    )
    before = F.concat(F.lit("<"), url, F.lit(">"))
    details = F.when(kind.isin(2, 3, 4, 9), F.to_json(obj(filePath=F.concat(F.lit("at/"), pid), originalFile=before))).otherwise("{}")
    return S.pg(spark, sf).select(
        F.lit("s1").alias("who"), F.lit("/s/p/s1.jsonl").alias("session"), F.lit("/w").alias("cwd"), pid.alias("call_id"), n.alias("line_no"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (kind + 1).cast("int")).alias("tool"),
        (n * US).alias("start_us"), (n * US + 5).alias("end_us"), (F.floor(n / 10) % 9 == 0).alias("failed"),
        F.try_parse_json(args).alias("args"), F.try_parse_json(details).alias("details"),
    )


@register(
    "entry_tool_touches",
    with_sql(
        "pg",
        """
    WITH c AS (SELECT page_id, url, page_id % 10 AS kind, CAST(page_id AS VARCHAR) AS p FROM pg WHERE page_id // 10 % 9 <> 0)
    SELECT p AS call_id, CASE WHEN kind IN (0, 6, 7, 8) THEN 'read' ELSE 'write' END AS kind,
      CASE kind WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'write' WHEN 6 THEN 'read' WHEN 7 THEN 'web_search' WHEN 8 THEN 'mcp' ELSE 'edit' END AS tool,
      CASE kind WHEN 6 THEN 'webfetch' WHEN 7 THEN 'websearch' WHEN 8 THEN 'mcp' END AS scope, CASE kind WHEN 6 THEN url WHEN 7 THEN 'a ' || p WHEN 8 THEN 'srv/do' END AS rel,
      CASE WHEN kind IN (0, 1) THEN 'f/' || p WHEN kind IN (2, 3, 4, 9) THEN 'at/' || p WHEN kind = 5 THEN 'f/' || p || '.ipynb' END AS raw,
      CASE WHEN kind = 1 THEN 'written' WHEN kind IN (2, 3, 4, 9) THEN 'diff' WHEN kind = 7 THEN 'search' ELSE 'none' END AS type,
      CASE WHEN kind IN (2, 3, 4, 9) THEN '<' || url || '>' END AS old_text,
      CASE kind WHEN 1 THEN url WHEN 2 THEN url WHEN 3 THEN '[' || url || '>' WHEN 4 THEN '[' || url || ']' WHEN 9 THEN '<' || replace(url, '/', '|') || '>' END AS new_text FROM c""",
    ),
)
def entry_tool_touches(spark, sf):
    """File touches of every tool of the second format, with the texts before and after."""
    out = claude.touches(_records(_entry_calls_of_pages(spark, sf)))
    return out.select("call_id", "kind", "tool", "scope", "rel", "raw", "detail.type", "old_text", "new_text")


def _legacy_events_of_pages(spark, sf) -> DataFrame:
    """Events of the third format's older records: commands, patches, searches and server calls, one per page."""
    n, url, pid = F.col("page_id"), F.col("url"), F.col("page_id").cast("string")
    kind = n % 6
    patch = F.concat(F.lit('{"'), F.lit("f"), pid, F.lit('":'), F.to_json(obj(type="add", content=url)), F.lit(',"g'), pid, F.lit('":{"type":"update","unified_diff":"@@","move_path":"h"}}'))
    payload = (
        F.when(kind == 0, F.to_json(obj(call_id=pid, command=F.array(F.lit("bash"), F.lit("-lc"), F.concat(F.lit("ls "), url)))))
        .when(kind == 1, F.concat(F.lit('{"call_id":"'), pid, F.lit('","success":'), F.when(n % 4 == 1, "true").otherwise("false"), F.lit(',"changes":'), patch, F.lit("}")))
        .when(kind == 2, F.to_json(obj(call_id=pid, query=F.concat(F.lit("q\n"), pid))))
        .when(kind == 3, F.to_json(obj(call_id=pid, query="x", action=obj(type="open_page", url=url))))
        .when(kind == 4, F.concat(F.lit('{"call_id":"'), pid, F.lit('","invocation":{"server":"srv","tool":"t"},"result":{"Ok":{"isError":false}}}')))
        .otherwise(F.concat(F.lit('{"call_id":"'), pid, F.lit('","invocation":{"server":"srv","tool":"t"},"result":{"Err":"no"}}')))
    )
    names = F.array(*[F.lit(x) for x in ("exec_command_end", "patch_apply_end", "web_search_end", "web_search_end", "mcp_tool_call_end", "mcp_tool_call_end")])
    return _records(
        S.pg(spark, sf).select(
            F.lit("s1").alias("who"), F.lit("s1").alias("session"), F.lit(True).alias("is_main"), n.alias("line_no"),
            F.try_parse_json(F.concat(F.lit('{"payload":'), payload, F.lit("}"))).alias("rec"),
            F.lit("legacy").alias("mode"), (n * US).alias("at_us"), F.lit("event_msg").alias("ty"), F.element_at(names, (kind + 1).cast("int")).alias("pty"),
        )
    )


@register(
    "rollout_legacy_touches",
    with_sql(
        "pg",
        """
    WITH c AS (SELECT page_id, url, page_id % 6 AS kind, CAST(page_id AS VARCHAR) AS p FROM pg)
    SELECT p AS call_id, 'remote' AS scope, 'on ' || url AS rel, NULL AS raw, 'inferred' AS source, NULL AS tool, 'none' AS type, NULL AS new_text FROM c WHERE kind = 0
    UNION ALL SELECT p, NULL, NULL, 'f' || p, 'tool', 'write', 'written', url FROM c WHERE kind = 1 AND page_id % 4 = 1
    UNION ALL SELECT p, NULL, NULL, 'g' || p, 'tool', 'edit', 'diff', NULL FROM c WHERE kind = 1 AND page_id % 4 = 1
    UNION ALL SELECT p, NULL, NULL, 'g' || p, 'tool', 'edit', 'none', NULL FROM c WHERE kind = 1 AND page_id % 4 = 1
    UNION ALL SELECT p, 'websearch', 'q ' || p, NULL, 'tool', 'web_search', 'search', NULL FROM c WHERE kind = 2
    UNION ALL SELECT p, 'webfetch', url, NULL, 'tool', 'read', 'none', NULL FROM c WHERE kind = 3
    UNION ALL SELECT p, 'mcp', 'srv/t', NULL, 'tool', 'mcp', 'none', NULL FROM c WHERE kind = 4""",
    ),
)
def rollout_legacy_touches(spark, sf):
    """File touches of the older event records: what failed gives none."""
    rows = _legacy_events_of_pages(spark, sf)
    cwds = rows.select("session", F.lit("/w").alias("cwd")).distinct()
    targets = S.pg(spark, sf).where("page_id % 6 = 0").select(F.lit("s1").alias("who"), F.col("page_id").cast("string").alias("call_id"), F.concat(F.lit("on "), F.col("url")).alias("target"), F.lit("read").alias("access"), F.lit(0).alias("ord"))
    return codex.touches(rows, cwds, "/", targets).select("call_id", "scope", "rel", "raw", "source", "tool", "detail.type", "new_text")
