"""Queries on intervals, the time grid and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelane.config import US, ZOOM_WIDTHS
from tracelane.functions.num import floor_div
from tracelane.operators import attribution as A
from tracelane.operators import intervals as I
from tracelane.operators import timeline as T
from tracelane.plans import shims as S
from tracelane.plans.shims import with_sql
from tracelane.session import staged

HOUR = 3600 * US
REGISTERED: dict = {}


def register(name, sql=None):
    def add(fn):
        REGISTERED[name] = (fn, sql)
        return fn

    return add


# --- intervals -------------------------------------------------------------------------


def _merge_sql(source: str, gap: int) -> str:
    return f"""
    WITH o AS (SELECT who, start_us, end_us,
        max(end_us) OVER (PARTITION BY who ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
        FROM {source}),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us - reach > {gap} THEN 1 ELSE 0 END)
        OVER (PARTITION BY who ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run FROM o)
    SELECT who, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_intervals FROM n GROUP BY who, run"""


@register("span_merge", with_sql("fx", _merge_sql("fx", HOUR)))
def span_merge(spark, sf):
    return I.merge_intervals(S.fx(spark, sf), ("who",), gap=HOUR)


@register("span_merge_items", with_sql("li", _merge_sql("li", 86400 * US)))
def span_merge_items(spark, sf):
    return I.merge_intervals(S.li(spark, sf), ("who",), gap=86400 * US)


_UNION_SQL = """
    WITH a AS (SELECT at_us // 1000000 AS s, (at_us + CAST(floor(value) AS BIGINT) * 1000000) // 1000000 AS e FROM ev),
    o AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
        OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM o)
    SELECT min(s) AS start_s, max(e) AS end_s FROM n GROUP BY run"""


@register("activity_union", with_sql("ev", _UNION_SQL))
def activity_union(spark, sf):
    """Reads as events, writes as spans, clicks as prompts; durations count as seconds here."""
    e = S.ev(spark, sf)
    end = F.col("at_us") + F.floor("value").cast("bigint") * US
    timed = e.select("event_type", F.col("at_us").alias("start_us"), end.alias("end_us"))
    prompts = e.where("event_type = 'click'").select("at_us")
    return I.activity_union(timed, timed.where("event_type = 'purchase'"), prompts)


@register(
    "interval_union",
    with_sql(
        "ev fx",
        """
    WITH g AS (SELECT who, at_us - (k % 7) * 3600000000 AS at_us, event_id, event_type = 'purchase' AS a FROM ev),
    m AS (SELECT *, max(at_us) OVER (PARTITION BY who ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g),
    u AS (SELECT who, prev AS start_us, at_us AS end_us FROM m WHERE a AND prev < at_us
          UNION ALL SELECT who, start_us, end_us FROM fx WHERE kind = 'write'
          UNION ALL SELECT who, end_us, start_us FROM fx WHERE kind = 'read')
    SELECT who, least(start_us, end_us) AS start_us, greatest(start_us, end_us) AS end_us FROM u""",
    ),
)
def interval_union(spark, sf):
    e, f = S.ev(spark, sf), S.fx(spark, sf)
    gen = I.generation_intervals(_drifting(e))
    back = f.where("kind = 'read'").select("who", F.col("end_us").alias("start_us"), F.col("start_us").alias("end_us"))
    return I.union_intervals(gen, f.where("kind = 'write'"), back)


def _drifting(e):
    """Entries whose clock runs back at times, so that the running maximum matters."""
    return e.select(
        "who",
        (F.col("at_us") - (F.col("k") % 7) * HOUR).alias("at_us"),
        F.col("event_id").alias("line_no"),
        (F.col("event_type") == "purchase").alias("is_assistant"),
    )


@register(
    "gen_intervals",
    with_sql(
        "ev",
        """
    WITH g AS (SELECT who, at_us - (k % 7) * 3600000000 AS at_us, event_id, event_type = 'purchase' AS a FROM ev),
    m AS (SELECT *, max(at_us) OVER (PARTITION BY who ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g)
    SELECT who, prev AS start_us, at_us AS end_us FROM m WHERE a AND prev < at_us""",
    ),
)
def gen_intervals(spark, sf):
    return I.generation_intervals(_drifting(S.ev(spark, sf)))


@register(
    "turn_intervals",
    with_sql(
        "ev",
        """
    WITH m AS (SELECT who, at_us, event_id,
        CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' END AS marker FROM ev),
    o AS (SELECT *, lag(at_us) OVER w AS prev,
        last_value(marker IGNORE NULLS) OVER (PARTITION BY who ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state
        FROM m WINDOW w AS (PARTITION BY who ORDER BY event_id))
    SELECT who, prev AS start_us, at_us AS end_us FROM o
    WHERE state = 'start' AND (marker IS NULL OR marker <> 'start') AND prev < at_us""",
    ),
)
def turn_intervals(spark, sf):
    t = F.col("event_type")
    marker = F.when(t == "signup", "start").when(t == "purchase", "end")
    return I.turn_intervals(
        S.ev(spark, sf).select("who", "at_us", F.col("event_id").alias("line_no"), marker.alias("marker"))
    )


# --- time grid -------------------------------------------------------------------------


@register(
    "time_grid",
    with_sql("ev", "SELECT event_id, at_us // 1000000 // 900 AS grid FROM ev"),
)
def time_grid(spark, sf):
    return T.time_grid(S.ev(spark, sf), 900).select("event_id", "grid")


def _points(spark, sf):
    """Starts only, as activity of zero length."""
    s = floor_div("start_us", US)
    return S.fx(spark, sf).select(s.alias("start_s"), s.alias("end_s"))


_GAPS_SQL = """
    WITH a AS (SELECT start_us // 1000000 // 10 AS a FROM fx),
    o AS (SELECT a, lag(a) OVER (ORDER BY a) AS prev FROM (SELECT DISTINCT a FROM a)),
    gaps AS (SELECT prev + 1 AS first, a AS "end", a - prev - 4 AS cut FROM o WHERE a - prev - 1 >= 6),
    g AS (SELECT first, "end", CAST(coalesce(sum(cut) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
        AS removed_before FROM gaps)"""


@register("idle_gaps", with_sql("fx", _GAPS_SQL + " SELECT * FROM g"))
def idle_gaps(spark, sf):
    return T.idle_gaps(_points(spark, sf), 10)


@register(
    "idle_gaps_by_person",
    with_sql(
        "fx",
        """
    WITH a AS (SELECT who, start_us // 1000000 // 600 AS a, max(end_us // 1000000 // 600) AS b FROM fx GROUP BY ALL),
    o AS (SELECT *, max(b) OVER (PARTITION BY who ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a),
    gaps AS (SELECT who, prev + 1 AS first, a AS "end", a - prev - 4 AS cut FROM o WHERE a - prev - 1 >= 6)
    SELECT who, first, "end", CAST(coalesce(sum(cut) OVER (PARTITION BY who ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
        AS removed_before FROM gaps""",
    ),
)
def idle_gaps_by_person(spark, sf):
    seconds = S.fx(spark, sf).select(
        "who", floor_div("start_us", US).alias("start_s"), floor_div("end_us", US).alias("end_s")
    )
    return T.idle_gaps(seconds, 600, ("who",))


_DISPLAY_SQL = (
    _GAPS_SQL
    + """,
    c AS (SELECT DISTINCT start_us // 1000000 // 10 AS g FROM fx UNION SELECT first FROM g UNION SELECT first + 1 FROM g
        UNION SELECT first + 2 FROM g UNION SELECT "end" - 1 FROM g),
    d AS (SELECT c.g, CASE WHEN g.first IS NULL THEN c.g
        WHEN c.g >= g."end" THEN c.g - g.removed_before - (g."end" - g.first - 3)
        WHEN c.g = g.first THEN g.first - g.removed_before
        WHEN c.g = g."end" - 1 THEN g.first - g.removed_before + 2
        ELSE g.first - g.removed_before + 1 END AS d
        FROM c ASOF LEFT JOIN g ON c.g >= g.first)"""
)


def _cols(spark, sf, gaps):
    active = _points(spark, sf).select(floor_div("start_s", 10).alias("g"))
    edges = gaps.select(F.explode(F.array(F.col("first"), F.col("first") + 1, F.col("first") + 2, F.col("end") - 1)).alias("g"))
    return active.unionByName(edges)


@register("display_cols", with_sql("fx", _DISPLAY_SQL + " SELECT g, d FROM d"))
def display_cols(spark, sf):
    gaps = T.idle_gaps(_points(spark, sf), 10)
    return T.display_cols(_cols(spark, sf, gaps), gaps)


@register(
    "column_ranges",
    with_sql(
        "fx",
        _DISPLAY_SQL
        + """,
    s AS (SELECT *, first - removed_before AS x FROM g),
    w AS (SELECT DISTINCT d FROM d),
    j AS (SELECT w.d, w.d - s.x AS pos, s.first, s."end", s.removed_before FROM w ASOF LEFT JOIN s ON w.d >= s.x)
    SELECT d,
      CASE WHEN pos IN (0, 2) THEN 'pad' WHEN pos = 1 THEN 'break' ELSE 'time' END AS type,
      10 * CASE WHEN pos IN (0, 1) THEN first WHEN pos = 2 THEN "end" - 1 WHEN pos > 2 THEN d + removed_before + ("end" - first - 3) ELSE d END AS start_s,
      10 * CASE WHEN pos = 0 THEN first + 1 WHEN pos IN (1, 2) THEN "end" WHEN pos > 2 THEN d + removed_before + ("end" - first - 3) + 1 ELSE d + 1 END AS end_s
    FROM j""",
    ),
)
def column_ranges(spark, sf):
    gaps = T.idle_gaps(_points(spark, sf), 10)
    return T.column_ranges(T.display_cols(_cols(spark, sf, gaps), gaps), gaps, 10)


FIT_COLS = 5000


@register(
    "fit_zoom",
    with_sql(
        "fx",
        f"""
    WITH ws AS (SELECT unnest([{', '.join(map(str, ZOOM_WIDTHS))}]) AS w),
    a AS (SELECT DISTINCT start_us // 1000000 AS s FROM fx),
    c AS (SELECT DISTINCT w, s // w AS g FROM a, ws),
    o AS (SELECT w, g, lag(g) OVER (PARTITION BY w ORDER BY g) AS prev FROM c),
    r AS (SELECT w, max(g) - min(g) - coalesce(sum(CASE WHEN g - prev - 1 >= 6 THEN g - prev - 4 END), 0) AS shown FROM o GROUP BY w)
    SELECT CAST(coalesce(min(CASE WHEN shown <= {FIT_COLS - 4} THEN w END), 86400) AS BIGINT) AS width FROM r""",
    ),
)
def fit_zoom(spark, sf):
    return T.fit_width(_points(spark, sf), None, None, FIT_COLS)


@register(
    "overlap_buckets",
    with_sql(
        "fx",
        """SELECT b AS bucket, kind, count(*) AS n, count(DISTINCT who) AS people FROM
        (SELECT kind, who, unnest(range(start_us // 3600000000, end_us // 3600000000 + 1)) AS b FROM fx) GROUP BY b, kind""",
    ),
)
def overlap_buckets(spark, sf):
    return T.overlap_counts(S.fx(spark, sf), ("kind",), "who", 3600)


@register(
    "overlap_week",
    with_sql(
        "li",
        """SELECT b AS bucket, count(*) AS n FROM (SELECT unnest(range(start_us // 3600000000, end_us // 3600000000 + 1)) AS b FROM li) WHERE b BETWEEN 227904 AND 228071 GROUP BY b""",
    ),
)
def overlap_week(spark, sf):
    """Intervals of up to fifty days on an hourly grid, of which one week is shown."""
    return T.overlap_totals(S.li(spark, sf), 3600, 227_904, 228_071)


_PREFIXES = "[regexp_extract(rel, '^[^/]+'), regexp_extract(rel, '^[^/]+/[^/]+'), rel]"


@register(
    "gantt_nodes",
    with_sql(
        "fx",
        f"""
    WITH b AS (SELECT unnest({_PREFIXES}) AS node, start_us, end_us, event_id, who, kind FROM fx),
    t AS (SELECT node, who, kind, end_us, event_id, unnest(range(start_us // 3600000000, end_us // 3600000000 + 1)) AS bucket FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY node, bucket ORDER BY kind = 'write' DESC, end_us DESC, event_id) AS n FROM t)
    SELECT node, bucket, who, CAST(kind = 'write' AS INT) AS is_write FROM r WHERE n = 1""",
    ),
)
def gantt_nodes(spark, sf):
    return T.gantt_nodes(S.fx(spark, sf), 3600)


_LANES_SQL = """
    WITH s AS (SELECT DISTINCT who, unnest(range(start_us // 3600000000, end_us // 3600000000 + 1)) AS bucket FROM fx WHERE source = 'tool'),
    y AS (SELECT unnest(range(start_us // 3600000000, end_us // 3600000000 + 1)) AS bucket FROM fx WHERE source = 'watcher'),
    m AS (SELECT who, bucket, 2 AS mark FROM s
      UNION ALL SELECT p.main, bucket, 1 FROM s JOIN parts p USING (who) WHERE p.main <> who
      UNION ALL SELECT -1, bucket, 2 FROM y
      UNION ALL SELECT -1, start_us // 3600000000, 3 FROM fx WHERE source = 'window')
    SELECT who, bucket, CAST(max(mark) AS BIGINT) AS mark FROM m GROUP BY who, bucket"""


@register("gantt_lanes", with_sql("fx parts", _LANES_SQL))
def gantt_lanes(spark, sf):
    prompts = S.fx(spark, sf, "signup").select(F.col("start_us").alias("at_us"))
    spans = S.fx(spark, sf, "click", "view", "purchase")
    return T.gantt_lanes(spans, prompts, S.fx(spark, sf, "error"), S.participants(spark, sf), 3600, you=-1)


# --- attribution -----------------------------------------------------------------------


@register(
    "fs_normalise",
    with_sql(
        "ev",
        """
    WITH r AS (SELECT event_id, at_us, 'f' || k AS a, 'f' || (k + 1) AS b,
        ['create', 'modify', 'remove', 'rename', 'rename_from', 'rename_to'][k % 6 + 1] AS op,
        k % 11 = 0 AS is_dir, k % 13 = 0 AS ignored FROM ev),
    x AS (SELECT event_id, at_us, a AS path, CASE op WHEN 'create' THEN 'created' WHEN 'modify' THEN 'modified'
            WHEN 'rename_to' THEN 'created' ELSE 'removed' END AS change, is_dir, ignored FROM r
        UNION ALL SELECT event_id, at_us, b, 'created', is_dir, false FROM r WHERE op = 'rename')
    SELECT event_id, at_us, path, change FROM x WHERE NOT ignored AND (change = 'removed' OR NOT is_dir)""",
    ),
)
def fs_normalise(spark, sf):
    from tracelane.sources.changes import normalise_fs

    k = F.col("k")
    ops = F.array(*[F.lit(o) for o in ("create", "modify", "remove", "rename", "rename_from", "rename_to")])
    raw = S.ev(spark, sf).select(
        "event_id",
        "at_us",
        F.concat(F.lit("f"), k.cast("string")).alias("path"),
        F.concat(F.lit("f"), (k + 1).cast("string")).alias("to_path"),
        F.element_at(ops, k % 6 + 1).alias("op"),
        (k % 11 == 0).alias("is_dir"),
        (k % 13 == 0).alias("ignored"),
        (k % 11 == 0).alias("to_is_dir"),
        F.lit(False).alias("to_ignored"),
    )
    return normalise_fs(raw)


_QUIET = 12 * HOUR
_COALESCE_SQL = f"""
    WITH o AS (SELECT *, lag(at_us) OVER w AS prev FROM chg WINDOW w AS (PARTITION BY root_id, rel ORDER BY at_us, event_id)),
    b AS (SELECT *, CASE change WHEN 'removed' THEN 2 WHEN 'created' THEN 1 ELSE 0 END AS strength,
        sum(CASE WHEN prev IS NULL OR at_us - prev >= {_QUIET} THEN 1 ELSE 0 END)
          OVER (PARTITION BY root_id, rel ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM o),
    c AS (SELECT root_id, rel, min(event_id) AS event_id, max(at_us) AS at_us, max(strength) AS top,
        min_by(strength, event_id) AS begin, count(*) AS n_raw FROM b GROUP BY root_id, rel, burst),
    coalesced AS (SELECT root_id, rel, event_id, at_us, CASE top WHEN 2 THEN 'removed' WHEN 1 THEN 'created' ELSE 'modified' END AS change, n_raw
        FROM c WHERE NOT (begin = 1 AND top = 2))"""


@register("fs_coalesce", with_sql("chg", _COALESCE_SQL + " SELECT * FROM coalesced"))
def fs_coalesce(spark, sf):
    return A.coalesce_changes(S.chg(spark, sf), quiet_us=_QUIET)


_ECHO_SQL = """NOT EXISTS (SELECT 1 FROM fx w WHERE w.source = 'tool' AND w.kind = 'write' AND w.root_id = c.root_id
    AND w.rel = c.rel AND w.end_us BETWEEN c.at_us - 36000000000 AND c.at_us + 3600000000)"""


def _writes(spark, sf):
    return S.fx(spark, sf, "purchase")  # the tools' own writes


@register("echo_suppress", with_sql("chg", f"SELECT c.event_id, c.root_id, c.rel, c.at_us, c.change FROM chg c WHERE {_ECHO_SQL}"))
def echo_suppress(spark, sf):
    return A.suppress_echoes(S.chg(spark, sf), _writes(spark, sf), before_us=10 * HOUR, after_us=HOUR)


def _attribute_sql(source: str) -> str:
    return f"""SELECT event_id, at_us, root_id, rel, change, window_who, call_id FROM (
      SELECT c.event_id, c.at_us, c.root_id, c.rel, c.change, w.who AS window_who, w.call_id,
        row_number() OVER (PARTITION BY c.event_id ORDER BY w.start_us DESC NULLS LAST, w.ord) AS n
      FROM {source} c LEFT JOIN win w ON w.root_id = c.root_id AND c.at_us >= w.start_us - 60000000
        AND c.at_us <= coalesce(w.end_us, {S.NOW_US}) + 480000000) WHERE n = 1"""


def _attribute(changes, windows):
    return A.attribute(
        changes.select("event_id", "at_us", "root_id", "rel", "change"),
        windows,
        S.NOW_US,
        start_slack_us=60 * US,
        end_slack_us=480 * US,
    )


@register("attribution", with_sql("chg win", _attribute_sql("chg")))
def attribution(spark, sf):
    return _attribute(S.chg(spark, sf), S.win(spark, sf))


@register(
    "provenance",
    with_sql(
        "chg win",
        f"""
    WITH hit AS ({_attribute_sql("chg")}),
    calls AS (SELECT who, call_id, 'bash ' || (call_id % 7) AS tool, 'cmd ' || call_id AS input FROM win WHERE call_id % 3 <> 0),
    copies AS (SELECT who, call_id, 'copy' AS tool, 'old ' || call_id AS input FROM win WHERE call_id % 2 = 0)
    SELECT event_id, window_who AS who, a.call_id,
      CASE WHEN a.call_id IS NOT NULL THEN coalesce(c.tool, r.tool, 'bash') END AS tool,
      CASE WHEN c.tool IS NOT NULL THEN c.input ELSE r.input END AS input
    FROM hit a LEFT JOIN calls c ON c.who = a.window_who AND c.call_id = a.call_id
      LEFT JOIN copies r ON r.who = a.window_who AND r.call_id = a.call_id""",
    ),
)
def provenance(spark, sf):
    w = S.win(spark, sf)
    events = attribution(spark, sf).select("event_id", F.col("window_who").alias("who"), "call_id")
    cid = F.col("call_id").cast("string")
    calls = w.where("call_id % 3 <> 0").select(
        "who",
        "call_id",
        F.concat(F.lit("bash "), (F.col("call_id") % 7).cast("string")).alias("tool"),
        F.concat(F.lit("cmd "), cid).alias("input"),
    )
    copies = w.where("call_id % 2 = 0").select(
        "who", "call_id", F.lit("copy").alias("tool"), F.concat(F.lit("old "), cid).alias("input")
    )
    return A.with_provenance(events, calls, copies).select("event_id", "who", "call_id", "tool", "input")


@register(
    "reset_reload",
    with_sql(
        "fx",
        """SELECT event_id, who, source, rel FROM fx WHERE NOT (source = 'tool' AND who % 7 = 3)
        UNION ALL SELECT event_id + 1000000000, who, source, rel FROM fx WHERE source = 'tool' AND who % 7 = 3 AND event_id % 2 = 0""",
    ),
)
def reset_reload(spark, sf):
    f = S.fx(spark, sf).select("event_id", "who", "source", "rel")
    reread = f.where("source = 'tool' AND who % 7 = 3 AND event_id % 2 = 0")
    fresh = reread.withColumn("event_id", F.col("event_id") + 1_000_000_000)
    return A.reset_reload(f, f.where("who % 7 = 3").select("who"), fresh)


@register(
    "attribution_report",
    with_sql(
        "chg win",
        _COALESCE_SQL
        + f""",
    kept AS (SELECT * FROM coalesced c WHERE {_ECHO_SQL}),
    hit AS ({_attribute_sql("kept")}),
    nb AS (SELECT unnest({_PREFIXES}) AS node, at_us // 3600000000 AS bucket, coalesce(window_who, -1) AS who, at_us, event_id FROM hit),
    r AS (SELECT *, row_number() OVER (PARTITION BY node, bucket ORDER BY at_us DESC, event_id) AS n FROM nb)
    SELECT node, who, count(*) AS cells FROM r WHERE n = 1 GROUP BY node, who""",
    ),
)
def attribution_report(spark, sf):
    """Changes are coalesced, echoes dropped, the rest attributed and drawn per path and hour;
    the result counts the cells that each author owns."""
    changes = A.coalesce_changes(S.chg(spark, sf), quiet_us=_QUIET)
    # Later steps look at their input twice (sizes first), so the reduced changes are staged.
    kept = staged(A.suppress_echoes(changes, _writes(spark, sf), before_us=10 * HOUR, after_us=HOUR))
    found = _attribute(kept, S.win(spark, sf))
    events = found.select(
        "event_id",
        "rel",
        F.coalesce("window_who", F.lit(-1).cast("bigint")).alias("who"),
        F.col("at_us").alias("start_us"),
        F.col("at_us").alias("end_us"),
        F.lit("write").alias("kind"),
    )
    cells = T.gantt_nodes(events, 3600)
    return cells.groupBy("node", "who").agg(F.count(F.lit(1)).alias("cells"))
