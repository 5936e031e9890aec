"""Queries on file contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelane.functions.text import apply_edits, utf8_cap
from tracelane.operators import content as C
from tracelane.plans import shims as S
from tracelane.plans.shims import with_sql

REGISTERED: dict = {}


def register(name, sql=None):
    def add(fn):
        REGISTERED[name] = (fn, sql)
        return fn

    return add


@register(
    "utf8_cap",
    with_sql(
        "doc",
        """
    WITH b AS (SELECT path, ver, content, encode(content) AS raw FROM doc),
    c AS (SELECT path, ver, CASE WHEN strlen(content) <= 4096 THEN content ELSE
      coalesce(try(decode(raw[1:4096])), try(decode(raw[1:4095])), try(decode(raw[1:4094])), try(decode(raw[1:4093]))) || chr(10) || '… (truncated)' END AS capped FROM b)
    SELECT path, ver, md5(capped) AS digest, CAST(length(capped) AS INT) AS n FROM c""",
    ),
)
def cap(spark, sf):
    d = S.doc(spark, sf).select("path", "ver", utf8_cap(F.col("content")).alias("capped"))
    return d.select("path", "ver", F.md5("capped").alias("digest"), F.length("capped").alias("n"))


_EDITS = [("the ", "THE ", True), ("en", "EN", False), ("", "never", False), (".", "!", True), ("xyzzy", "no", False)]


@register(
    "apply_edits",
    with_sql(
        "doc",
        """
    WITH a AS (SELECT path, ver, replace(content, 'the ', 'THE ') AS s FROM doc),
    b AS (SELECT path, ver, CASE WHEN strpos(s, 'en') = 0 THEN s ELSE substring(s, 1, strpos(s, 'en') - 1) || 'EN' || substring(s, strpos(s, 'en') + 2) END AS s FROM a)
    SELECT path, ver, md5(replace(CASE WHEN s = '' THEN 'never' ELSE s END, '.', '!')) AS digest FROM b""",
    ),
)
def edits(spark, sf):
    steps = F.array(
        *[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new"), F.lit(a).alias("all")) for o, n, a in _EDITS]
    )
    return S.doc(spark, sf).select("path", "ver", F.md5(apply_edits(F.col("content"), steps)).alias("digest"))


@register(
    "asof_prev",
    with_sql(
        "doc",
        """
    WITH p AS (SELECT path, ver, ver + ver % 3 * 20 AS probe_at FROM doc)
    SELECT p.path, p.ver AS probe_id, p.probe_at, d.ver AS prev_at, md5(d.content) AS prev_digest
    FROM p ASOF LEFT JOIN doc d ON d.path = p.path AND d.ver < p.probe_at""",
    ),
)
def asof_prev(spark, sf):
    d = S.doc(spark, sf)
    probes = d.select("path", F.col("ver").alias("probe_id"), (F.col("ver") + F.col("ver") % 3 * 20).alias("probe_at"))
    out = C.asof_prev(probes, d, ("path",), "probe_at", "ver")
    return out.select("path", "probe_id", "probe_at", "prev_at", F.md5("prev_content").alias("prev_digest"))


@register(
    "line_churn",
    with_sql(
        "doc",
        """
    WITH v AS (SELECT path, ver, lag(ver) OVER (PARTITION BY path ORDER BY ver) AS prev FROM doc),
    l AS (SELECT path, ver, line, count(*) AS n FROM (SELECT path, ver, unnest(string_split(content, chr(10))) AS line FROM doc) GROUP BY ALL),
    a AS (SELECT v.path, v.ver, l.line, l.n FROM v JOIN l ON l.path = v.path AND l.ver = v.ver WHERE v.prev IS NOT NULL
      UNION ALL SELECT v.path, v.ver, l.line, -l.n FROM v JOIN l ON l.path = v.path AND l.ver = v.prev),
    d AS (SELECT path, ver, line, sum(n) AS d FROM a GROUP BY ALL)
    SELECT path, ver, CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS removed FROM d GROUP BY path, ver""",
    ),
)
def line_churn(spark, sf):
    return C.line_churn(S.doc(spark, sf), ("path",), "ver")


@register(
    "snapshot_history",
    with_sql(
        "doc",
        """
    WITH s AS (SELECT path, ver // 3 AS t, ver AS seq, content FROM doc),
    l AS (SELECT *, lag(content) OVER (PARTITION BY path ORDER BY t, seq) AS p, row_number() OVER (PARTITION BY path ORDER BY t, seq) AS n FROM s)
    SELECT path, t, seq, md5(content) AS digest FROM l WHERE n = 1 OR p IS DISTINCT FROM content""",
    ),
)
def snapshot_history(spark, sf):
    """Recorded states of each path without repeats, where recordings may share a time."""
    d = S.doc(spark, sf)
    states = d.select("path", F.floor(F.col("ver") / 3).alias("t"), F.col("ver").alias("seq"), "content")
    return C.dedup_states(states, ("path",), "t", "content", order=("t", "seq")).select("path", "t", "seq", F.md5("content").alias("digest"))
