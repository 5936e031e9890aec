"""The canonical tables derived from the benchmark's parquet tables.

Every shim is one projection over a whole table; times are BIGINT microseconds since the
epoch. ``SQL`` holds the same projections for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.session import prepare

MIN_US = 60_000_000
DAY_US = 86_400_000_000
NOW_US = 1_706_659_200_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def ev(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("who"),
        (F.col("user_id") % 3).alias("root_id"),
        micros("ts").alias("at_us"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def minutes(value: Column) -> Column:
    return F.floor(value).cast("bigint") * MIN_US


def fx(spark, sf, *types: str) -> DataFrame:
    """File events; ``types`` limits the event types where the scan can see it."""
    e, t, k = ev(spark, sf), F.col("event_type"), F.col("k")
    e = e.where(t.isin(*types)) if types else e
    suffix = F.when(k % 4 == 0, ".py").when(k % 4 == 1, ".rs").when(k % 4 == 2, ".sh").otherwise(".md")
    return e.select(
        "event_id",
        "who",
        "root_id",
        F.col("at_us").alias("start_us"),
        (F.col("at_us") + minutes(F.col("value"))).alias("end_us"),
        F.concat(F.lit("src/m"), (k % 10).cast("string"), F.lit("/f"), k.cast("string"), suffix).alias("rel"),
        F.when(t.isin("purchase", "signup", "error"), "write").otherwise("read").alias("kind"),
        F.when(t == "signup", "window").when(t == "error", "watcher").otherwise("tool").alias("source"),
        F.when(t.isin("click", "view"), "read").when(t == "purchase", "write").when(t == "signup", "bash").alias("tool"),
        F.when((t == "view") & (k % 5 == 0), "webfetch").otherwise("project").alias("scope"),
    )


def win(spark, sf) -> DataFrame:
    return (
        ev(spark, sf)
        .where("event_type = 'signup'")
        .select(
            F.col("event_id").alias("call_id"),
            "who",
            "root_id",
            F.col("at_us").alias("start_us"),
            F.when(F.col("event_id") % 10 != 0, F.col("at_us") + minutes(F.col("value"))).alias("end_us"),
            F.col("event_id").alias("ord"),
        )
    )


def chg(spark, sf) -> DataFrame:
    m = F.col("event_id") % 3
    return (
        fx(spark, sf, "error")
        .select(
            "event_id",
            "root_id",
            "rel",
            F.col("start_us").alias("at_us"),
            F.when(m == 0, "modified").when(m == 1, "created").otherwise("removed").alias("change"),
        )
    )


def li(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("who"),
        micros("l_shipdate").alias("start_us"),
        (micros("l_shipdate") + F.col("l_quantity").cast("bigint") * DAY_US).alias("end_us"),
    )


def tp(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("/", "p_brand", "p_type", "p_name").alias("rel")
    )


def conv(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), "role", "text"
    )


def pg(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url")


def doc(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("path"), F.col("doc_id").alias("ver"), F.col("text").alias("content")
    )


def participants(spark, sf) -> DataFrame:
    """Five users share a session; the lowest of them is its main."""
    session = F.floor(F.col("who") / 5)
    return (
        ev(spark, sf)
        .select("who")
        .distinct()
        .select(
            "who",
            session.alias("session"),
            (session * 5).alias("main"),
            F.when(F.col("who") % 5 == 0, "main").otherwise("subagent").alias("kind"),
        )
    )


SQL = {
    "ev": """SELECT event_id, user_id AS who, user_id % 3 AS root_id, epoch_us(ts) AS at_us, event_type, value,
        CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
    "fx": """SELECT event_id, who, root_id, at_us AS start_us,
        at_us + CAST(floor(value) AS BIGINT) * 60000000 AS end_us,
        'src/m' || CAST(k % 10 AS VARCHAR) || '/f' || CAST(k AS VARCHAR) ||
          CASE k % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.sh' ELSE '.md' END AS rel,
        CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 'write' ELSE 'read' END AS kind,
        CASE event_type WHEN 'signup' THEN 'window' WHEN 'error' THEN 'watcher' ELSE 'tool' END AS source,
        CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write'
          WHEN 'signup' THEN 'bash' END AS tool,
        CASE WHEN event_type = 'view' AND k % 5 = 0 THEN 'webfetch' ELSE 'project' END AS scope FROM ev""",
    "win": """SELECT event_id AS call_id, who, root_id, at_us AS start_us,
        CASE WHEN event_id % 10 = 0 THEN NULL ELSE at_us + CAST(floor(value) AS BIGINT) * 60000000 END AS end_us,
        event_id AS ord FROM ev WHERE event_type = 'signup'""",
    "chg": """SELECT event_id, root_id, rel, start_us AS at_us,
        CASE event_id % 3 WHEN 0 THEN 'modified' WHEN 1 THEN 'created' ELSE 'removed' END AS change
        FROM fx WHERE source = 'watcher'""",
    "li": """SELECT l_partkey AS who, epoch_us(l_shipdate) AS start_us,
        epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000000 AS end_us FROM lineitem""",
    "tp": "SELECT p_partkey, p_brand || '/' || p_type || '/' || p_name AS rel FROM part",
    "conv": "SELECT conv_id AS session, turn AS line_no, role, text FROM conversations",
    "pg": "SELECT page_id, url FROM pages",
    "doc": "SELECT source AS path, doc_id AS ver, text AS content FROM documents",
    "parts": """SELECT who, who // 5 AS session, (who // 5) * 5 AS main,
        CASE WHEN who % 5 = 0 THEN 'main' ELSE 'subagent' END AS kind FROM (SELECT DISTINCT who FROM ev)""",
}
_NEEDS = {"fx": ["ev"], "win": ["ev"], "chg": ["ev", "fx"], "parts": ["ev"]}


def with_sql(names: str, body: str) -> str:
    """``body`` with the named shims in front as common table expressions."""
    order: list[str] = []
    for name in names.split():
        for n in [*_NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    ctes = [f"{n} AS ({SQL[n]})" for n in order]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
