"""Queries on paths, URLs and their hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelane.config import DEFAULTS
from tracelane.functions import paths as P
from tracelane.operators import roots as R
from tracelane.operators import tree as TR
from tracelane.plans import shims as S
from tracelane.plans.shims import with_sql

REGISTERED: dict = {}


def register(name, sql=None):
    def add(fn):
        REGISTERED[name] = (fn, sql)
        return fn

    return add


# --- path text -------------------------------------------------------------------------

_SUFFIXES = [":raw", ":2-40,77-81:raw", ":img", "", ":x9", ":-3+2:1:2", ":conflicts:7", ":+1"]


def _suffix(n):
    return F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (n % len(_SUFFIXES) + 1).cast("int"))


_SUFFIX_SQL = "[" + ", ".join(f"'{s}'" for s in _SUFFIXES) + f"][page_id % {len(_SUFFIXES)} + 1]"
_SEL = "':(raw|img|conflicts|[0-9-][0-9,+-]*)$'"


@register(
    "strip_selector",
    with_sql(
        "pg",
        f"SELECT page_id, regexp_replace(regexp_replace(url || {_SUFFIX_SQL}, {_SEL}, ''), {_SEL}, '') AS path FROM pg",
    ),
)
def strip_selector(spark, sf):
    return S.pg(spark, sf).select(
        "page_id", P.strip_selector(F.concat("url", _suffix(F.col("page_id")))).alias("path")
    )


_RAW_FORMS = ["/r/{p}", "a/./{p}/../b", "../../x/{p}", "~/{p}", "{p}?q=1/2:raw", "/../{p}//y/", "http://h/{p}", "~"]


def _raw():
    path = F.regexp_extract("url", "//(.*)", 1)
    forms = []
    for form in _RAW_FORMS:
        a, _, b = form.partition("{p}")
        forms.append(F.concat(F.lit(a), path, F.lit(b)) if "{p}" in form else F.lit(form))
    return F.element_at(F.array(*forms), (F.col("page_id") % len(_RAW_FORMS) + 1).cast("int"))


_RAW_SQL = (
    "["
    + ", ".join("'" + f.replace("{p}", "' || regexp_extract(url, '//(.*)', 1) || '") + "'" for f in _RAW_FORMS)
    + f"][page_id % {len(_RAW_FORMS)} + 1]"
)
_CLEAN_SQL = f"""
    r AS (SELECT page_id, {_RAW_SQL} AS raw FROM pg),
    s AS (SELECT page_id, raw, regexp_replace(regexp_replace(split_part(raw, '?', 1), {_SEL}, ''), {_SEL}, '') AS p FROM r),
    e AS (SELECT page_id, raw, CASE WHEN p = '~' THEN '/home/user' WHEN starts_with(p, '~/') THEN '/home/user/' || substring(p, 3) ELSE p END AS p FROM s),
    j AS (SELECT page_id, raw, CASE WHEN starts_with(p, '/') THEN p ELSE '/work/dir/' || p END AS p FROM e),
    abs AS (SELECT page_id, raw, CASE WHEN NOT contains(raw, '://') THEN '/' || array_to_string(list_reduce(
      [x for x in string_split(p, '/') if x <> '' AND x <> '.'],
      lambda acc, x: CASE WHEN x = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[:-2] ELSE list_append(acc, x) END,
      CAST([] AS VARCHAR[])), '/') END AS path FROM j)"""
_CLEAN_SQL = _CLEAN_SQL.replace(
    """list_reduce(
      [x for x in string_split(p, '/') if x <> '' AND x <> '.'],
      lambda acc, x:""",
    """list_reduce(
      list_transform(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x]),
      lambda acc, y:""",
).replace("WHEN x = '..' AND len(acc)", "WHEN y[1] = '..' AND len(acc)").replace("list_append(acc, x)", "list_concat(acc, y)")


@register("path_clean", with_sql("pg", "WITH " + _CLEAN_SQL.strip() + " SELECT page_id, path FROM abs"))
def path_clean(spark, sf):
    return S.pg(spark, sf).select(
        "page_id", P.absolutize(_raw(), F.lit("/work/dir"), DEFAULTS.home).alias("path")
    )


_HOST = "regexp_extract(url, '^https?://([^/]*)', 1)"


def _roots(spark, sf):
    """Checkouts: every host, and every language folder of a host."""
    url = S.pg(spark, sf).select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("h"), F.regexp_extract("url", "^https?://[^/]*/([^/?#]*)", 1).alias("l"))
    paths = url.select(F.explode(F.array(F.concat(F.lit("/w/"), "h"), F.concat(F.lit("/w/"), "h", F.lit("/"), "l"))).alias("prefix"))
    return paths.distinct().select(F.col("prefix"), F.length("prefix").cast("bigint").alias("root_id"))


@register(
    "longest_prefix",
    with_sql(
        "pg",
        f"""
    WITH p AS (SELECT page_id, '/w/' || {_HOST} AS h, '/w/' || {_HOST} || '/' || regexp_extract(url, '^https?://[^/]*/([^/?#]*)', 1) AS l,
      '/w/' || {_HOST} || '/' || regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS full_path FROM pg)
    SELECT page_id, full_path AS path, length(l) AS root_id, regexp_replace(substring(full_path, length(l) + 2), '/$', '') AS rel FROM p""",
    ),
)
def longest_prefix(spark, sf):
    path = F.concat(
        F.lit("/w/"), F.regexp_extract("url", "^https?://([^/]*)", 1), F.lit("/"), F.regexp_extract("url", "^https?://[^/]*/([^?#]*)", 1)
    )
    pages = S.pg(spark, sf).select("page_id", path.alias("path"))
    found = R.project_rel(pages, _roots(spark, sf))
    return found.select("page_id", "path", "root_id", F.regexp_replace("rel", "/$", "").alias("rel"))


@register(
    "scope_counts",
    with_sql(
        "pg",
        f"""
    WITH q AS (SELECT page_id, regexp_extract(url, '//(.*)', 1) AS p FROM pg),
    r AS (SELECT page_id, p, page_id % 10 AS f FROM q)
    SELECT CASE f WHEN 0 THEN 'remote' WHEN 1 THEN 'session' WHEN 2 THEN 'project' WHEN 3 THEN 'project' WHEN 4 THEN 'session'
      WHEN 5 THEN 'session' WHEN 6 THEN 'external' WHEN 8 THEN 'external' END AS scope,
      CASE f WHEN 2 THEN 0 WHEN 3 THEN 1 END AS root_id,
      CASE f WHEN 1 THEN '/s/p/one.jsonl' WHEN 4 THEN '/s/q/two.jsonl' WHEN 5 THEN '/s/p/one.jsonl' END AS scope_session,
      count(*) AS n, count(DISTINCT CASE WHEN f IN (0, 1, 2, 3, 4, 5, 6, 8) THEN page_id END) AS located FROM r GROUP BY ALL""",
    ),
)
def scope_counts(spark, sf):
    host = F.regexp_extract("url", "//([^/]*)", 1)
    p = F.concat(host, F.lit("/"), F.col("page_id").cast("string"))
    lit = F.lit
    forms = [
        F.concat(lit("ssh://"), p, lit(":raw")),
        F.concat(lit("local://"), p, lit("?q")),
        F.concat(lit("src/"), p),
        F.concat(lit("/w/repo/inner/"), p, lit(":1-2")),
        F.concat(lit("/s/other/two/"), p),
        F.concat(lit("/tmp/"), p),
        F.concat(lit("/etc/"), p),
        F.concat(lit("xd://"), p),
        F.concat(lit("/w/repository/"), p),
        F.concat(lit("ssh://"), host),
    ]
    calls = S.pg(spark, sf).select(
        "page_id",
        F.element_at(F.array(*forms), (F.col("page_id") % 10 + 1).cast("int")).alias("raw"),
        F.lit("/w/repo").alias("cwd"),
        F.lit("/s/p/one.jsonl").alias("session"),
    )
    roots = spark.createDataFrame([(0, "/w/repo"), (1, "/w/repo/inner")], "root_id int, prefix string")
    sessions = spark.createDataFrame([("/s/p/one.jsonl",), ("/s/q/two.jsonl",)], "session string")
    found = R.locate(calls, roots, sessions, ("/s",))
    return found.groupBy("scope", "root_id", "scope_session").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("scope").isNotNull(), F.col("page_id"))).alias("located")
    )


@register(
    "web_segments",
    with_sql(
        "pg",
        """SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host,
      '/' || regexp_extract(url, '^https?://[^/]*/(.*)', 1) AS path FROM pg""",
    ),
)
def web_segments(spark, sf):
    segs = P.tree_segments(F.lit("webfetch"), F.col("url"), DEFAULTS.home)
    return S.pg(spark, sf).select("page_id", segs[0].alias("host"), segs[1].alias("path"))


@register(
    "remote_segments",
    with_sql(
        "pg",
        """
    WITH r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ssh://' || regexp_extract(url, '//([^/]*)', 1)
      WHEN 1 THEN 'scp' || regexp_extract(url, '(://.*)', 1) ELSE regexp_extract(url, '//(.*)', 1) END AS rel FROM pg),
    p AS (SELECT page_id, CASE WHEN contains(rel, '://') THEN rel ELSE 'ssh://' || rel END AS u FROM r),
    h AS (SELECT page_id, regexp_extract(u, '^[^:]*://[^/]*') AS top, regexp_replace(regexp_replace(regexp_replace(u, '^[^:]*://[^/]*', ''), '//+', '/', 'g'), '(^/|/$)', '', 'g') AS rest FROM p)
    SELECT page_id, top || '|' || CASE WHEN rest = '' THEN '$' ELSE replace(rest, '/', '|') END AS segs FROM h""",
    ),
)
def remote_segments(spark, sf):
    n = F.col("page_id") % 3
    rel = (
        F.when(n == 0, F.concat(F.lit("ssh://"), F.regexp_extract("url", "//([^/]*)", 1)))
        .when(n == 1, F.concat(F.lit("scp"), F.regexp_extract("url", "(://.*)", 1)))
        .otherwise(F.regexp_extract("url", "//(.*)", 1))
    )
    segs = P.tree_segments(F.lit("remote"), rel, DEFAULTS.home)
    return S.pg(spark, sf).select("page_id", F.array_join(segs, "|").alias("segs"))


@register(
    "label_collisions",
    """
    WITH r AS (SELECT p_partkey AS root_id, '/w/' || p_brand || '/' || p_type || '/' || p_name || (p_partkey % 97) AS path FROM part),
    n AS (SELECT *, count(*) OVER (PARTITION BY regexp_extract(path, '[^/]*$')) AS c FROM r)
    SELECT root_id, CASE WHEN c = 1 THEN regexp_extract(path, '[^/]*$') ELSE path END AS label FROM n""",
)
def label_collisions(spark, sf):
    part = S.table(spark, sf, "part")
    path = F.concat(
        F.lit("/w/"), F.concat_ws("/", "p_brand", "p_type", "p_name"), (F.col("p_partkey") % 97).cast("string")
    )
    return R.label_roots(part.select(F.col("p_partkey").alias("root_id"), path.alias("path"))).select("root_id", "label")


# --- hierarchies -----------------------------------------------------------------------


def _part_events(spark, sf):
    """Touches of part paths: one event per line item."""
    items = S.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        (F.col("l_orderkey") % 3).alias("root_id"),
        S.micros("l_shipdate").alias("end_us"),
        F.when(F.col("l_returnflag") == "R", "write").otherwise("read").alias("kind"),
        F.col("l_suppkey").alias("who"),
    )
    return items.join(S.tp(spark, sf), "p_partkey")


_ITEMS = """it AS (SELECT l_orderkey % 3 AS root_id, epoch_us(l_shipdate) AS end_us, l_returnflag = 'R' AS w, l_suppkey AS who,
    p_brand, p_type, p_name, p_brand || '/' || p_type || '/' || p_name AS rel FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_UP3 = "[p_brand, p_brand || '/' || p_type, rel]"


@register(
    "path_rollup",
    f"""WITH {_ITEMS}, k AS (SELECT root_id, end_us, w, unnest({_UP3}) AS key, unnest([0, 1, 2]) AS depth FROM it)
    SELECT 'f' || root_id AS forest, key, depth, count(*) AS n_events, count(*) FILTER (WHERE w) AS n_writes, max(end_us) AS last_end_us,
      depth < 2 AS is_dir FROM k GROUP BY root_id, key, depth""",
)
def path_rollup(spark, sf):
    forest = F.concat(F.lit("f"), F.col("root_id").cast("string"))
    return TR.path_rollup(_part_events(spark, sf), F.split("rel", "/"), forest).drop("path")


def _listing(spark, sf):
    """Two checkouts with about two thirds and one half of the paths."""
    tp = S.tp(spark, sf)
    return (
        tp.where("p_partkey % 3 <> 0")
        .select(F.lit(0).alias("root_id"), "rel")
        .unionByName(tp.where("p_partkey % 2 = 0").select(F.lit(1).alias("root_id"), "rel"))
        .withColumn("is_dir", F.lit(False))
    )


_LISTING = """l AS (SELECT DISTINCT * FROM (SELECT 0 AS root_id, p_brand, p_type, p_brand || '/' || p_type || '/' || p_name AS rel FROM part WHERE p_partkey % 3 <> 0
    UNION ALL SELECT 1, p_brand, p_type, p_brand || '/' || p_type || '/' || p_name FROM part WHERE p_partkey % 2 = 0))"""


@register(
    "presence",
    f"""WITH {_LISTING}, k AS (SELECT DISTINCT root_id, unnest([p_brand, p_brand || '/' || p_type, rel]) AS key FROM l)
    SELECT key, string_agg(CAST(root_id AS VARCHAR), ',' ORDER BY root_id) AS present_in, count(*) < 2 AS partial FROM k GROUP BY key""",
)
def presence(spark, sf):
    out = TR.presence(TR.merge_listings(_listing(spark, sf)), 2)
    return out.withColumn("present_in", F.array_join(F.transform("present_in", lambda r: r.cast("string")), ","))


@register(
    "deleted_paths",
    f"""WITH {_ITEMS}, {_LISTING}
    SELECT DISTINCT it.root_id, it.rel, it.root_id < 2 AND l.rel IS NULL AS deleted FROM it LEFT JOIN l ON l.root_id = it.root_id AND l.rel = it.rel""",
)
def deleted_paths(spark, sf):
    """The third root has not been walked, so nothing in it counts as deleted."""
    listing = _listing(spark, sf)
    walked = listing.select("root_id").distinct()
    return TR.deleted(_part_events(spark, sf), listing, walked)


@register(
    "deleted_merged",
    f"""WITH {_ITEMS}, {_LISTING} SELECT DISTINCT it.rel, it.rel NOT IN (SELECT rel FROM l) AS deleted FROM it""",
)
def deleted_merged(spark, sf):
    return TR.deleted_merged(_part_events(spark, sf), _listing(spark, sf))


def _page_leaves(spark, sf):
    """Page addresses as paths: host labels from the top level down, then the path's parts."""
    host = F.reverse(F.split(F.regexp_extract("url", "^https?://([^/]*)", 1), "\\."))
    path = F.split(F.regexp_extract("url", "^https?://[^/]*/([^?#]*)", 1), "/")
    segs = F.filter(F.concat(host, path), lambda s: s != "")
    return S.pg(spark, sf).select(F.lit("m").alias("forest"), segs.alias("segs"))


_LEAVES = """lv AS (SELECT DISTINCT list_filter(list_concat(list_reverse(string_split(regexp_extract(url, '^https?://([^/]*)', 1), '.')),
    string_split(regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1), '/')), lambda x: x <> '') AS s FROM pages),
    st AS (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM lv),
    nd AS (SELECT s[1:n] AS k, n, bool_or(n < len(s)) AS is_dir FROM st GROUP BY ALL)"""


@register(
    "compact_paths",
    f"""WITH {_LEAVES},
    kid AS (SELECT k[1:n - 1] AS k, count(*) AS kids, bool_or(is_dir) AS d FROM nd WHERE n > 1 GROUP BY ALL),
    keep AS (SELECT nd.* FROM nd LEFT JOIN kid USING (k) WHERE NOT (coalesce(kid.kids, 0) = 1 AND coalesce(kid.d, false))),
    up AS (SELECT a.k, a.n, a.is_dir, max(b.n) AS u FROM keep a LEFT JOIN keep b ON b.n < a.n AND a.k[1:b.n] = b.k GROUP BY ALL)
    SELECT 'm' AS forest, array_to_string(k, '/') AS key, array_to_string(k[coalesce(u, 0) + 1:], '/') AS name,
      CASE WHEN u IS NOT NULL THEN array_to_string(k[1:u], '/') END AS parent_key, is_dir FROM up""",
)
def compact_paths(spark, sf):
    return TR.compact(TR.nodes_of(_page_leaves(spark, sf), F.col("segs"))).drop("path")


@register(
    "tree_order",
    f"""WITH p AS (SELECT DISTINCT 'f' AS forest, p_brand, p_type, p_name FROM part),
    nd AS (SELECT DISTINCT unnest([p_brand, p_brand || '/' || p_type, p_brand || '/' || p_type || '/' || p_name]) AS key, unnest([true, true, false]) AS is_dir,
      unnest([[p_brand], [p_brand, p_type], [p_brand, p_type, p_name]]) AS s FROM p)
    SELECT 'f' AS forest, key, CAST(len(s) - 1 AS INT) AS depth, is_dir, row_number() OVER (ORDER BY lower(s[1]), s[1], lower(s[2]) NULLS FIRST, s[2] NULLS FIRST, lower(s[3]) NULLS FIRST, s[3] NULLS FIRST) AS pos FROM nd""",
)
def tree_order(spark, sf):
    leaves = S.tp(spark, sf).select(F.lit("f").alias("forest"), "rel").distinct()
    return TR.tree_order(TR.nodes_of(leaves, F.split("rel", "/"))).drop("path")


def _touches(spark, sf):
    return TR.node_touches(S.fx(spark, sf).select("rel", "who"), F.split("rel", "/"), F.lit("f"))


_TOUCH = """t AS (SELECT DISTINCT unnest([regexp_extract(rel, '^[^/]+'), regexp_extract(rel, '^[^/]+/[^/]+'), rel]) AS key,
    unnest([true, true, false]) AS is_dir, who FROM fx)"""


@register(
    "touching",
    with_sql("fx parts", f"WITH {_TOUCH} SELECT 'f' AS forest, key, who FROM t UNION SELECT 'f', key, main FROM t JOIN parts USING (who)"),
)
def touching(spark, sf):
    return TR.touching(_touches(spark, sf), S.participants(spark, sf))


@register(
    "touched_dirs",
    with_sql(
        "fx parts",
        f"""WITH {_TOUCH} SELECT who AS focus, 'f' AS forest, key FROM t JOIN parts USING (who) WHERE is_dir AND kind <> 'main'
      UNION SELECT main, 'f', key FROM t JOIN parts USING (who) WHERE is_dir""",
    ),
)
def touched_dirs(spark, sf):
    return TR.touched_dirs(_touches(spark, sf), S.participants(spark, sf))


@register(
    "web_hosts",
    with_sql(
        "pg",
        """
    WITH s AS (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host, '/' || regexp_extract(url, '^https?://[^/]*/(.*)', 1) AS path FROM pg),
    k AS (SELECT page_id, unnest([host, host || '/' || path]) AS key, unnest([0, 1]) AS depth FROM s)
    SELECT 'w' AS forest, key, depth, count(*) AS n_events, CAST(0 AS BIGINT) AS n_writes, max(page_id) AS last_end_us, depth = 0 AS is_dir FROM k GROUP BY key, depth""",
    ),
)
def web_hosts(spark, sf):
    fetched = S.pg(spark, sf).select("url", F.col("page_id").alias("end_us"), F.lit("read").alias("kind"))
    segs = P.tree_segments(F.lit("webfetch"), F.col("url"), DEFAULTS.home)
    return TR.path_rollup(fetched, segs, F.lit("w"), by=("url",)).drop("path")


@register(
    "mcp_servers",
    with_sql(
        "ev",
        """
    WITH c AS (SELECT 'srv' || (k % 4) AS server, 'tool_' || (k % 9) AS tool, at_us, event_type = 'error' AS failed FROM ev),
    k AS (SELECT at_us, unnest([server, server || '/' || tool]) AS key, unnest([0, 1]) AS depth FROM c WHERE NOT failed)
    SELECT 'mcp' AS forest, key, depth, count(*) AS n_events, CAST(0 AS BIGINT) AS n_writes, max(at_us) AS last_end_us, depth = 0 AS is_dir FROM k GROUP BY key, depth""",
    ),
)
def mcp_servers(spark, sf):
    from tracelane.functions.calls import split_mcp

    k = F.col("k")
    name = F.concat(F.lit("mcp__srv"), (k % 4).cast("string"), F.lit("__tool_"), (k % 9).cast("string"))
    calls = S.ev(spark, sf).where("event_type <> 'error'").withColumn("m", split_mcp(name))
    events = calls.select(
        F.concat("m.server", F.lit("/"), "m.tool").alias("rel"), F.col("at_us").alias("end_us"), F.lit("read").alias("kind")
    )
    return TR.path_rollup(events, P.tree_segments(F.lit("mcp"), F.col("rel"), DEFAULTS.home), F.lit("mcp")).drop("path")
