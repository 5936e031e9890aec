"""Project roots: which checkout a path belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.config import DEFAULTS, Params
from tracelane.functions import paths as P


def root_prefixes(roots: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``(root_id, prefix)`` of the roots and their other spellings."""
    own = roots.select("root_id", F.col("path").alias("prefix"))
    return own if aliases is None else own.unionByName(aliases.select("root_id", "prefix")).distinct()


def project_rel(df: DataFrame, prefixes: DataFrame, path: str = "path") -> DataFrame:
    """Add ``root_id`` and ``rel``: the deepest root that contains the path, NULL if none.

    A path is matched by equality with one of its own ancestors, so no range or nested-loop
    join is planned however many roots there are. Distinct paths are resolved once. On equal
    depth the highest ``root_id`` wins.
    """
    roots = prefixes.select(P.clean(F.col("prefix")).alias("_prefix"), F.col("root_id").alias("_root"))
    each = df.select(F.col(path).alias("_path")).where(F.col(path).isNotNull()).distinct()
    parts = each.select("_path", F.explode(P.absolute_prefixes(F.col("_path"))).alias("_prefix"))
    rank = F.struct(F.size(P.components(F.col("_prefix"))).alias("d"), F.col("_root").alias("r"), F.col("_prefix").alias("p"))
    best = parts.join(roots, "_prefix").groupBy("_path").agg(F.max(rank).alias("_best"))
    cut = F.when(F.col("_best.p") == "/", F.lit(1)).otherwise(F.length("_best.p") + 1)
    rel = F.regexp_replace(F.col("_path").substr(cut, F.length("_path")), r"\A/", "")
    best = best.select("_path", F.col("_best.r").alias("root_id"), rel.alias("rel"))
    return df.join(best, df[path] == best["_path"], "left").drop("_path")


def label_roots(roots: DataFrame, path: str = "path") -> DataFrame:
    """Base name where no other root has it, else the whole path."""
    named = roots.withColumn("_name", P.base_name(F.col(path)))
    counts = named.groupBy("_name").agg(F.count(F.lit(1)).alias("_n"))
    label = F.when((F.col("_n") == 1) & (F.col("_name") != ""), F.col("_name")).otherwise(F.col(path))
    return named.join(counts, "_name").withColumn("label", label).drop("_name", "_n")


def nested_roots(roots: DataFrame) -> DataFrame:
    """``(root_id, nested_id)`` where the second root lies strictly inside the first."""
    inner = roots.select(F.col("root_id").alias("nested_id"), F.col("path").alias("_inner"))
    ups = inner.select("nested_id", "_inner", F.explode(P.absolute_prefixes(P.parent(F.col("_inner")))).alias("path"))
    return ups.join(roots, "path").where(F.col("_inner") != F.col("path")).select("root_id", "nested_id")


def remap_roots(old: DataFrame, new: DataFrame) -> DataFrame | None:
    """``(root_id, new_id)`` after the set of roots changed, or None if a reload is due.

    A root that went away, or a new one that nests with an old one, changes what earlier
    paths resolve to. Root tables hold one row per checkout.
    """
    if old.join(new, "path", "left_anti").limit(1).count():
        return None
    added = new.join(old, "path", "left_anti")
    both = added.select(F.concat(F.lit("n"), F.col("root_id")).alias("root_id"), "path").unionByName(
        old.select(F.concat(F.lit("o"), F.col("root_id")).alias("root_id"), "path")
    )
    mixed = nested_roots(both).where(F.substring("root_id", 1, 1) != F.substring("nested_id", 1, 1))
    if mixed.limit(1).count():
        return None
    return old.join(new.select("path", F.col("root_id").alias("new_id")), "path").select("root_id", "new_id")


def apply_remap(df: DataFrame, mapping: DataFrame) -> DataFrame:
    out = df.join(mapping, "root_id", "left")
    return out.withColumn("root_id", F.col("new_id")).drop("new_id").select(*df.columns)


def locate(
    df: DataFrame,
    prefixes: DataFrame,
    sessions: DataFrame | None = None,
    session_roots: tuple[str, ...] = (),
    p: Params = DEFAULTS,
    raw: str = "raw",
    cwd: str = "cwd",
    session: str = "session",
) -> DataFrame:
    """Classify a tool's path argument: adds ``scope``, ``root_id``, ``scope_session``, ``rel``.

    ``session`` is the transcript path of the caller's session (NULL without one); ``sessions``
    lists the known ones and ``session_roots`` the folders that hold
    ``<project dir>/<session stem>/...``. ``scope`` is NULL where the argument names no file.
    """
    r, own = F.col(raw), F.col(session)
    df = df.withColumn("_abs", P.absolutize(r, F.col(cwd), p.home))
    df = project_rel(df, prefixes, "_abs").withColumnsRenamed({"root_id": "_root", "rel": "_rel"})
    under = F.lit(None).cast("string")
    for top in reversed(session_roots):
        skip = len([s for s in top.split("/") if s])
        parts = P.components(F.col("_abs"))
        under = F.when(P.is_under(F.col("_abs"), F.lit(top)), F.try_element_at(parts, F.lit(skip + 2))).otherwise(under)
    df = df.withColumn("_stem", under)
    if sessions is not None and session_roots:
        known = sessions.groupBy(P.stem(F.col("session")).alias("_stem")).agg(F.min("session").alias("_other"))
        df = df.join(known, "_stem", "left")
    else:
        df = df.withColumn("_other", F.lit(None).cast("string"))
    is_ssh, is_local = r.startswith("ssh://"), r.startswith("local://")
    ssh = P.strip_selector(P.without_query(F.substring(r, 7, 1 << 30)))
    host = F.substring_index(ssh, "/", 1)
    path = ssh.substr(F.instr(ssh, "/") + 1, F.length(ssh))
    ssh_ok = ssh.contains("/") & (host != "") & (F.regexp_replace(path, "/", "") != "")
    name = P.strip_selector(P.without_query(F.substring(r, 9, 1 << 30)))
    local_ok = own.isNotNull() & (name != "")
    temp = F.lit(False)
    for t in p.temp_roots:
        temp = temp | P.is_under(F.col("_abs"), F.lit(t))
    temp = temp & own.isNotNull()
    at = F.col("_abs")
    scope = (
        F.when(is_ssh, F.when(ssh_ok, "remote"))
        .when(is_local, F.when(local_ok, "session"))
        .when(at.isNull(), None)
        .when(F.col("_root").isNotNull(), "project")
        .when(F.col("_other").isNotNull() | temp, "session")
        .otherwise("external")
    )
    rel = (
        F.when(F.col("scope") == "remote", F.concat(F.lit("ssh://"), host, F.lit("/"), path))
        .when((F.col("scope") == "session") & is_local, F.concat(P.without_extension(own), F.lit("/local/"), name))
        .when(F.col("scope") == "project", F.col("_rel"))
        .when(F.col("scope").isNotNull(), at)
    )
    owner = F.when(F.col("scope") == "session", F.when(is_local, own).otherwise(F.coalesce("_other", own)))
    return (
        df.withColumn("scope", scope)
        .withColumn("root_id", F.when(F.col("scope") == "project", F.col("_root")))
        .withColumn("scope_session", owner)
        .withColumn("rel", rel)
        .drop("_abs", "_root", "_rel", "_stem", "_other")
    )


def session_rest(rel: Column, session_roots: tuple[str, ...]) -> Column:
    """The part of a path below ``<session root>/<project dir>/<session stem>``, else NULL."""
    out = F.lit(None).cast("string")
    for top in reversed(session_roots):
        skip = len([s for s in top.split("/") if s]) + 2
        parts = P.components(rel)
        rest = F.array_join(F.slice(parts, F.lit(skip + 1), F.greatest(F.size(parts) - skip, F.lit(0))), "/")
        out = F.when(P.is_under(rel, F.lit(top)) & (F.size(parts) >= skip), rest).otherwise(out)
    return out
