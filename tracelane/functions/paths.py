"""Path and URL text. Everything is a Column expression; paths compare per component."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that select a part of a file, after a colon.
SELECTOR = r":(raw|img|conflicts|[0-9-][0-9,+-]*)\z"


def strip_selector(c: Column) -> Column:
    """Drop up to two trailing selectors such as ``:raw`` or ``:2-40,77-81``."""
    return F.regexp_replace(F.regexp_replace(c, SELECTOR, ""), SELECTOR, "")


def without_query(c: Column) -> Column:
    return F.substring_index(c, "?", 1)


def clean(c: Column) -> Column:
    """Resolve ``.`` and ``..`` by text alone; ``..`` never climbs over the root or another ``..``."""
    parts = F.filter(F.split(c, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
            F.slice(acc, F.lit(1), F.size(acc) - 1),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(c.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def absolutize(raw: Column, cwd: Column, home: str | Column) -> Column:
    """A tool's path argument as a clean absolute path; NULL for anything with a scheme."""
    home = F.lit(home) if isinstance(home, str) else home
    plain = strip_selector(without_query(raw))
    expanded = F.when(plain == "~", home).when(
        plain.startswith("~/"), F.concat(home, F.lit("/"), F.substring(plain, 3, 1 << 30))
    ).otherwise(plain)
    joined = F.when(expanded.startswith("/"), expanded).otherwise(F.concat(cwd, F.lit("/"), expanded))
    return F.when(~raw.contains("://"), clean(joined))


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".") & (s != ".."))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*\z", "")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", "")


def extension(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1), F.lit(""))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def is_under(path: Column, prefix: Column) -> Column:
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def absolute_prefixes(path: Column) -> Column:
    """Every ancestor of an absolute path and the path itself, e.g. /, /a, /a/b."""
    segs = components(path)
    return F.concat(
        F.array(F.lit("/")),
        F.when(
            F.size(segs) > 0,
            F.transform(
                F.sequence(F.lit(1), F.size(segs)),
                lambda n: F.concat(F.lit("/"), F.array_join(F.slice(segs, F.lit(1), n), "/")),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def file_url_path(c: Column) -> Column:
    """``file://`` URL to path with percent decoding, or an absolute path as it is, else NULL.

    A ``%`` that starts no escape and every ``+`` stay as they are, so both are escaped before
    decoding.
    """
    encoded = F.regexp_replace(F.substring(c, 8, 1 << 30), r"\+", "%2B")
    encoded = F.regexp_replace(encoded, r"%(?![0-9A-Fa-f]{2})", "%25")
    # Escapes that are no UTF-8 give replacement characters; such a path is no path.
    decoded = F.try_url_decode(encoded)
    broken = decoded.contains("�") & ~encoded.contains("�") & ~F.lower(encoded).contains("%ef%bf%bd")
    return F.when(c.startswith("file://"), F.when(~broken, decoded)).when(c.startswith("/"), c)


def external_segments(path: Column, home: str) -> Column:
    """``~`` and the rest under the home folder, else the first component with its slash."""
    parts = components(path)
    depth = len([s for s in home.split("/") if s])
    below = F.concat(F.array(F.lit("~")), F.slice(parts, F.lit(depth + 1), F.greatest(F.size(parts) - depth, F.lit(0))))
    first = F.concat(
        F.array(F.concat(F.lit("/"), F.element_at(parts, 1))), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    )
    return (
        F.when(is_under(path, F.lit(home)), below)
        .when(F.size(parts) > 0, first)
        .otherwise(F.array().cast("array<string>"))
    )


def _cut(c: Column, at: str) -> tuple[Column, Column, Column]:
    """(found, before, after) of the first occurrence of ``at``."""
    pos = F.instr(c, at)
    return pos > 0, F.substring_index(c, at, 1), c.substr(pos + len(at), F.length(c))


def remote_segments(rel: Column) -> Column:
    has, scheme, rest = _cut(rel, "://")
    rest = F.when(has, rest).otherwise(rel)
    head = F.concat(F.when(has, scheme).otherwise("ssh"), F.lit("://"), F.substring_index(rest, "/", 1))
    _, _, path = _cut(rest, "/")
    parts = F.filter(F.split(F.when(rest.contains("/"), path).otherwise(""), "/"), lambda s: s != "")
    return F.concat(F.array(head), F.when(F.size(parts) == 0, F.array(F.lit("$"))).otherwise(parts))


def web_segments(url: Column) -> Column:
    """Host and ``/path``."""
    rest = F.regexp_replace(url, r"\Ahttps?://", "")
    has, host, path = _cut(rest, "/")
    return F.array(host, F.when(has, F.concat(F.lit("/"), path)).otherwise("/"))


def mcp_segments(rel: Column) -> Column:
    has, server, tool = _cut(rel, "/")
    return F.array(F.when(has, server).otherwise("mcp"), F.when(has, tool).otherwise(rel))


def tree_segments(scope: Column, rel: Column, home: str, session_rest: Column | None = None) -> Column:
    """The path of an event inside the forest of its scope.

    ``session_rest`` is the part below the session's own folder, NULL for a temporary file.
    """
    session = external_segments(rel, home)
    if session_rest is not None:
        session = F.when(session_rest.isNotNull(), components(session_rest)).otherwise(session)
    return (
        F.when(scope == "project", components(rel))
        .when(scope == "external", external_segments(rel, home))
        .when(scope == "remote", remote_segments(rel))
        .when(scope == "session", session)
        .when(scope == "websearch", F.array(F.lit("search"), rel))
        .when(scope == "webfetch", web_segments(rel))
        .when(scope == "mcp", mcp_segments(rel))
    )
