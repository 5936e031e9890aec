"""Paths, actions, texts and diffs on single rows."""

from __future__ import annotations

import difflib
import random

from helpers import rows, us
from pyspark.sql import functions as F

from tracelane.functions import actions as A
from tracelane.functions import calls as K
from tracelane.functions import paths as P
from tracelane.functions import text as X
from tracelane.operators import content as C
from tracelane.operators import roots as R
from tracelane.operators import tree as TR


def one(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def apply(spark, fn, cases):
    df = one(spark, *cases)
    got = {r.v: r.x for r in df.select("v", fn(F.col("v")).alias("x")).collect()}
    assert got == cases


def test_selectors(spark):
    apply(
        spark,
        P.strip_selector,
        {
            "a.js:33-343": "a.js",
            "a.md:2-40,77-81:raw": "a.md",
            "a:1:2:3": "a:1",
            "a:raw:img:conflicts": "a:raw",
            "a:x1": "a:x1",
            "a:+1": "a:+1",
            "a:": "a:",
            "a:-": "a",
        },
    )


def test_absolute_paths(spark):
    apply(
        spark,
        lambda c: P.absolutize(c, F.lit("/w/dir"), "/home/me"),
        {
            "../x/./y.mjs": "/w/x/y.mjs",
            "~/a.txt": "/home/me/a.txt",
            "~": "/home/me",
            "demo.gif?q=what is this:1": "/w/dir/demo.gif",
            "/../a": "/../a",
            "/a/../../b": "/../b",
            "http://h/x": None,
            "": "/w/dir",
            "/a//b/": "/a/b",
        },
    )


def test_extensions_and_scripts(spark):
    apply(
        spark,
        A.is_script,
        {"a.py": True, "A.PY": True, "d.py/x": False, ".py": False, "x/.bashrc": False, "a.tar.ps1": True, "a.rs": False, "py": False, "d/..py": True},
    )


def test_tree_segments(spark):
    def segs(scope):
        return lambda c: F.array_join(P.tree_segments(F.lit(scope), c, "/home/me"), "|")

    apply(spark, segs("external"), {"/home/me/a/b": "~|a|b", "/home/mean/a": "/home|mean|a", "/etc/hosts": "/etc|hosts", "/": ""})
    apply(spark, segs("remote"), {"ssh://h": "ssh://h|$", "ssh://h/a//b/": "ssh://h|a|b", "h/x": "ssh://h|x", "docker://web": "docker://web|$"})
    apply(spark, segs("webfetch"), {"https://h/a/b?c": "h|/a/b?c", "http://h": "h|/", "h/x": "h|/x"})
    apply(spark, segs("mcp"), {"srv/a/b": "srv|a/b", "tool": "mcp|tool"})
    apply(spark, segs("project"), {"a/b.rs": "a|b.rs"})


def test_file_urls(spark):
    apply(
        spark,
        P.file_url_path,
        {"file:///a%20b+c": "/a b+c", "file:///x%zz%4": "/x%zz%4", "/plain": "/plain", "rel": None, "file:///%ff": None, "file:///%E2%82%AC": "/€"},
    )


def test_utf8_cap(spark):
    texts = {"ab" * 5: "ab" * 5, "é" * 6: "é" * 5 + X.TRUNCATED, "a" + "é" * 5: "a" + "é" * 4 + X.TRUNCATED, "a" * 10 + "€": "a" * 10 + X.TRUNCATED, "a" * 8 + "😀": "a" * 8 + X.TRUNCATED}
    apply(spark, lambda c: X.utf8_cap(c, 10), texts)
    assert one(spark, None).select(X.utf8_cap(F.col("v"))).first()[0] is None


def test_smartcase(spark):
    df = one(spark, "Alpha", "alpha", "BETA")
    hits = lambda q: [r.v for r in df.where(X.smartcase(F.col("v"), q)).collect()]
    assert hits("alp") == ["Alpha", "alpha"] and hits("Alp") == ["Alpha"] and hits("") == [] and hits("beta") == ["BETA"]


def test_edits(spark):
    edits = F.array(*[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new"), F.lit(a).alias("all")) for o, n, a in [("", "new", False), ("x", "y.", False), ("z", "", True)]])
    apply(spark, lambda c: X.apply_edits(c, edits), {"": "new", "xx z": "y.x ", "zaz": "a", "none": "none"})


def test_action_classes(spark):
    cases = [
        ("tool", "eval", "session", "write", "eval"), ("tool", "read", "webfetch", "read", "fetch"), ("tool", "read", "project", "read", "read"),
        ("tool", "write", "project", "write", "write"), ("tool", "edit", "project", "write", "edit"), ("tool", "web_search", "websearch", "read", "search"),
        ("tool", "mcp", "mcp", "read", "mcp"), ("tool", "odd", "project", "read", "read"), ("tool", "odd", "project", "write", "write"),
        ("window", "bash", "project", "write", "fs during bash"), ("inferred", None, "remote", "read", "inferred"), ("watcher", None, "project", "write", "fs"),
    ]
    df = spark.createDataFrame(cases, "source string, tool string, scope string, kind string, want string")
    assert df.where(A.action_key() != F.col("want")).count() == 0
    flt = A.ActionFilter(frozenset({"eval", "write"}), frozenset({"bash"}), True)
    files = spark.createDataFrame(
        [("write", "a.py", "tool"), ("write", "a.rs", "tool"), ("eval", "cell.txt", "tool"), ("edit", "a.py", "tool"), ("bash", "a.sh", "window"), ("bash", "a.txt", "window"), ("lsp", "a.py", "window")],
        "tool string, rel string, source string",
    ).select("*", F.lit("project").alias("scope"), F.lit("write").alias("kind"))
    assert rows(files.where(flt.matches()), "tool", "rel") == [("bash", "a.sh"), ("eval", "cell.txt"), ("write", "a.py")]
    assert files.where(A.ActionFilter().matches()).count() == 0


def test_times(spark):
    df = one(spark, "2026-01-01T00:00:01Z", "2026-01-01T02:00:01.5+02:00", "2026-01-01", "2026-01-01T00:00:01", "x", None)
    got = [r[0] for r in df.orderBy("i").select(K.parse_ts(F.col("v"))).collect()]
    assert got == [us(1), us(1.5), None, None, None, None]


def test_roots(spark):
    roots = spark.createDataFrame([(0, "/p/repo"), (1, "/p/repo/inner"), (2, "/q/repo"), (3, "/q/other")], "root_id int, path string")
    aliases = spark.createDataFrame([(0, "/private/p/repo")], "root_id int, prefix string")
    files = one(spark, "/p/repo/a", "/p/repo/inner/b", "/p/repository/c", "/private/p/repo/d/e", "/p/repo", None)
    got = R.project_rel(files, R.root_prefixes(roots, aliases), "v")
    assert {r.v: (r.root_id, r.rel) for r in got.collect()} == {
        "/p/repo/a": (0, "a"), "/p/repo/inner/b": (1, "b"), "/p/repository/c": (None, None), "/private/p/repo/d/e": (0, "d/e"), "/p/repo": (0, ""), None: (None, None),
    }
    assert rows(R.label_roots(roots), "root_id", "label") == [(0, "/p/repo"), (1, "inner"), (2, "/q/repo"), (3, "other")]
    assert rows(R.nested_roots(roots)) == [(0, 1)]


def test_remap(spark):
    make = lambda *ps: spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "root_id bigint, path string")
    old = make("/a", "/b")
    assert rows(R.remap_roots(old, make("/b", "/c", "/a"))) == [(0, 2), (1, 0)]
    assert R.remap_roots(old, make("/a")) is None  # a root went away
    assert R.remap_roots(old, make("/a", "/b", "/a/x")) is None  # a new one nests with an old one
    assert R.remap_roots(make("/a", "/b/x"), make("/a", "/b/x", "/b")) is None


def trie(paths):
    """Compaction and order by plain recursion."""
    root = {}
    for p in paths:
        at = root
        for s in p.split("/"):
            at = at.setdefault(s, {})
    out = []

    def walk(node, prefix, up):
        for name in sorted(node, key=lambda n: (not node[n], n.lower(), n)):
            key, label, child = f"{prefix}{name}", name, node[name]
            while child and len(child) == 1 and next(iter(child.values())):
                step = next(iter(child))
                key, label, child = f"{key}/{step}", f"{label}/{step}", child[step]
            out.append((key, label, up, bool(child)))
            walk(child, key + "/", key)

    walk(root, "", None)
    return out


def test_compaction_and_order(spark):
    rng = random.Random(6)
    paths = sorted({"/".join(rng.choice("abcD") for _ in range(rng.randrange(1, 6))) + f"/f{rng.randrange(9)}" for _ in range(60)})
    leaves = spark.createDataFrame([("x", p) for p in paths], "forest string, rel string")
    nodes = TR.nodes_of(leaves, F.split("rel", "/"))
    want = trie(paths)
    got = TR.compact(nodes)
    assert rows(got, "key", "name", "parent_key", "is_dir") == sorted(want, key=lambda t: tuple((v is not None, str(v)) for v in t))
    pos = {r.key: r.pos for r in TR.tree_order(nodes, block_rows=9).collect()}
    ordered = [k for k, *_ in want]
    assert sorted(ordered, key=pos.get) == ordered and sorted(pos.values()) == list(range(1, len(pos) + 1))


def test_presence_and_deleted(spark):
    listing = spark.createDataFrame([(0, "a/x", False), (1, "a/x", False), (1, "b", False)], "root_id int, rel string, is_dir boolean")
    got = {r.key: (list(r.present_in), r.partial) for r in TR.presence(TR.merge_listings(listing), 2).collect()}
    assert got == {"a": ([0, 1], False), "a/x": ([0, 1], False), "b": ([1], True)}
    paths = spark.createDataFrame([(0, "a/x"), (0, "b"), (2, "a/x"), (0, "zz")], "root_id int, rel string")
    walked = listing.select("root_id").distinct()
    assert rows(TR.deleted(paths, listing, walked)) == [(0, "a/x", False), (0, "b", True), (0, "zz", True), (2, "a/x", False)]
    assert rows(TR.deleted_merged(paths, listing)) == [("a/x", False), ("b", False), ("zz", True)]


# --- contents --------------------------------------------------------------------------


def patched(old, diff):
    """Apply a unified diff by its line facts alone."""
    out, at = [], 0
    for hunk in diff.split("@@ -")[1:]:
        head, *body = hunk.split("\n")[:-1]
        start = int(head.split(",")[0].split(" ")[0])
        start -= 0 if head.split(" ")[0].endswith(",0") else 1
        out += old[at:start]
        at = start
        for line in body:
            if line[:1] in (" ", "-"):
                assert old[at] == line[1:]
                at += 1
            if line[:1] in (" ", "+"):
                out.append(line[1:])
    return out + old[at:]


def test_version_diffs_apply(spark):
    rng = random.Random(7)
    versions = []
    text = [f"line {i}" for i in range(60)]
    for v in range(12):
        versions.append(("p", v, "\n".join(text) + "\n"))
        text = [t for t in text if rng.random() > 0.1]
        for _ in range(4):
            text.insert(rng.randrange(len(text) + 1), f"new {rng.random():.3f}")
    df = spark.createDataFrame(versions, "path string, at bigint, content string")
    out = {r.at: (r.prev_content, r.content, r.diff) for r in C.version_diff(C.version_pairs(df, block_rows=3)).collect()}
    assert out[0][2] is None
    for at in range(1, 12):
        old, new, diff = out[at]
        assert patched(old.split("\n")[:-1], diff) == new.split("\n")[:-1]
    churn = {r.at: (r.added, r.removed) for r in C.line_churn(df, block_rows=3).collect()}
    for at in range(1, 12):
        ops = list(difflib.ndiff(out[at][0].split("\n"), out[at][1].split("\n")))
        assert churn[at][0] - churn[at][1] == sum(o.startswith("+ ") for o in ops) - sum(o.startswith("- ") for o in ops)


def test_created_files_compare_with_nothing(spark):
    df = spark.createDataFrame([("a", None, "x\n", True), ("b", None, "x\n", False), ("c", "x\n", "x\n", True), ("d", "a", "b", False)], "k string, prev_content string, content string, made boolean")
    got = {r.k: r.diff for r in C.version_diff(df, created=F.col("made")).collect()}
    assert got == {"a": "@@ -0,0 +1 @@\n+x\n", "b": None, "c": None, "d": "@@ -1 +1 @@\n-a\n\\ No newline at end of file\n+b\n\\ No newline at end of file\n"}


def test_asof_is_strict_and_takes_the_last_recorded(spark):
    history = spark.createDataFrame([("f", 10, 1, "a"), ("f", 20, 2, "b"), ("f", 20, 3, "c"), ("f", 30, 4, "d")], "rel string, at bigint, seq bigint, content string")
    probes = spark.createDataFrame([("f", t) for t in (10, 11, 20, 21, 99)] + [("g", 50)], "rel string, t bigint")
    for size in (None, 2):
        got = rows(C.asof_prev(probes, history, ("rel",), "t", "at", "seq", block_rows=size), "rel", "t", "prev_content")
        assert got == [("f", 10, None), ("f", 11, "a"), ("f", 20, "a"), ("f", 21, "c"), ("f", 99, "d"), ("g", 50, None)]


def facts(df):
    return [(r.hunk, r.op, r.old_line, r.new_line, r.text) for r in df.orderBy("event_id", "pos").collect()]


def test_unified_facts(spark):
    text = "--- a\n+++ b\n@@ -3,3 +3,3 @@ fn\n x\n-y\n+z\n\n\\ No newline at end of file\n@@ -20 +21,2 @@\n+n\n same\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "event_id bigint, diff string")
    got = C.unified_lines(df)
    assert facts(got) == [(1, " ", 3, 3, "x"), (1, "-", 4, 4, "y"), (1, "+", 5, 4, "z"), (1, " ", 5, 5, ""), (2, "+", 20, 21, "n"), (2, " ", 20, 22, "same")]
    assert rows(C.first_changed_line(got)) == [(1, 4)]


def test_numbered_facts(spark):
    # A blank line and a jump in the numbers start hunks; context alone is left out.
    text = " 1|a\n+2|new\n-2|old\n 3|c\n\n 9|only context\n 15|alone\n 21|p\n+22|q\n+23|r"
    bad = "+1|fine\nno mark"
    low = "-0|zero"
    df = spark.createDataFrame([(1, text), (2, bad), (3, low)], "event_id bigint, diff string")
    got = C.numbered_lines(df)
    assert facts(got) == [
        (1, " ", 1, 1, "a"), (1, "+", 2, 2, "new"), (1, "-", 2, 3, "old"), (1, " ", 3, 3, "c"),
        (4, " ", 21, 21, "p"), (4, "+", 22, 22, "q"), (4, "+", 22, 23, "r"),
    ]
    assert rows(C.first_changed_line(got, numbered=True)) == [(1, 2)]


def test_patch_text(spark):
    df = spark.sql("SELECT array(named_struct('oldStart', 1, 'oldLines', 2, 'newStart', 1, 'newLines', 1, 'lines', array(' a', '-b'))) AS h")
    assert df.select(C.patch_text(F.col("h"))).first()[0] == "@@ -1,2 +1,1 @@\n a\n-b\n"
