"""Trees and rasters over a handful of events."""

from __future__ import annotations

import pytest
from helpers import rows, us
from pyspark.sql import functions as F

from tracelane.functions.actions import ActionFilter
from tracelane.operators import sessions as Q
from tracelane.plans import views as V

EVENTS = [
    # event, who, scope, root, owner, rel, kind, source, tool, start, end
    (1, "m1", "project", 0, None, "src/a.py", "write", "tool", "write", 0, 10),
    (2, "s1", "project", 1, None, "src/a.py", "read", "tool", "read", 5, 20),
    (3, "m2", "project", 0, None, "old/gone.py", "write", "window", "bash", 30, 30),
    (4, "m1", "external", None, None, "/etc/ssh/conf/a", "read", "tool", "read", 40, 41),
    (5, "m1", "external", None, None, "/etc/ssh", "read", "tool", "read", 42, 43),
    (6, "m1", "remote", None, None, "ssh://h", "read", "inferred", None, 50, 50),
    (7, "m1", "webfetch", None, None, "https://h/p/q", "read", "tool", "read", 60, 60),
    (8, "m1", "mcp", None, None, "srv/do", "read", "tool", "mcp", 70, 70),
    (9, "m1", "session", None, "/s/p/one.jsonl", "/s/p/one/eval/x.py", "write", "tool", "eval", 80, 80),
    (10, "you", "project", 0, None, "src/b.py", "write", "watcher", None, 90, 90),
]


@pytest.fixture(scope="module")
def events(spark):
    data = [(*e[:9], us(e[9]), us(e[10])) for e in EVENTS]
    return spark.createDataFrame(data, "event_id bigint, who string, scope string, root_id bigint, scope_session string, rel string, kind string, source string, tool string, start_us bigint, end_us bigint")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("m1", "main", "A", "m1", 1), ("s1", "subagent", "A", "m1", 2), ("m2", "main", "B", "m2", 3)], "who string, kind string, session string, main string, ord int")


def test_separate_forests(spark, events):
    listing = spark.createDataFrame([(0, "src/a.py", False), (0, "src/b.py", False), (0, "docs", True), (1, "src/a.py", False)], "root_id int, rel string, is_dir boolean")
    nodes = V.tree_nodes(events, listing, session_roots=("/s",))
    got = {(r.forest, r.key): (r.name, r.parent_key, r.is_dir, r.n_events, r.deleted) for r in nodes.collect()}
    assert got == {
        ("f0", "src"): ("src", None, True, 2, False), ("f0", "src/a.py"): ("a.py", "src", False, 1, False), ("f0", "src/b.py"): ("b.py", "src", False, 1, False),
        ("f0", "docs"): ("docs", None, True, 0, False), ("f0", "old"): ("old", None, True, 1, False), ("f0", "old/gone.py"): ("gone.py", "old", False, 1, True),
        ("f1", "src"): ("src", None, True, 1, False), ("f1", "src/a.py"): ("a.py", "src", False, 1, False),
        # The read of the absorbed directory itself belongs to no node.
        ("m", "/etc/ssh/conf"): ("/etc/ssh/conf", None, True, 1, False), ("m", "/etc/ssh/conf/a"): ("a", "/etc/ssh/conf", False, 1, False),
        ("m", "ssh://h"): ("ssh://h", None, True, 1, False), ("m", "ssh://h/$"): ("$", "ssh://h", False, 1, False),
        ("w", "h"): ("h", None, True, 1, False), ("w", "h//p/q"): ("/p/q", "h", False, 1, False),
        ("mcp", "srv"): ("srv", None, True, 1, False), ("mcp", "srv/do"): ("do", "srv", False, 1, False),
        ("s/s/p/one.jsonl", "eval"): ("eval", None, True, 1, False), ("s/s/p/one.jsonl", "eval/x.py"): ("x.py", "eval", False, 1, False),
    }


def test_merged_forest(spark, events):
    listing = spark.createDataFrame([(0, "src/a.py", False), (1, "src/a.py", False), (1, "old/gone.py", False)], "root_id int, rel string, is_dir boolean")
    nodes = V.tree_nodes(events.where("scope = 'project'"), listing, merged=True, n_roots=2)
    got = {r.key: (r.n_events, r.present_in, r.partial, r.deleted) for r in nodes.collect()}
    assert got == {
        "src": (3, [0, 1], False, False), "src/a.py": (2, [0, 1], False, False), "src/b.py": (1, None, False, True),
        "old": (1, [1], True, False), "old/gone.py": (1, [1], True, False),
    }


def test_filters(spark, events, people):
    only_b = spark.createDataFrame([("B",)], "session string")
    shown = Q.visible_events(events, people, only_b)
    assert rows(shown, "event_id") == sorted([(3,), (10,)], key=str)
    none = only_b.where("false")
    assert rows(Q.visible_events(events, people, none), "event_id") == [(10,)]
    writes = ActionFilter(frozenset({"write", "eval"}))
    seen = Q.visible_events(events, people, None, writes)
    assert rows(seen, "event_id") == [(1,), (9,)]
    who, sessions = Q.active_participants(seen, people)
    assert rows(who, "who") == [("m1",)] and rows(sessions) == [("A",)]
    facets = {r.action: r.n for r in Q.action_facets(events, ActionFilter(frozenset({"edit"}), frozenset({"lsp"}))).collect()}
    assert facets == {"write": 1, "read": 3, "fs during bash": 1, "inferred": 1, "fetch": 1, "mcp": 1, "eval": 1, "fs": 1, "edit": 0, "fs during lsp": 0}


def test_gantt(spark, events, people):
    spans = spark.createDataFrame([("m1", us(0), us(80)), ("s1", us(5), us(20))], "who string, start_us bigint, end_us bigint")
    prompts = spark.createDataFrame([("A", us(1))], "session string, at_us bigint")
    nodes, lanes, width = V.gantt(events, spans, prompts, people, n_cols=14)
    assert width == 10
    b = us(0) // (10 * 1_000_000)
    cells = {(r.node, r.bucket - b): (r.who, r.is_write) for r in nodes.where("node LIKE 'f%'").collect()}
    assert cells["f0:src", 0] == ("m1", 1) and cells["f1:src/a.py", 2] == ("s1", 0) and cells["f0:src", 9] == ("you", 1)
    marks = {(r.who, r.bucket - b): r.mark for r in lanes.collect()}
    assert marks["you", 0] == 3 and marks["you", 9] == 2 and marks["m1", 8] == 2 and marks["s1", 2] == 2 and ("s1", 3) not in marks
    _, lanes, _ = V.gantt(events.where("event_id <= 2"), spans, prompts, people, n_cols=14, filtered=True)
    marks = {(r.who, r.bucket - b): r.mark for r in lanes.collect()}
    assert marks == {("m1", 0): 2, ("m1", 1): 2, ("s1", 0): 2, ("s1", 1): 2, ("s1", 2): 2, ("m1", 2): 1}


def test_lists(spark, people):
    spans = spark.createDataFrame([("m1", us(0), us(10)), ("m1", us(20), us(30)), ("s1", us(0), us(99))], "who string, start_us bigint, end_us bigint")
    prompts = spark.createDataFrame([("A", us(15)), ("B", us(1))], "session string, at_us bigint")
    got = [(r.item, r.end_us) for r in Q.row_items(spans, prompts, "m1", "A").collect()]
    assert got == [("span", us(30)), ("prompt", us(15)), ("span", us(10))]
    assert rows(Q.subagent_ordinals(people), "who", "ordinal") == [("s1", 0)]
    order = spark.createDataFrame([("fs",), ("fs during a",), ("eval",), ("mcp",)], "a string").orderBy(Q.facet_order(F.col("a")), "a")
    assert [r.a for r in order.collect()] == ["eval", "mcp", "fs", "fs during a"]


def test_time_range(spark, events):
    one = events.where("event_id = 1")
    late = Q.time_range(one, now_us=us(70)).first()
    assert (late.lo_us, late.hi_us) == (us(0), us(70))
    assert Q.time_range(one, now_us=us(70) + 1).first().hi_us == us(10)
