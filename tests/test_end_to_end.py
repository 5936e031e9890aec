"""From transcripts to an attributed change, a tree and a raster."""

from __future__ import annotations

from helpers import iso, ms, rows, us, write_jsonl
from pyspark.sql import functions as F

from tracelane.operators.roots import root_prefixes
from tracelane.operators.sessions import union_events
from tracelane.plans import model, views
from tracelane.plans.live import as_log, classify_changes
from tracelane.sources import changelog


def test_pipeline(spark, tmp_path):
    logs = tmp_path / "logs"
    tool = lambda id, name, at, **args: [
        {"type": "custom", "customType": "tool_execution_start", "timestamp": iso(at), "data": {"toolCallId": id, "toolName": name, "startedAt": iso(at), "args": args}},
        {"type": "message", "timestamp": iso(at + 10), "message": {"role": "toolResult", "toolCallId": id, "timestamp": ms(at + 10)}},
    ]
    for name, root in (("one", "/w/a"), ("two", "/w/b")):
        write_jsonl(
            logs / "p" / f"{name}.jsonl",
            [{"type": "title", "title": name}, {"type": "session", "id": name, "cwd": root, "timestamp": iso(0)}]
            + tool("w", "write", 5, path="made.txt", content="v1\n")
            + tool("b", "bash", 100, command="make"),
        )
    roots = spark.createDataFrame([(0, "/w/a"), (1, "/w/b")], "root_id int, path string")
    tables = model.build(model.read_all(spark, omp_root=str(logs)), roots, session_roots=(str(logs),))
    windows = model.windows_with_roots(tables, roots)
    assert rows(windows, "call_id", "root_id", "start_us", "end_us") == [("b", 0, us(100), us(110)), ("b", 1, us(100), us(110))]

    changes = spark.createDataFrame(
        [
            (1, "/w/a/made.txt", us(20), "modified", True, "v1\n"),  # the tool's own write
            (2, "/w/b/made.txt", us(105), "modified", True, "v2\n"),  # by the command in its own checkout
            (3, "/w/a/new.txt", us(119), "created", True, "x\n"),  # after the window and its slack
            (4, "/w/a/made.txt", us(118), "removed", False, None),  # on the last instant of the slack
        ],
        "event_id bigint, path string, at_us bigint, change string, exists boolean, content string",
    )
    events, seen = classify_changes(changes, root_prefixes(roots), tables.file_events, windows, tables.calls, tables.snapshots, us(1000))
    got = {r.event_id: r for r in events.collect()}
    two, one = f"{logs}/p/two.jsonl", f"{logs}/p/one.jsonl"
    assert {i: (r.who, r.root_id, r.source, r.tool, r.call_id) for i, r in got.items()} == {
        2: (two, 1, "window", "bash", "b"),
        3: ("you", 0, "watcher", None, None),
        4: (one, 0, "window", "bash", "b"),
    }
    assert got[2].detail.diff == "@@ -1 +1 @@\n-v1\n+v2\n" and got[3].detail.diff == "@@ -0,0 +1 @@\n+x\n"
    assert got[4].detail.diff == "@@ -1 +0,0 @@\n-v1\n" and got[2].input == "make"
    assert rows(seen, "rel", "content") == [("made.txt", ""), ("made.txt", "v1\n"), ("made.txt", "v2\n"), ("new.txt", "x\n")]

    log = str(tmp_path / "log")
    changelog.write_change_log(as_log(events), log, 0)
    replayed, copies = changelog.resolve_replay(changelog.read_change_log(spark, log), tables.participants, roots)
    assert rows(replayed, "who", "rel", "start_us") == rows(events, "who", "rel", "start_us")
    assert rows(changelog.known_calls(tables.calls, copies), "who", "input") == rows(tables.calls, "who", "input")

    numbered = replayed.withColumn("event_id", F.xxhash64("who", "rel", "start_us"))
    every = union_events(tables.file_events, numbered)
    listing = spark.createDataFrame([(0, "new.txt", False), (1, "made.txt", False)], "root_id int, rel string, is_dir boolean")
    nodes = views.tree_nodes(every, listing, merged=True, n_roots=2)
    assert {r.key: (r.n_events, r.present_in, r.deleted) for r in nodes.where("forest = 'f*'").collect()} == {
        "made.txt": (4, [1], False),
        "new.txt": (1, [0], False),
    }
    apart = views.tree_nodes(every, listing)
    assert {(r.forest, r.key): r.deleted for r in apart.collect()} == {("f0", "made.txt"): True, ("f0", "new.txt"): False, ("f1", "made.txt"): False}
    cells, lanes, width = views.gantt(every, tables.spans, tables.prompts, tables.participants, n_cols=60, merged=True)
    assert width == 10 and cells.where("node = 'f*:made.txt'").count() >= 3
    assert {r.who for r in lanes.collect()} == {"you", one, two}
