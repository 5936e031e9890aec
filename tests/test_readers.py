"""Transcripts in, canonical tables out, one small session per format."""

from __future__ import annotations

import pytest
from helpers import iso, ms, rows, us, write_jsonl
from pyspark.sql import functions as F

from tracelane.plans import model
from tracelane.sources import touches as T
from tracelane.sources import raw as R

OMP_CWD = "/proj/a"


def call(id, name, args, at):
    block = {"type": "toolCall", "id": id, "name": name, "arguments": args}
    return {"type": "message", "timestamp": iso(at), "message": {"role": "assistant", "timestamp": ms(at), "completedAt": ms(at + 1), "content": [block]}}


def result(id, details, at, error=False):
    return {"type": "message", "timestamp": iso(at), "message": {"role": "toolResult", "toolCallId": id, "timestamp": ms(at), "details": details, "isError": error}}


def started(id, tool, at, args=None):
    return {"type": "custom", "customType": "tool_execution_start", "timestamp": iso(at), "data": {"toolCallId": id, "toolName": tool, "startedAt": iso(at), "args": args}}


@pytest.fixture(scope="module")
def omp(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("omp")
    main = root / "proj" / "s1.jsonl"
    write_jsonl(
        main,
        [
            {"type": "title", "title": "first title"},
            {"type": "session", "id": "sid-1", "timestamp": iso(0), "cwd": OMP_CWD},
            "",
            "not json",
            {"type": "message", "timestamp": iso(1), "message": {"role": "user", "timestamp": ms(1), "attribution": "user", "content": "hi"}},
            {"type": "message", "timestamp": iso(1), "message": {"role": "user", "timestamp": ms(1), "attribution": "hook"}},
            call("r1", "read", {"path": "src/x.py:5-9"}, 10),
            started("r1", "read", 11),
            result("r1", {}, 12),
            call("b1", "bash", {"command": "ssh host ls"}, 20),
            started("b1", "bash", 21, {"command": "partial"}),
            result("b1", {}, 25, error=True),
            call("w1", "write", {"path": "new.txt", "content": "hello"}, 30),
            started("w1", "write", 31),
            result("w1", {"resolvedPath": OMP_CWD + "/new.txt"}, 32),
            call("x1", "write", {"path": "xd://lsp/rename?x"}, 40),
            started("x1", "write", 41),
            result("x1", {"xdev": {"tool": "resolve", "inner": {"sourceToolName": "ast_edit", "label": "L"}, "args": {"reason": "why"}}}, 42),
            call("m1", "mcp__git__log", {"n": 3}, 50),
            started("m1", "mcp__git__log", 51),
            result("m1", {"serverName": "git", "mcpToolName": "log"}, 52),
            call("q1", "web_search", {"query": "a\nb"}, 60),
            result("q1", {"response": {"sources": [{"title": "T", "url": "u"}, {"title": "no url"}]}}, 61),
            call("d1", "read", {"path": "src"}, 62),
            result("d1", {"isDirectory": True}, 63),
            call("u1", "read", {"path": "https://h/p"}, 64),
            result("u1", {"url": "https://h/final"}, 65),
            call("e1", "eval", {"code": "1+1", "title": " a/b ", "language": "py"}, 70),
            started("e1", "eval", 71),
            result("e1", {}, 72, error=True),
            call("p1", "edit", {"input": "x"}, 80),
            result("p1", {"perFileResults": [{"path": "m.py", "oldText": "o", "newText": "n", "diff": "+1|n"}]}, 81),
            call("h1", "edit", {"input": "[a.py#0a1F]\n+new\n\n-old\nMV b.py\n[gone.py#ffff]\nREM\n"}, 90),
            result("h1", {}, 91),
            # The id is used again after its result.
            call("r1", "read", {"path": "/etc/hosts"}, 100),
            result("r1", {}, 101),
            call("open", "bash", {"command": "sleep"}, 110),
            started("open", "bash", 111),
            {"type": "title_change", "title": "better title"},
            {"type": "custom", "customType": "session_exit", "timestamp": iso(200), "data": {"recordedAt": iso(200)}},
        ],
        tail='{"type":"title_change","title":"unfinished"}',
    )
    write_jsonl(root / "proj" / "s1" / "helper.jsonl", [{"type": "title"}, {"type": "session", "cwd": OMP_CWD, "id": "other"}, call("r9", "read", {"path": "src/y.py"}, 120), result("r9", {}, 121)])
    write_jsonl(root / "proj" / "s1" / "__advisor.jsonl", [{"type": "message", "timestamp": iso(130), "message": {"role": "assistant", "timestamp": ms(130), "completedAt": ms(131)}}])
    write_jsonl(root / "proj" / ".hidden.jsonl", [{"type": "title"}, {"type": "session", "cwd": OMP_CWD}])
    write_jsonl(root / "other" / "s2.jsonl", [{"type": "title"}, {"type": "session", "cwd": "/elsewhere"}])
    records = R.read_omp(spark, str(root))
    roots = spark.createDataFrame([(0, OMP_CWD)], "root_id int, path string")
    return root, records, model.build(records, roots, session_roots=(str(root),))


def test_omp_lines(omp):
    root, records, _ = omp
    main = records.where(F.col("file").endswith("/s1.jsonl"))
    assert main.agg(F.min("line_no"), F.max("line_no")).first()[0] == 0
    # The blank and the broken line are counted but not kept; the unterminated one is neither.
    assert main.count() == main.agg(F.max("line_no")).first()[0] + 1 - 2
    assert not rows(main.where(F.to_json("rec").contains("unfinished")))
    assert records.where(F.col("file").contains("hidden")).count() == 0


def test_omp_people(omp):
    root, _, t = omp
    s = f"{root}/proj/s1.jsonl"
    assert rows(t.participants, "who", "kind", "label", "session", "parent") == [
        (s, "main", "main", s, None),
        (f"{root}/proj/s1/__advisor.jsonl", "advisor", "advisor", s, s),
        (f"{root}/proj/s1/helper.jsonl", "subagent", "helper", s, s),
    ]
    # The exit is the latest thing anyone in the session did.
    assert rows(t.sessions, "id", "title", "cwd", "start_us", "end_us", "last_seen_us") == [
        ("sid-1", "better title", OMP_CWD, us(0), us(200), us(200))
    ]
    assert rows(t.prompts, "at_us") == [(us(1),)]


def test_omp_events(omp):
    root, _, t = omp
    own = t.file_events.where(F.col("who").endswith("/s1.jsonl"))
    got = rows(own, "call_id", "scope", "rel", "kind", "source", "tool", "start_us", "end_us", "detail.type")
    assert got == sorted(
        [
            ("r1", "project", "src/x.py", "read", "tool", "read", us(11), us(12), "none"),
            ("w1", "project", "new.txt", "write", "tool", "write", us(31), us(32), "written"),
            ("m1", "mcp", "git/log", "read", "tool", "mcp", us(51), us(52), "none"),
            ("q1", "websearch", "a b", "read", "tool", "web_search", us(60), us(61), "search"),
            ("u1", "webfetch", "https://h/final", "read", "tool", "read", us(64), us(65), "none"),
            ("e1", "session", f"{root}/proj/s1/eval/00:01:11 a-b.py", "write", "tool", "eval", us(71), us(72), "written"),
            ("p1", "project", "m.py", "write", "tool", "edit", us(80), us(81), "diff"),
            ("h1", "project", "a.py", "write", "tool", "edit", us(90), us(91), "diff"),
            ("h1", "project", "a.py", "write", "tool", "edit", us(90), us(91), "moved"),
            ("h1", "project", "gone.py", "write", "tool", "edit", us(90), us(91), "removed"),
            ("r1", "external", "/etc/hosts", "read", "tool", "read", us(100), us(101), "none"),
            # A device write has no file behind it, so it gives no event.
        ],
        key=lambda r: tuple((v is not None, str(v)) for v in r),
    )
    details = {(r.call_id, r.type): r for r in own.select("call_id", "detail.*").collect()}
    assert [tuple(s) for s in details["q1", "search"].sources] == [("T", "u")]
    assert details["h1", "moved"].moved_to == "b.py"
    assert details["h1", "diff"].diff == "+new\n\n-old"
    ids = [r[0] for r in t.file_events.select("event_id").orderBy("event_id").collect()]
    assert ids == list(range(1, len(ids) + 1))


def test_omp_windows_and_calls(omp):
    _, _, t = omp
    assert rows(t.tool_windows, "call_id", "start_us", "end_us") == [
        ("b1", us(21), us(25)),
        ("e1", us(71), us(72)),
        ("m1", us(51), us(52)),
        ("open", us(111), None),
        ("x1", us(41), us(42)),
    ]
    assert rows(t.calls, "call_id", "tool", "input") == [
        ("b1", "bash", "ssh host ls"),
        ("e1", "eval", "1+1"),
        ("m1", "mcp:git/log", '{"n":3}'),
        ("open", "bash", "sleep"),
        ("x1", "ast_edit", "L\nwhy"),
    ]


def test_omp_contents_and_spans(omp):
    _, _, t = omp
    assert rows(t.snapshots, "scope_key", "rel", "at_us", "content") == [
        ("p0", "m.py", us(80), "o"),
        ("p0", "m.py", us(81), "n"),
        ("p0", "new.txt", us(32), "hello"),
    ]
    advisor = t.spans.where(F.col("who").contains("advisor"))
    assert rows(advisor, "start_us", "end_us") == [(us(130), us(131))]
    main = t.spans.where(F.col("who").endswith("/s1.jsonl"))
    assert rows(main, "start_us", "end_us") == [(us(10), us(111))]


# --- second format ---------------------------------------------------------------------

CWD = "/Users/x/proj"


def said(at, content, **more):
    return {"type": "user", "timestamp": iso(at), "cwd": CWD, "message": {"role": "user", "content": content}, **more}


def use(at, *blocks):
    content = [{"type": "tool_use", "id": i, "name": n, "input": a} for i, n, a in blocks]
    return {"type": "assistant", "timestamp": iso(at), "cwd": CWD, "message": {"role": "assistant", "content": content}}


def gave(at, *ids, error=False, **more):
    content = [{"type": "tool_result", "tool_use_id": i, "is_error": error, "content": "x"} for i in ids]
    return {"type": "user", "timestamp": iso(at), "cwd": "/drifted", "message": {"role": "user", "content": content}, **more}


@pytest.fixture(scope="module")
def claude(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("claude")
    patch = [{"oldStart": 1, "oldLines": 1, "newStart": 1, "newLines": 1, "lines": ["-a", "+b"]}]
    write_jsonl(
        root / "p" / "abc.jsonl",
        [
            {"type": "ai-title", "aiTitle": "auto one"},
            said(0, "do it"),
            said(1, "<command-name>x"),
            said(1, "meta", isMeta=True),
            said(1, "bot", origin={"kind": "task"}),
            said(2, [{"type": "text", "text": "and more"}], origin={"kind": "human"}),
            use(5, ("t1", "Read", {"file_path": CWD + "/a.rs"}), ("t2", "Bash", {"command": "scp h:/x ."})),
            gave(7, "t1", "t2", toolUseResult={"filePath": "ignored"}),
            use(10, ("t3", "Edit", {"file_path": "b.rs", "old_string": "a", "new_string": "b"})),
            use(11, ("t3", "Read", {"file_path": "twice"})),
            gave(12, "t3", toolUseResult={"filePath": CWD + "/b.rs", "originalFile": "a\na\n", "structuredPatch": patch}),
            use(13, ("t4", "Write", {"file_path": "c.txt", "content": "new\n"})),
            gave(14, "t4", toolUseResult={"filePath": CWD + "/c.txt", "originalFile": "old\n"}),
            use(15, ("t5", "MultiEdit", {"file_path": "d", "edits": [{"old_string": "x", "new_string": "y", "replace_all": True}, {"old_string": "", "new_string": "no"}]})),
            gave(16, "t5", toolUseResult={"originalFile": "x x"}),
            use(17, ("t6", "mcp__srv__do", {"k": 1})),
            gave(18, "t6", error=True),
            use(19, ("t7", "WebSearch", {"query": "q"})),
            gave(20, "t7", toolUseResult={"results": [{"content": [{"title": "T", "url": "u"}, {"title": "x"}]}, "text"]}),
            use(21, ("t8", "WebFetch", {"url": "http://h/p"}), ("t9", "NotebookEdit", {"notebook_path": "n.ipynb"})),
            gave(22, "t8"),
            gave(23, "t9"),
            use(24, ("t10", "Read", {"file_path": "failed"})),
            gave(25, "t10", error=True),
            {"type": "custom-title", "customTitle": "mine"},
            {"type": "ai-title", "aiTitle": "auto two"},
        ],
    )
    write_jsonl(root / "p" / "abc" / "subagents" / "agent-1.jsonl", [use(40, ("s1", "Write", {"file_path": "sub.txt", "content": "s"})), gave(41, "s1")])
    (root / "p" / "abc" / "subagents" / "agent-1.meta.json").write_text('{"description": "", "agentType": "explorer"}')
    write_jsonl(root / "p" / "abc" / "tool-results" / "z.jsonl", [said(500, "not a transcript")])
    records = R.read_claude(spark, str(root))
    roots = spark.createDataFrame([(0, CWD)], "root_id int, path string")
    return root, model.build(records, roots, labels=R.read_labels(spark, str(root)))


def test_claude_people(claude):
    root, t = claude
    s = f"{root}/p/abc.jsonl"
    assert rows(t.participants, "who", "kind", "label", "session") == [
        (s, "main", "main", s),
        (f"{root}/p/abc/subagents/agent-1.jsonl", "subagent", "explorer", s),
    ]
    assert rows(t.sessions, "id", "title", "cwd", "start_us", "end_us", "last_seen_us") == [
        ("abc", "mine", CWD, us(0), None, us(41))
    ]
    assert rows(t.prompts, "at_us") == [(us(0),), (us(2),)]


def test_claude_events(claude):
    root, t = claude
    got = rows(t.file_events, "call_id", "scope", "rel", "kind", "tool", "start_us", "end_us", "detail.type")
    assert got == [
        ("s1", "project", "sub.txt", "write", "write", us(40), us(41), "written"),
        ("t1", "project", "a.rs", "read", "read", us(5), us(7), "none"),
        ("t3", "project", "b.rs", "write", "edit", us(10), us(12), "diff"),
        ("t4", "project", "c.txt", "write", "write", us(13), us(14), "diff"),
        ("t5", "project", "d", "write", "edit", us(15), us(16), "diff"),
        ("t7", "websearch", "q", "read", "web_search", us(19), us(20), "search"),
        ("t8", "webfetch", "http://h/p", "read", "read", us(21), us(22), "none"),
        ("t9", "project", "n.ipynb", "write", "edit", us(21), us(23), "none"),
    ]
    d = {r.call_id: r.detail for r in t.file_events.collect()}
    assert d["t3"].diff == "@@ -1,1 +1,1 @@\n-a\n+b\n"
    assert d["t4"].diff == "@@ -1 +1 @@\n-old\n+new\n"
    assert "+y y" in d["t5"].diff
    assert rows(t.snapshots, "rel", "at_us", "content") == [
        ("b.rs", us(10), "a\na\n"),
        ("b.rs", us(12), "b\na\n"),
        ("c.txt", us(13), "old\n"),
        ("c.txt", us(14), "new\n"),
        ("d", us(15), "x x"),
        ("d", us(16), "y y"),
        ("sub.txt", us(41), "s"),
    ]


def test_claude_windows(claude):
    _, t = claude
    assert rows(t.tool_windows, "call_id", "start_us", "end_us") == [("t2", us(5), us(7)), ("t6", us(17), us(18))]
    assert rows(t.calls, "call_id", "tool", "input") == [
        ("t2", "bash", "scp h:/x ."),
        ("t6", "mcp:srv/do", '{"k":1}'),
    ]
    main = t.spans.where(F.col("who").endswith("abc.jsonl"))
    assert rows(main, "start_us", "end_us") == [(us(2), us(25))]


# --- third format ----------------------------------------------------------------------


def line(at, ty, payload):
    return {"timestamp": iso(at), "type": ty, "payload": payload}


def msg(at, kind, **payload):
    return line(at, "event_msg", {"type": kind, **payload})


def item(at, kind, id, **fields):
    return msg(at, "item_completed", started_at_ms=ms(at - 1), completed_at_ms=ms(at), item={"type": kind, "id": id, **fields})


@pytest.fixture(scope="module")
def codex(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("codex") / "sessions"
    day = root / "2026" / "01" / "01"
    head = {"id": "th-1", "cwd": "/w", "history_mode": "paginated"}
    write_jsonl(
        day / "rollout-2026-01-01T00-00-00-th-1.jsonl",
        [
            line(0, "session_meta", head),
            msg(0, "task_started"),
            item(1, "UserMessage", "u", content=[{"type": "text", "text": "go"}]),
            msg(1, "user_message", message="legacy copy"),
            line(2, "response_item", {"type": "function_call", "name": "shell", "call_id": "c1", "arguments": '{"command": ["ls", "-l"]}'}),
            line(4, "response_item", {"type": "function_call_output", "call_id": "c1"}),
            item(6, "CommandExecution", "c1", status="completed", command=["/bin/bash", "-lc", "docker exec web ls"], cwd="file:///w/sub%20dir",
                 parsed_cmd=[{"type": "read", "path": "x+y.txt"}, {"type": "list"}]),
            item(8, "CommandExecution", "c2", status="failed", command=["ssh", "h"], parsed_cmd=[{"type": "read", "path": "no"}]),
            item(9, "FileChange", "f1", status="completed", changes={
                "add.txt": {"type": "add", "content": "A"},
                "del.txt": {"type": "delete", "content": "D"},
                "up.txt": {"type": "update", "unified_diff": "@@ -1 +1 @@\n-a\n+b\n", "move_path": "moved.txt"},
            }),
            item(10, "McpToolCall", "m1", status="completed", server="srv", tool="t", arguments={"a": 1}),
            item(11, "McpToolCall", "m2", status="failed", server="srv", tool="t", arguments=None),
            item(12, "WebSearch", "s1", query="", action={"type": "search", "queries": ["first", "second"]}),
            item(13, "WebSearch", "s2", query="x", action={"type": "open_page", "url": "https://h/page"}),
            line(14, "response_item", {"type": "local_shell_call", "call_id": "c3", "action": {"command": ["sleep", "9"]}}),
            msg(15, "task_complete"),
            line(16, "response_item", {"type": "function_call_output", "call_id": "c3"}),
        ],
    )
    child = {"id": "th-2", "cwd": "/w", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "th-1", "agent_nickname": "Bob"}}}}
    write_jsonl(
        day / "rollout-2026-01-01T00-00-10-th-2.jsonl",
        [
            line(20, "session_meta", child),
            msg(21, "user_message", message="ignored: no main"),
            msg(22, "patch_apply_end", call_id="p1", success=True, changes={"legacy.txt": {"type": "add", "content": "L"}}),
            msg(23, "patch_apply_end", call_id="p2", success=False, changes={"no.txt": {"type": "add", "content": "L"}}),
            msg(24, "mcp_tool_call_begin", call_id="m9", invocation={"server": "s", "tool": "t", "arguments": {"q": 2}}),
            msg(26, "mcp_tool_call_end", call_id="m9", invocation={"server": "s", "tool": "t"}, result={"Ok": {}}),
            msg(27, "mcp_tool_call_begin", call_id="m8", invocation={"server": "s", "tool": "t"}),
            msg(28, "mcp_tool_call_end", call_id="m8", invocation={"server": "s", "tool": "t"}, result={"Err": "x"}),
            msg(29, "web_search_end", call_id="w9", query="legacy query"),
            line(30, "response_item", {"type": "custom_tool_call", "name": "exec", "call_id": "k1", "input": "run"}),
            msg(31, "exec_command_end", call_id="k1", command=["rsync", "a", "h:/b"]),
        ],
    )
    grand = {"id": "th-3", "cwd": "/w", "parent_thread_id": "th-2"}
    write_jsonl(day / "rollout-2026-01-01T00-00-20-th-3.jsonl", [line(40, "session_meta", grand)])
    write_jsonl(day / "rollout-2026-01-01T00-00-30-th-4.jsonl", [line(50, "session_meta", {"id": "th-4", "cwd": "/w", "parent_thread_id": "gone"})])
    write_jsonl(day / "rollout-broken.jsonl", [msg(1, "task_started")])
    write_jsonl(day / "notes.jsonl", [line(0, "session_meta", head)])
    index = write_jsonl(root.parent / "session_index.jsonl", [{"id": "th-1", "thread_name": "old"}, {"id": "th-1", "thread_name": "Named"}, {"id": "th-1", "thread_name": ""}])
    assert R.read_codex(spark, str(root)).select("file").distinct().count() == 4
    records = model.read_all(spark, codex_root=str(root))
    roots = spark.createDataFrame([(0, "/w")], "root_id int, path string")
    return day, model.build(records, roots, title_index=R.read_title_index(spark, str(index)))


def test_codex_people(codex):
    day, t = codex
    one, two, three, four = (f"{day}/rollout-2026-01-01T00-00-{s}.jsonl" for s in ("00-th-1", "10-th-2", "20-th-3", "30-th-4"))
    assert rows(t.participants, "who", "kind", "label", "session", "parent") == [
        (one, "main", "main", one, None),
        (two, "subagent", "Bob", one, one),
        (three, "subagent", "subagent", one, two),
        (four, "main", "main", four, None),
    ]
    assert rows(t.sessions, "id", "title", "cwd", "start_us", "last_seen_us") == [
        ("th-1", "Named", "/w", us(0), us(40)),
        ("th-4", "(untitled)", "/w", us(50), us(50)),
    ]
    assert rows(t.prompts, "at_us") == [(us(1),)]


def test_codex_events(codex):
    _, t = codex
    got = rows(t.file_events, "call_id", "scope", "rel", "kind", "source", "tool", "start_us", "end_us", "detail.type")
    assert got == [
        ("c1", "project", "sub dir/x+y.txt", "read", "tool", "read", us(5), us(6), "none"),
        ("f1", "project", "add.txt", "write", "tool", "write", us(8), us(9), "written"),
        ("f1", "project", "del.txt", "write", "tool", "edit", us(8), us(9), "removed"),
        ("f1", "project", "up.txt", "write", "tool", "edit", us(8), us(9), "diff"),
        ("f1", "project", "up.txt", "write", "tool", "edit", us(8), us(9), "moved"),
        ("m1", "mcp", "srv/t", "read", "tool", "mcp", us(9), us(10), "none"),
        ("m9", "mcp", "s/t", "read", "tool", "mcp", us(24), us(26), "none"),
        ("p1", "project", "legacy.txt", "write", "tool", "write", us(22), us(22), "written"),
        ("s1", "websearch", "first", "read", "tool", "web_search", us(11), us(12), "search"),
        ("s2", "webfetch", "https://h/page", "read", "tool", "read", us(12), us(13), "none"),
        ("w9", "websearch", "legacy query", "read", "tool", "web_search", us(29), us(29), "search"),
    ]
    assert rows(t.snapshots, "rel", "at_us", "content") == [
        ("add.txt", us(9), "A"),
        ("del.txt", us(8), "D"),
        ("legacy.txt", us(22), "L"),
    ]


def test_codex_windows(codex):
    _, t = codex
    assert rows(t.tool_windows, "call_id", "start_us", "end_us") == [
        ("c1", us(2), us(4)),
        ("c3", us(14), us(15)),  # closed by the end of its turn, not by the late output
        ("k1", us(30), None),
        ("m1", us(9), us(10)),
        ("m2", us(10), us(11)),
        ("m8", us(27), us(28)),
        ("m9", us(24), us(26)),
    ]
    assert rows(t.calls, "call_id", "tool", "input") == [
        ("c1", "bash", "docker exec web ls"),
        ("c2", "bash", "ssh h"),
        ("c3", "bash", "sleep 9"),
        ("k1", "bash", "rsync a h:/b"),
        ("m1", "mcp:srv/t", '{"a":1}'),
        ("m2", "mcp:srv/t", "null"),
        ("m8", "mcp:s/t", ""),
        ("m9", "mcp:s/t", '{"q":2}'),
    ]
    assert rows(t.spans, "start_us", "end_us") == [(us(0), us(15))]


def test_lines_of_large_files(spark, tmp_path):
    """Many splits per file."""
    for name, n in (("a", 700), ("b", 3), ("c", 250)):
        write_jsonl(tmp_path / f"{name}.jsonl", [{"name": name, "n": i, "pad": "x" * (i % 37)} for i in range(n)], tail='{"n":-1}')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = R.read_lines(spark, str(tmp_path))
        assert lines.select("file", "_block").distinct().count() > 20
        got = R.records(R.number_lines(lines), "omp", F.lit("p"))
        wrong = got.where(F.try_variant_get("rec", "$.n", "bigint") != F.col("line_no"))
        assert wrong.count() == 0 and got.count() == 953
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_advisors_at_any_depth(spark, tmp_path):
    long = "x" * (3 << 20)  # a line over several reads
    for level in range(1, 10):
        write_jsonl(tmp_path / "/".join(f"d{i}" for i in range(level)) / R.ADVISOR, [{"n": 0, "pad": long if level == 9 else ""}, {"n": 1}])
    got = R.number_lines(R.read_underscored(spark, str(tmp_path)))
    assert got.select("file").distinct().count() == 9
    assert rows(got.groupBy("line_no").count()) == [(0, 9), (1, 9)]
    assert got.agg(F.max(F.length("value"))).first()[0] > len(long)


def test_launch_folder_named_late(spark):
    records = spark.range(80).select(F.lit("claude").alias("harness"), F.lit("/p").alias("project_dir"), F.lit("/p/a.jsonl").alias("file"), F.col("id").alias("line_no"))
    records = records.withColumn("rec", F.parse_json(F.when(F.col("line_no") >= 70, F.concat(F.lit('{"cwd":"/w'), F.col("line_no"), F.lit('"}'))).otherwise("{}")))
    assert rows(R.launch_cwds(records), "cwd") == [("/w70",)]


def test_commands_address_targets_from_a_table(spark):
    calls = spark.createDataFrame([("a", None, "/", 1, 2, "c1", 5), ("a", None, "/", 3, 4, "c2", 6)], "who string, session string, cwd string, start_us long, end_us long, call_id string, line_no long")
    targets = spark.createDataFrame([("a", "c1", "ssh://h", "write", 1), ("a", "c1", "ssh://g", "read", 0), ("b", "c2", "ssh://x", "read", 0)], "who string, call_id string, target string, access string, ord int")
    got = T.inferred(calls, targets)
    assert rows(got, "call_id", "rel", "kind", "ord") == [("c1", "ssh://g", "read", 0), ("c1", "ssh://h", "write", 1)]
    assert T.inferred(calls, None) is None
