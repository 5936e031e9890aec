"""Each stream gives what its batch twin gives."""

from __future__ import annotations

import json
import os

import pytest
from helpers import iso, rows, us, write_jsonl
from pyspark.sql import functions as F

from tracelane.operators.attribution import coalesce_changes
from tracelane.operators.intervals import merge_intervals
from tracelane.operators.pairing import pair_calls
from tracelane.operators.roots import root_prefixes
from tracelane.operators.sessions import session_status
from tracelane.sources.changelog import read_change_log, resolve_replay
from tracelane.streaming import flows as S

US = 1_000_000


def feed(spark, folder, batches, schema):
    """A file stream with one file per batch."""
    for i, batch in enumerate(batches):
        path = write_jsonl(folder / f"b{i}.json", [dict(r) for r in batch])
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read oldest first
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").json(str(folder))


def run(stream, tmp_path, name, mode="append"):
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


CHANGES = [
    (1, "a", 0, "created"), (2, "a", 3, "modified"), (3, "a", 8, "modified"),  # 8 - 3 is a full quiet period
    (4, "b", 1, "created"), (5, "b", 2, "removed"), (6, "c", 1, "modified"), (7, "c", 2, "removed"),
    (8, "c", 6.9, "created"), (9, "z", 500, "modified"),
]


def test_debounce_equals_batch(spark, tmp_path):
    rec = [{"event_id": i, "path": p, "at": iso(t), "change": c} for i, p, t, c in CHANGES]
    stream = feed(spark, tmp_path / "in", [rec[:5], rec[5:], [{"event_id": 99, "path": "end", "at": iso(9000), "change": "modified"}]], "event_id bigint, path string, at timestamp, change string")
    got = run(S.debounce(stream), tmp_path, "debounced").where("path NOT IN ('z', 'end')")
    batch = spark.createDataFrame([(i, p, us(t), c) for i, p, t, c in CHANGES], "event_id bigint, path string, at_us bigint, change string")
    want = coalesce_changes(batch, ("path",)).where("path <> 'z'")
    assert rows(got.select("path", "event_id", F.unix_micros("at").alias("at_us"), "change", "n_raw")) == rows(want, "path", "event_id", "at_us", "change", "n_raw")
    assert rows(want, "path", "at_us", "change") == [("a", us(3), "created"), ("a", us(8), "modified"), ("c", us(6.9), "removed")]


def test_pairing(spark, tmp_path):
    # (call id, role, line, second); the second use of x pairs again, y gets no result.
    recs = [("x", "call", 1, 0), ("y", "call", 2, 1), ("x", "result", 3, 5), ("x", "result", 4, 6), ("x", "call", 5, 7), ("x", "call", 6, 8), ("x", "result", 7, 500)]
    schema = "who string, call_id string, role string, line_no bigint, at_us bigint"
    as_dict = [{"who": "w", "call_id": c, "role": r, "line_no": n, "at_us": us(t)} for c, r, n, t in recs]
    stream = feed(spark, tmp_path / "in", [as_dict[:2], as_dict[2:5], as_dict[5:]], schema)
    got = run(S.pair_any(stream), tmp_path, "paired")
    batch = spark.createDataFrame([("w", c, r, n, us(t)) for c, r, n, t in recs], schema)
    want = pair_calls(batch).where("end_us IS NOT NULL")
    assert rows(got, "call_id", "start_us", "end_us") == rows(want, "call_id", "start_us", "end_us") == [("x", us(0), us(5)), ("x", us(7), us(500))]


def test_pairing_in_batches(spark, tmp_path):
    recs = [("x", "call", 1, 0), ("y", "call", 2, 1), ("x", "result", 3, 5), ("x", "result", 4, 6), ("x", "call", 5, 7), ("x", "call", 6, 8), ("x", "result", 7, 500)]
    schema = "who string, call_id string, role string, line_no bigint, at_us bigint"
    as_dict = [{"who": "w", "call_id": c, "role": r, "line_no": n, "at_us": us(t)} for c, r, n, t in recs]
    stream = feed(spark, tmp_path / "in", [as_dict[:2], as_dict[2:5], as_dict[5:]], schema)
    table = str(tmp_path / "calls")
    q = S.pair_batches(stream, table, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.read.parquet(f"{table}/pairs"), "call_id", "start_us", "end_us") == [("x", us(0), us(5)), ("x", us(7), us(500))]
    assert rows(spark.read.parquet(f"{table}/open/batch=2"), "call_id", "line_no") == [("y", 2)]


def test_pairing_with_bound(spark, tmp_path):
    schema = "who string, call_id string, at timestamp"
    row = lambda c, t: {"who": "w", "call_id": c, "at": iso(t)}
    starts = feed(spark, tmp_path / "s", [[row("a", 0), row("b", 1)], [row("c", 2), row("end", 5000)]], schema)
    results = feed(spark, tmp_path / "r", [[row("a", 4)], [row("c", 900), row("end", 5001)], [row("late", 9000)]], schema)
    got = run(S.pair_within(starts, results, "60 SECONDS"), tmp_path, "bounded").where("call_id <> 'end'")
    end = (F.unix_micros("end") / US).cast("bigint") - us(0) // US
    assert rows(got.select("call_id", end)) == [("a", 4), ("b", None), ("c", None)]


def test_spans_equal_batch(spark, tmp_path):
    parts = [("w", 0, 10), ("w", 40, 41), ("w", 71, 71), ("w", 102, 110), ("v", 5, 100), ("v", 20, 30)]
    rec = [{"who": w, "start": iso(a), "end": iso(b)} for w, a, b in parts]
    stream = feed(spark, tmp_path / "in", [rec[:3], rec[3:], [{"who": "end", "start": iso(9000), "end": iso(9000)}]], "who string, start timestamp, end timestamp")
    # Intervals arrive in any order within the allowed lateness.
    got = run(S.span_stream(stream, late="10 minutes"), tmp_path, "spans").where("who <> 'end'")
    batch = spark.createDataFrame([(w, us(a), us(b)) for w, a, b in parts], "who string, start_us bigint, end_us bigint")
    want = merge_intervals(batch, ("who",), gap=30 * US)
    got = rows(got.select("who", F.unix_micros("start"), F.unix_micros("end")))
    assert got == rows(want, "who", "start_us", "end_us")
    assert got == [("v", us(5), us(100)), ("w", us(0), us(71)), ("w", us(102), us(110))]


def test_live_status(spark, tmp_path):
    rec = lambda s, t, x=False: {"session": s, "at_us": us(t), "is_exit": x, "recorded_us": us(t) if x else None}
    stream = feed(spark, tmp_path / "in", [[rec("a", 0), rec("a", 10, True), rec("b", 5)], [rec("a", 20), rec("c", 3, True)]], "session string, at_us bigint, is_exit boolean, recorded_us bigint")
    table = run(S.last_activity(stream), tmp_path, "activity", "complete")
    status = {r.session: (r.status, r.shown_end_us) for r in session_status(table, us(139)).collect()}
    assert status == {"a": ("live", None), "b": ("ended", us(5)), "c": ("ended", us(3))}


def test_segments_and_reset(spark, tmp_path):
    src, table = tmp_path / "seg", tmp_path / "lines"
    write_jsonl(src / "s1.0.0.jsonl", ['{"n":0}', '{"n":1}'])
    ingest = lambda: S.ingest(S.tail(spark, str(src)), str(table), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    ingest()
    write_jsonl(src / "s1.0.2.jsonl", ['{"n":2}'], tail='{"n":"unfinished')
    write_jsonl(src / "s2.0.0.jsonl", ['{"m":0}'])
    ingest()
    write_jsonl(src / "s1.1.0.jsonl", ['{"n":"again"}'])
    ingest()
    lines = spark.read.parquet(str(table))
    s1 = f"{src}/s1.jsonl"
    assert rows(lines.where(F.col("file") == s1), "generation", "line_no", "value") == [
        (0, 0, '{"n":0}'), (0, 1, '{"n":1}'), (0, 2, '{"n":2}'), (1, 0, '{"n":"again"}')
    ]
    assert rows(S.current(lines), "value") == [('{"m":0}',), ('{"n":"again"}',)]
    events = spark.createDataFrame([(s1, "tool", "old"), (s1, "window", "seen"), ("other", "tool", "keep")], "who string, source string, rel string")
    fresh = spark.createDataFrame([(s1, "tool", "new")], "who string, source string, rel string")
    known = lines.where("generation = 0").select(F.col("file").alias("who"), "generation")
    after = S.reset_batch(events, known, lines.where("generation = 1"), fresh)
    assert rows(after, "rel") == [("keep",), ("new",), ("seen",)]
    assert rows(S.reset_batch(events, known, lines.where("generation = 0"), fresh), "rel") == [("keep",), ("new",), ("old",), ("seen",)]


@pytest.fixture
def tables(spark):
    roots = spark.createDataFrame([(0, "/r")], "root_id int, path string")
    return {
        "prefixes": root_prefixes(roots),
        "file_events": spark.createDataFrame([(0, "echo.txt", us(95), "tool", "write", "project")], "root_id bigint, rel string, end_us bigint, source string, kind string, scope string"),
        "windows": spark.createDataFrame([("s1", "c1", 0, us(90), us(98), 1), ("s2", "c2", None, us(99), None, 2)], "who string, call_id string, root_id bigint, start_us bigint, end_us bigint, ord bigint"),
        "calls": spark.createDataFrame([("s1", "c1", "eval", "code")], "who string, call_id string, tool string, input string"),
        "snapshots": spark.createDataFrame([("p0", "a.txt", us(10), 1, "old\n")], "scope_key string, rel string, at_us bigint, seq bigint, content string"),
    }


def test_attribution_stream_and_replay(spark, tmp_path, tables):
    rec = [
        (1, "/r/a.txt", 96, "modified", True, "new\n"),
        (2, "/r/echo.txt", 100, "modified", True, "x"),
        (3, "/r/gone.txt", 100, "created", False, None),
        (4, "/r/b.txt", 106, "removed", False, None),
        (5, "/elsewhere", 106, "removed", False, None),
        (6, "/r/you.txt", 50, "created", True, "hi\n"),
    ]
    keys = ("event_id", "path", "at_us", "change", "exists", "content")
    as_dict = [dict(zip(keys, (i, p, us(t), c, e, x))) for i, p, t, c, e, x in rec]
    stream = feed(spark, tmp_path / "in", [as_dict[:3], as_dict[3:]], "event_id bigint, path string, at_us bigint, change string, exists boolean, content string")
    log = str(tmp_path / "log")
    q = S.attribute_stream(stream, lambda: tables, log, str(tmp_path / "ck"), lambda: us(200)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    lines = [json.loads(r.value) for r in spark.read.text(log).collect()]
    by = {r["path"]: r for r in lines}
    assert set(by) == {"a.txt", "b.txt", "you.txt"}
    assert by["a.txt"]["who"] == {"file": "s1", "toolCallId": "c1", "tool": "eval", "input": "code"}
    assert by["a.txt"]["diff"] == "@@ -1 +1 @@\n-old\n+new\n"
    # The later window has no root of its own, so it may own a change in any.
    assert by["b.txt"]["who"] == {"file": "s2", "toolCallId": "c2", "tool": "bash"} and "diff" not in by["b.txt"]
    assert by["you.txt"]["who"] == "you" and by["you.txt"]["diff"] == "@@ -0,0 +1 @@\n+hi\n"

    people = spark.createDataFrame([("s1",)], "who string")
    roots = spark.createDataFrame([(0, "/r")], "root_id int, path string")
    events, calls = resolve_replay(read_change_log(spark, log), people, roots)
    assert rows(events, "who", "rel", "source", "tool", "start_us", "detail.fs_change") == [
        ("s1", "a.txt", "window", "eval", us(96), "modified"),
        ("you", "you.txt", "watcher", None, us(50), "created"),
    ]
    assert rows(calls) == [("s1", "c1", "eval", "code")]


def test_late_rows_go_to_the_batch_path(spark):
    raw = spark.createDataFrame([(1,), (2,), (3,)], "event_id bigint")
    assert rows(S.missed(raw, raw.where("event_id < 3"))) == [(3,)]
