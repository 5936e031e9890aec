"""Saved tables and the change log."""

from __future__ import annotations

from dataclasses import replace

from helpers import rows, us
from pyspark.sql import functions as F

from tracelane.plans.model import Tables
from tracelane.sources import changelog as L
from tracelane.sources.store import Meta, load_between, load_model, save_model


def test_save_and_load(spark, tmp_path):
    empty = spark.createDataFrame([("a",)], "who string")
    events = spark.createDataFrame([(1, "tool"), (2, "inferred"), (3, "watcher"), (4, "window")], "event_id bigint, source string")
    tables = Tables(*[events if n == "file_events" else empty for n in Tables.__dataclass_fields__])
    meta, path = Meta(("/logs",), ("/p",), 30), str(tmp_path / "saved")
    assert load_model(spark, path, meta) is None
    save_model(tables, path, meta)
    back = load_model(spark, path, meta)
    assert rows(back.file_events, "event_id") == [(1,), (2,)]
    assert rows(back.participants) == [("a",)]
    for other in (replace(meta, idle_gap=60), replace(meta, roots=("/q",)), replace(meta, harness_roots=()), replace(meta, format=99)):
        assert load_model(spark, path, other) is None
    save_model(tables, path, replace(meta, idle_gap=60))
    assert load_model(spark, path, meta) is None


def test_change_log(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "root_id int, rel string, at_us bigint, change string, who string, call_id string, tool string, input string, diff string"
    changes = spark.createDataFrame(
        [
            (0, "a.py", us(1.25), "modified", "s1", "c1", "eval", "x" * 5000, "@@"),
            (0, "b.py", us(2), "created", "you", None, None, None, None),
            (1, "inner/c.py", us(3), "removed", "s1", None, None, None, None),
            (1, "d.py", us(4), "removed", "gone", "c2", "bash", "i", None),
        ],
        schema,
    )
    L.write_change_log(changes, path, 0)
    L.write_change_log(changes.where("root_id = 0"), path, 1)
    assert not L.write_change_log(changes, path, 1)  # a repeated batch changes nothing
    bad = [
        'not json', '{"t":"2026-01-01T00:00:00Z","path":"p","change":"renamed","who":"you"}',
        '{"t":"yesterday","path":"p","change":"created","who":"you"}', '{"t":"2026-01-01T00:00:00Z","path":"p","change":"created","who":3}',
        '{"t":"2026-01-01T00:00:09Z","path":"q","change":"created","who":{"file":"s1"}}',
    ]
    assert L.change_log(spark, path).append(spark.createDataFrame([(x, 0) for x in bad], "value string, root_id int"), 2)
    (tmp_path / "log" / "commit=9.left" / "root_id=0").mkdir(parents=True)  # a failed attempt
    (tmp_path / "log" / "commit=9.left" / "root_id=0" / "part-0.txt").write_text('{"t":"2026-01-01T00:00:00Z","path":"never","change":"created","who":"you"}\n')
    log = L.read_change_log(spark, path)
    kept = log.where("path = 'a.py'").first()
    assert kept.at_us == us(1.25) and kept.input == "x" * 5000 and kept.diff == "@@"
    assert log.where("path = 'b.py'").count() == 2 and log.where("path = 'never'").count() == 0
    people = spark.createDataFrame([("s1",)], "who string")
    roots = spark.createDataFrame([(0, "/p"), (1, "/q"), (2, "/q/inner")], "root_id int, path string")
    events, calls = L.resolve_replay(log, people, roots)
    assert rows(events.distinct(), "who", "root_id", "rel", "source", "tool", "call_id") == [
        ("s1", 0, "a.py", "window", "eval", "c1"),
        ("s1", 0, "q", "watcher", None, None),
        ("s1", 2, "c.py", "watcher", None, None),  # now inside a nested root
        ("you", 0, "b.py", "watcher", None, None),
    ]
    own = spark.createDataFrame([("s1", "c1", "bash", "own")], "who string, call_id string, tool string, input string")
    assert rows(L.known_calls(own, calls)) == [("s1", "c1", "bash", "own")]
    assert rows(calls, "who", "call_id", "tool", F.length("input")) == [("s1", "c1", "eval", 5000)]


def test_saved_tables_are_read_by_root_and_day(spark, tmp_path):
    day = 86_400_000_000
    rows_ = [(i, ("tool", "watcher")[i % 7 == 0], None if i % 11 == 0 else i % 5, i * day // 10 + 17) for i in range(200)]
    events = spark.createDataFrame(rows_, "event_id bigint, source string, root_id bigint, start_us bigint")
    spans = spark.createDataFrame([("a", 5, 6), ("b", 3 * day, 9 * day), (None, -day, 0)], "who string, start_us bigint, end_us bigint")
    empty = spark.createDataFrame([("a",)], "who string")
    tables = Tables(*[{"file_events": events, "spans": spans}.get(n, empty) for n in Tables.__dataclass_fields__])
    meta, path = Meta(("/logs",), ("/p",), 30), str(tmp_path / "saved")
    save_model(tables, path, meta)
    back = load_model(spark, path, meta)
    assert back.file_events.dtypes == events.dtypes and back.spans.dtypes == spans.dtypes
    assert rows(back.file_events, *events.columns) == rows(events.where("source = 'tool'"), *events.columns)
    assert rows(back.spans) == rows(spans)
    lo, hi = 3 * day, 5 * day
    one = load_between(spark, path, meta, "file_events", lo, hi, [2])
    assert rows(one, "event_id") == rows(events.where(f"source = 'tool' AND root_id = 2 AND start_us >= {lo} AND start_us < {hi}"), "event_id")
    files = [f for (f,) in rows(one.select(F.input_file_name()).distinct())]
    assert files and all("/root_id=2/_day=" in f and f.split("_day=")[1].split("/")[0] in ("3", "4") for f in files)
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "root_id" in scan.split("PartitionFilters: [")[1].split("]")[0] and "_day" in scan.split("PartitionFilters: [")[1].split("]")[0]
    few = spark.createDataFrame([(2,), (4,)], "root_id bigint").where("root_id < 4")
    joined = load_between(spark, path, meta, "file_events", lo, hi, few)
    assert rows(joined, "event_id") == rows(one, "event_id")
    assert rows(load_between(spark, path, meta, "spans", 0, 4 * day)) == [("a", 5, 6), ("b", 3 * day, 9 * day)]
    assert load_between(spark, path, replace(meta, idle_gap=60), "spans", 0, 1) is None
