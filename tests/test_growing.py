"""Growing files, committed tables, keyed state and runs with late rows, against their batch twins."""

from __future__ import annotations

import io
import os
import random

import pytest
from helpers import iso, rows, us, write_jsonl
from pyspark.sql import functions as F

from tracelane.operators.attribution import coalesce_changes
from tracelane.operators.intervals import merge_intervals
from tracelane.operators.pairing import pair_calls
from tracelane.sources.committed import Committed
from tracelane.sources.raw import number_lines, read_lines
from tracelane.streaming import flows, fold, growing, states

US = 1_000_000


def finish(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


# --- growing files -----------------------------------------------------------------------


def test_lines_belong_to_the_range_of_their_break():
    draw = random.Random(1)
    for _ in range(200):
        data = "".join(draw.choice("ab\né") for _ in range(draw.randint(0, 60))).encode()
        cuts = sorted({0, len(data), *(draw.randint(0, len(data)) for _ in range(draw.randint(0, 6)))})
        got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in growing.lines_of_range(io.BytesIO(data), a, b, chunk=draw.randint(1, 9))]
        whole, at = [], 0
        for line in data.split(b"\n")[:-1]:
            whole.append((at, line))
            at += len(line) + 1
        assert got == whole


def reader(tmp_path, **options):
    return growing.GrowingReader({"path": f"file://{tmp_path}/logs", "positions": f"file://{tmp_path}/positions", **options})


def taken(r, start, end):
    return sorted(x for p in r.partitions(start, end) for x in p.ranges)


def test_offsets_and_ranges(tmp_path):
    logs = tmp_path / "logs" / "p"
    write_jsonl(logs / "a.jsonl", ["{}", "{}"], tail="{")
    write_jsonl(logs / ".hidden.jsonl", ["{}"])
    (logs / "note.txt").write_text("x\n")
    r = reader(tmp_path)
    zero, one = r.initialOffset(), r.latestOffset()
    assert one == {"version": 1} == r.latestOffset()  # nothing new, no new step
    assert taken(r, zero, one) == [("p/a.jsonl", 0, 0, 7)] and taken(r, one, one) == []
    with open(logs / "a.jsonl", "a") as f:
        f.write("}\n")
    write_jsonl(logs / "b.jsonl", ["{}"])
    again = reader(tmp_path)  # after a restart the positions are read back
    two = again.latestOffset()
    assert two == {"version": 2} and taken(again, one, two) == [("p/a.jsonl", 0, 7, 9), ("p/b.jsonl", 0, 0, 3)]
    assert taken(again, zero, two) == [("p/a.jsonl", 0, 0, 9), ("p/b.jsonl", 0, 0, 3)]
    write_jsonl(logs / "a.jsonl", ["[1,2,3,4,5,6,7]"])  # longer than before, but other bytes
    (logs / "b.jsonl").write_text("")  # shrunk
    three = again.latestOffset()
    assert taken(again, two, three) == [("p/a.jsonl", 1, 0, 16)]
    write_jsonl(logs / "b.jsonl", ["1"])
    assert taken(again, three, again.latestOffset()) == [("p/b.jsonl", 1, 0, 2)]


def test_a_budget_cuts_batches_and_positions_are_packed(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "EVERY", 2)
    write_jsonl(tmp_path / "logs" / "a.jsonl", ["x" * 9] * 5)
    write_jsonl(tmp_path / "logs" / "b.jsonl", ["y" * 9] * 2)
    r = reader(tmp_path, maxBytesPerTrigger="25", splitBytes="20")
    seen, at = [], r.initialOffset()
    for _ in range(6):
        to = r.latestOffset()
        seen += taken(r, at, to)
        at = to
    assert at == {"version": 3}
    assert seen == [("a.jsonl", 0, 0, 20), ("a.jsonl", 0, 20, 25), ("a.jsonl", 0, 25, 40), ("a.jsonl", 0, 40, 50), ("b.jsonl", 0, 0, 20)]
    assert (tmp_path / "positions" / "000000000002.all").exists()
    assert reader(tmp_path).latestOffset() == {"version": 3}


def test_growing_files_equal_the_batch_reader(spark, tmp_path):
    logs, table = tmp_path / "logs", str(tmp_path / "lines")
    draw = random.Random(2)

    def grow():
        for name in ("p/a.jsonl", "p/b.jsonl", "q/c.jsonl"):
            path = logs / name
            path.parent.mkdir(parents=True, exist_ok=True)
            with open(path, "ab") as f:
                for _ in range(draw.randint(0, 6)):
                    f.write(draw.choice(["x", "é", "", "long " * 40]).encode() + draw.choice([b"\n", b"\n", b""]))

    for _ in range(3):
        grow()
        finish(flows.ingest_growing(growing.tail_growing(spark, str(logs), str(tmp_path / "pos"), split_bytes=37), table, str(tmp_path / "ck")))
        got = flows.grown_lines(spark, table)
        assert rows(got, "file", "line_no", "value") == rows(number_lines(read_lines(spark, str(logs))), "file", "line_no", "value")


# --- committed tables ----------------------------------------------------------------------


def test_only_committed_files_are_read(spark, tmp_path):
    table = Committed(spark, str(tmp_path / "t"), ("p",))
    with pytest.raises(ValueError, match="nothing is committed"):
        table.read()
    assert table.read("id bigint, p int").count() == 0
    df = spark.createDataFrame([(i, i % 3) for i in range(9)] + [(9, None)], "id bigint, p int")
    table._write(df, 0)  # an attempt that stops before its commit
    assert table.read("id bigint, p int").count() == 0
    assert table.append(df, 0) and not table.append(df, 0)
    assert rows(table.read("id bigint, p int"), "id", "p") == rows(df)
    with pytest.raises(Exception, match="[Ee]xist"):  # a second writer of one batch
        table.store.publish("_commits/" + "0" * 20, "{}")
    assert table.append(df.where("id < 2"), 1)
    assert table.replace(lambda: (df.where("id = 1"), table.in_partitions([(1,), (None,)])), 2)
    want = [(0,), (0,), (1,), (2,), (3,), (5,), (6,), (8,)]
    assert rows(table.read(), "id") == want
    before = len(table.state()[1])
    assert table.compact() == before > len(table.state()[1]) and rows(table.read(), "id") == want
    assert not table.append(df, 1) and table.append(df.where("id = 7"), 3) and table.read().count() == len(want) + 1
    assert table.compact(1) == 0


def test_reingest_leaves_other_partitions_alone(spark, tmp_path):
    events = spark.createDataFrame([(f"w{i}", s, f"{s}{i}") for i in range(40) for s in ("tool", "window")], "who string, source string, rel string")
    table = Committed(spark, str(tmp_path / "t"), ("part",))
    table.append(flows.by_transcript(events, 8), 0)
    before = set(table.state()[1])
    who = spark.createDataFrame([("w3",), ("new",)], "who string")
    fresh = spark.createDataFrame([("w3", "tool", "again"), ("new", "tool", "first")], "who string, source string, rel string")
    assert flows.reingest(table, 1, who, fresh, 8) and not flows.reingest(table, 1, who, fresh, 8)
    want = [(w, s, r) for w, s, r in rows(events) if (w, s) != ("w3", "tool")] + [("w3", "tool", "again"), ("new", "tool", "first")]
    assert rows(table.read(), "who", "source", "rel") == sorted(want)
    touched = {f.split("/")[1] for f in before - set(table.state()[1])}
    assert len(touched) <= 2 and len(before & set(table.state()[1])) >= len(before) - 4


# --- keyed state -----------------------------------------------------------------------------


def fed(spark, folder, batches, schema):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").json(str(folder))


RECORDS = "who string, call_id string, role string, line_no bigint, at_us bigint"


def test_state_pairs_equal_batch_pairs(spark, tmp_path):
    draw = random.Random(3)
    every = [(f"w{draw.randint(0, 2)}", draw.choice(["x", "y", None]), draw.choice(["call", "result"]), n, us(n)) for n in range(90)]
    batches = [draw.sample(every[a : a + 30], 30) for a in (0, 30, 60)]
    finish(flows.keep_updates(states.paired_calls(fed(spark, tmp_path / "in", batches, RECORDS)), str(tmp_path / "out"), str(tmp_path / "ck")))
    got = states.latest_calls(Committed(spark, str(tmp_path / "out")).read())
    want = pair_calls(spark.createDataFrame(every, RECORDS))
    columns = ("who", "call_id", "call_line", "start_us", "end_us", "result_line")
    assert rows(got, *columns) == rows(want, *columns)
    assert 0 < got.where("state = '1 open'").count() == want.where("result_line IS NULL").count()


def test_a_call_that_waits_is_reported(spark, tmp_path):
    batches = [[("w", "x", "call", 1, 1), ("w", "z", "call", 2, 2)], [("w", "z", "result", 3, 3)], [("w", "q", "call", 4, 4)], [("w", "q", "result", 5, 5)]]
    stream = fed(spark, tmp_path / "in", batches, RECORDS)
    q = flows.keep_updates(states.paired_calls(stream, patience_ms=1), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {r.call_id: r.state for r in states.latest_calls(Committed(spark, str(tmp_path / "out")).read()).collect()}
    assert got == {"x": states.WAITING, "z": states.CLOSED, "q": states.CLOSED}


def test_sessions_end_by_record_or_silence(spark, tmp_path):
    rec = lambda s, t, x=False: {"session": s, "at": iso(t), "is_exit": x, "recorded_us": us(t) if x else None}
    batches = [[rec("a", 0), rec("a", 10, True), rec("b", 5)], [rec("a", 20), rec("c", 3, True)], [rec("d", 200)], [rec("e", 201)], [rec("b", 205), rec("e", 210)]]
    path = tmp_path / "in"
    for i, batch in enumerate(batches):
        file = write_jsonl(path / f"b{i}.json", batch)
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("session string, at timestamp, is_exit boolean, recorded_us bigint").option("maxFilesPerTrigger", "1").json(str(path))
    finish(flows.keep_updates(states.live_sessions(stream), str(tmp_path / "out"), str(tmp_path / "ck")))
    updates = Committed(spark, str(tmp_path / "out")).read()
    got = {r.session: (r.status, r.start_us, r.last_seen_us, r.end_us) for r in states.latest_status(updates).collect()}
    assert got == {
        "a": ("ended", us(0), us(20), us(20)),  # went on after its exit, then fell silent
        "b": ("live", us(5), us(205), None),  # ended by silence, then came back
        "c": ("ended", us(3), us(3), us(3)),
        "d": ("live", us(200), us(200), None),
        "e": ("live", us(201), us(210), None),
    }
    assert updates.where("session = 'b' AND status = 'ended'").count() == 1


# --- runs with late rows -------------------------------------------------------------------------


def test_folded_spans_equal_batch_in_any_order(spark, tmp_path):
    draw = random.Random(4)
    parts = [(draw.randint(0, 2), us(s := draw.randint(0, 4000)), us(s + draw.randint(-20, 60))) for _ in range(120)]
    schema = "who bigint, start_us bigint, end_us bigint"
    runs, table = fold.span_runs(), fold.run_table(spark, str(tmp_path / "t"))
    for i in range(4):
        batch = fold.span_rows(spark.createDataFrame(parts[i::4], schema))
        assert fold.fold(batch, table, i, runs, slot_us=300 * US, parts=2) and not fold.fold(batch, table, i, runs, slot_us=300 * US, parts=2)
    want = merge_intervals(spark.createDataFrame(parts, schema), ("who",), gap=30 * US)
    assert rows(fold.stored(table, runs), "who", "start_us", "end_us", "n_intervals") == rows(want, "who", "start_us", "end_us", "n_intervals")


def test_a_late_row_unites_bursts(spark, tmp_path):
    schema = "path string, at_us bigint, event_id bigint, change string"
    changes = [("a", us(0), 1, "created"), ("a", us(8), 2, "removed"), ("b", us(0), 3, "modified"), ("b", us(5), 4, "created"), ("c", us(50), 5, "removed"), ("a", us(4), 6, "modified"), ("b", us(3), 7, "removed"), ("c", us(49), 8, "created")]
    runs, table = fold.burst_runs(), fold.run_table(spark, str(tmp_path / "t"))
    for i, batch in enumerate((changes[:5], changes[5:])):
        fold.fold(fold.burst_rows(spark.createDataFrame(batch, schema)), table, i, runs)
        want = coalesce_changes(spark.createDataFrame(changes[: 5 + 3 * i], schema), ("path",))
        columns = ("path", "event_id", "at_us", "change", "n_raw")
        assert rows(fold.settled(fold.stored(table, runs)), *columns) == rows(want, *columns)
    assert rows(fold.settled(fold.stored(table, runs)), "path") == [("b",)]


def test_untouched_slots_keep_their_files(spark, tmp_path):
    schema = "who bigint, start_us bigint, end_us bigint"
    runs, table = fold.span_runs(), fold.run_table(spark, str(tmp_path / "t"))
    day = 86_400 * US
    old = [(1, d * day, d * day + US) for d in range(10)]
    fold.fold(fold.span_rows(spark.createDataFrame(old, schema)), table, 0, runs, slot_us=day, parts=1)
    before = set(table.state()[1])
    fold.fold(fold.span_rows(spark.createDataFrame([(1, 4 * day + 2 * US, 4 * day + 3 * US), (2, 9 * day, 9 * day)], schema)), table, 1, runs, slot_us=day, parts=1)
    gone = {f.split("/")[1] for f in before - set(table.state()[1])}
    assert gone == {"slot=4", "slot=9"}
    assert fold.fold(fold.span_rows(spark.createDataFrame([], schema)), table, 2, runs, slot_us=day, parts=1)
    assert fold.stored(table, runs).count() == 11
