"""Steps that must not grow with the input in the driver, in one task or in one group."""

from __future__ import annotations

import helpers
from pyspark.sql import functions as F

from tracelane.operators.pairing import pair_calls
from tracelane.plans import q_streams
from tracelane.plans.registry import QUERIES
from tracelane.sources import raw
from tracelane.sources.committed import Committed
from tracelane.streaming import flows, growing, states


def test_sessions_gather_nothing_in_the_driver(spark, tmp_path):
    events = spark.range(40).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 12).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["log_sessions"](spark, str(tmp_path))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 3


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(400):
        path = tmp_path / "logs" / f"p{i % 3}" / f"s {i}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f'{{"n": {i}}}\n{{"un')
    (tmp_path / "logs" / "p0" / ".s.jsonl").write_text("{}\n")
    (tmp_path / "logs" / "_p").mkdir()
    (tmp_path / "logs" / "_p" / "s.jsonl").write_text("{}\n")
    lines = raw.read_lines(spark, str(tmp_path / "logs"))
    assert lines.rdd.getNumPartitions() <= 4
    got = raw.read_omp(spark, str(tmp_path / "logs"))
    assert got.count() == 400 and got.where("line_no <> 0").isEmpty() and got.select("file").distinct().count() == 400
    assert (tmp_path / "logs" / "p1" / "s 1.jsonl").as_posix() in [r.file for r in got.select("file").collect()]


def test_labels_share_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"agent-{i}.meta.json").write_text(f'{{"description": "", "agentType": "t{i}"}}')
    labels = raw.read_labels(spark, str(tmp_path))
    assert labels.rdd.getNumPartitions() <= 4
    assert labels.where("who LIKE '%/agent-7.jsonl'").first().label == "t7" and labels.count() == 400


def test_small_ranges_share_tasks(tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for i in range(300):
        (logs / f"s{i}.jsonl").write_text('{"n": 1}\n' * 5)
    reader = growing.GrowingReader({"path": f"file://{logs}", "positions": f"file://{tmp_path}/positions", "splitBytes": "20"})
    tasks = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(tasks) == 1 and len(tasks[0].ranges) == 900
    got = [(f, n) for batch in reader.read(tasks[0]) for f, n in zip(batch["file"].to_pylist(), batch["n"].to_pylist(), strict=True)]
    assert len(got) == 1500


def test_a_large_file_is_written_by_many_tasks(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(3000).select(F.when(n % 10 == 0, F.concat(F.lit("d/s"), n.cast("string"))).otherwise("one").alias("name"), (-n).alias("at"), F.concat(n.cast("string"), F.lit("\n")).alias("text"))
    folder = f"{tmp_path}/logs"
    for _ in range(2):
        q_streams._grow(rows, f"file://{folder}")
    want = "".join(f"{i}\n" for i in range(2999, -1, -1) if i % 10)
    assert (tmp_path / "logs" / "one").read_text() == want * 2
    assert (tmp_path / "logs" / "d" / "s70").read_text() == "70\n" * 2 and len(list((tmp_path / "logs" / "d").iterdir())) == 300
    assert len({p.name.split("-")[0] for p in tmp_path.glob("logs-pieces-*/*")}) > 1


def test_pairs_without_a_frame_per_call(spark, tmp_path):
    columns = "who string, call_id string, line_no bigint, at_us bigint, role string"
    rows = [(str(i % 50), str(i % 3), i, 10 * i, "call" if i % 2 else "result") for i in range(900)] + [(None, "x", 1000, 5, "call"), (None, "x", 999, 4, "result")]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/in")
    stream = states.paired_calls(spark.readStream.schema(columns).parquet(f"{tmp_path}/in"))
    assert "InPandas" not in stream._jdf.queryExecution().logical().toString()
    flows.keep_updates(stream, f"{tmp_path}/calls", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = states.latest_calls(Committed(spark, f"{tmp_path}/calls").read(states.CALLS + ", batch bigint"))
    want = pair_calls(spark.createDataFrame(rows, columns), ("who", "call_id"))
    key = ("who", "call_id", "call_line", "start_us", "end_us", "result_line")
    assert helpers.rows(got, *key) == helpers.rows(want, *key)
