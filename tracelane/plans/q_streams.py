"""Queries that run streams over files and tables which grow in several steps, and read what they kept.

Each feeds the benchmark's rows in several batches, most of them out of order, and gives what the batch operator gives
on all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.config import DEFAULTS, Params
from tracelane.operators.ordered import ordered, previous
from tracelane.operators.roots import root_prefixes
from tracelane.plans import shims as S
from tracelane.plans.shims import with_sql
from tracelane.session import shared_folder, staged
from tracelane.sources import changelog, raw, store
from tracelane.sources import variant as V
from tracelane.sources.committed import Committed
from tracelane.sources.participants import tops
from tracelane.streaming import flows, fold, growing, states

REGISTERED: dict = {}


def register(name, sql=None):
    def add(fn):
        REGISTERED[name] = (fn, sql)
        return fn

    return add


def _base(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _until_done(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _fed(df: DataFrame, base: str, batches: int, at) -> DataFrame:
    """A file stream of a table in several batches; ``at`` gives each row's batch. Files are read oldest first."""
    rows = staged(df.withColumn("_at", at))
    for i in range(batches):
        rows.where(F.col("_at") == i).drop("_at").coalesce(1).write.mode("append").parquet(f"{base}/fed")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(f"{base}/fed")


def _mixed(column: str, batches: int):
    """Rows of all times in every batch."""
    return F.pmod(F.xxhash64(column), F.lit(batches)).cast("int")


# --- growing transcripts -----------------------------------------------------------------


#: Bytes of a file's text that a task holds before it writes them.
_HELD = 4 << 20


def _append(folder: str, pieces: str):
    """Append texts to files, of rows (name, text) in order.

    The first and the last file of a task may go on in others, and a large one is not held: of these it writes a
    piece each, and gives (name, part, n).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, path = fs.FileSystem.from_uri(folder)
        aside = fs.FileSystem.from_uri(pieces)[1]
        part, made, cut = TaskContext.get().partitionId(), {aside}, []
        files.create_dir(aside, recursive=True)

        def put(name: str, texts: list[str], piece: int | None) -> None:
            target = f"{path}/{name}" if piece is None else f"{aside}/{part}-{piece}"
            if (top := target.rpartition("/")[0]) not in made:
                files.create_dir(top, recursive=True)
                made.add(top)
            with files.open_append_stream(target) as out:
                out.write("".join(texts).encode())

        name, texts, held, n, apart = None, [], 0, 0, True
        for batch in batches:
            for key, text in zip(batch["name"], batch["text"], strict=True):
                if key != name and name is not None:
                    put(name, texts, n if apart else None)
                    if apart:
                        cut.append((name, part, n))
                    n, apart, texts, held = n + 1, False, [], 0
                name = key
                texts.append(text)
                held += len(text)
                if held >= _HELD:
                    put(name, texts, n)
                    apart, texts, held = True, [], 0
        if name is not None:
            put(name, texts, n)
            cut.append((name, part, n))
        yield pd.DataFrame(cut, columns=["name", "part", "n"])

    return run


def _join(folder: str, pieces: str):
    """Append pieces (name, part, n) to their files, in order, a bounded number of bytes at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        aside = fs.FileSystem.from_uri(pieces)[1]
        for batch in batches:
            for name, part, n in zip(batch["name"], batch["part"], batch["n"], strict=True):
                files.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
                with files.open_input_stream(f"{aside}/{part}-{n}") as piece, files.open_append_stream(f"{path}/{name}") as out:
                    while data := piece.read(_HELD):
                        out.write(data)
            yield batch[["name"]]

    return run


def _grow(rows: DataFrame, folder: str) -> None:
    """Lengthen files by rows (name, at, text). Tasks get ranges of (name, at), so that a large file is written by many."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = f"{folder.rstrip('/')}-pieces-{uuid.uuid4().hex}"
    dealt = rows.where("name IS NOT NULL").repartitionByRange(parts, "name", "at").sortWithinPartitions("name", "at")
    cut = staged(dealt.select("name", "text").mapInPandas(_append(folder, pieces), "name string, part int, n int"))
    joined = cut.repartition(parts, "name").sortWithinPartitions("name", "part", "n").mapInPandas(_join(folder, pieces), "name string")
    joined.write.format("noop").mode("overwrite").save()


def _transcript_lines(spark, sf) -> DataFrame:
    """A transcript per conversation; a message is one JSON line."""
    talks = S.table(spark, sf, "conversations")
    body = F.to_json(F.struct("role", "text", "turn"))
    return talks.select(F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("name"), F.col("turn").alias("at"), F.concat(body, F.lit("\n")).alias("text"))


@register(
    "grown_transcripts",
    """SELECT 's' || conv_id || '.jsonl' AS name, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS line_no, CAST(0 AS BIGINT) AS generation, role, text FROM conversations""",
)
def grown_transcripts(spark, sf):
    """Transcripts that grow between batches, mid-line too: every line is read once, when it is complete."""
    base = _base(spark)
    lines = staged(_transcript_lines(spark, sf))
    half = (F.length("text") / 2).cast("int")
    early, middle = F.col("at") < 2, F.col("at") == 2
    steps = [
        lines.where(early).unionByName(lines.where(middle).withColumn("text", F.substring("text", F.lit(1), half))),
        lines.where(middle).withColumn("text", F.substring("text", half + 1, F.length("text"))).unionByName(lines.where("at > 2 AND at < 5")),
        lines.where("at >= 5"),
    ]
    for step in steps:
        _grow(step, f"file://{base}/logs".replace("file://file:", "file:"))
        grown = growing.tail_growing(spark, f"{base}/logs".removeprefix("file:"), f"{base}/positions", split_bytes=4096)
        _until_done(flows.ingest_growing(grown, f"{base}/lines", f"{base}/state"))
    kept = flows.grown_lines(spark, f"{base}/lines").withColumn("rec", F.try_parse_json("value"))
    return kept.select(F.regexp_extract("file", "([^/]*)$", 1).alias("name"), "line_no", "generation", V.text("rec", "$.role").alias("role"), V.text("rec", "$.text").alias("text"))


@register(
    "rewritten_transcripts",
    """SELECT 's' || conv_id || '.jsonl' AS name, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS line_no,
      CAST(CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS generation, CASE WHEN conv_id % 3 = 0 THEN 'again' ELSE role END AS role
    FROM conversations WHERE conv_id % 3 <> 0 OR turn > 0""",
)
def rewritten_transcripts(spark, sf):
    """Transcripts that are replaced by others between batches: only their latest generation counts."""
    base = _base(spark)
    lines = staged(_transcript_lines(spark, sf))
    folder = f"{base}/logs".removeprefix("file:")
    again = F.regexp_extract("name", "[0-9]+", 0).cast("bigint") % 3 == 0
    _grow(lines, f"file://{folder}")
    _until_done(flows.ingest_growing(growing.tail_growing(spark, folder, f"{base}/positions"), f"{base}/lines", f"{base}/state"))
    new = lines.where(again & (F.col("at") > 0)).withColumn("text", F.concat(F.to_json(F.struct(F.lit("again").alias("role"), "at")), F.lit("\n")))
    gone = lines.where(again).select("name").distinct()
    gone.mapInPandas(_emptied(f"file://{folder}"), "name string").write.format("noop").mode("overwrite").save()
    _grow(new, f"file://{folder}")
    _until_done(flows.ingest_growing(growing.tail_growing(spark, folder, f"{base}/positions"), f"{base}/lines", f"{base}/state"))
    kept = flows.grown_lines(spark, f"{base}/lines").withColumn("rec", F.try_parse_json("value"))
    return kept.select(F.regexp_extract("file", "([^/]*)$", 1).alias("name"), "line_no", "generation", V.text("rec", "$.role").alias("role"))


def _emptied(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["name"]:
                files.open_output_stream(f"{path}/{name}").close()
            yield batch

    return run


# --- transcript files ----------------------------------------------------------------------


def _files(spark, *parts: DataFrame) -> str:
    """A folder of files, from rows (name, at, text)."""
    folder, rows = f"{_base(spark)}/logs".removeprefix("file:"), parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    _grow(rows, f"file://{folder}")
    return folder


def _line(*columns) -> Column:
    return F.concat(F.to_json(F.struct(*columns)), F.lit("\n"))


@register(
    "transcript_files",
    """SELECT 'p' || (conv_id % 7) || CASE WHEN conv_id % 5 = 0 THEN '/s' || conv_id || '/__advisor.jsonl' ELSE '/s' || conv_id || '.jsonl' END AS name,
      CAST(2 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS BIGINT) AS line_no, role, text, 'p' || (conv_id % 7) AS project FROM conversations""",
)
def transcript_files(spark, sf):
    """Transcripts of the first format with blank, broken and unfinished lines, hidden files and helpers' folders."""
    talks, conv = S.table(spark, sf, "conversations"), F.col("conv_id").cast("string")
    project = F.concat(F.lit("p"), (F.col("conv_id") % 7).cast("string"))
    tail = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("/s"), conv, F.lit("/__advisor.jsonl"))).otherwise(F.concat(F.lit("/s"), conv, F.lit(".jsonl")))
    junk = F.when(F.col("turn") % 2 == 0, "\n").otherwise('{"role": "bro\n')
    said = talks.select(F.concat(project, tail).alias("name"), F.col("turn").alias("at"), F.concat(_line("role", "text"), junk).alias("text"))
    open_ = talks.where("turn = 0").select(F.concat(project, tail).alias("name"), F.lit(1 << 40).alias("at"), F.lit('{"role":"unfinished"}').alias("text"))
    hidden = talks.where("turn = 0").select(F.concat(project, F.lit("/.s"), conv, F.lit(".jsonl")).alias("name"), F.lit(0).alias("at"), F.lit('{"role":"hidden"}\n').alias("text"))
    folder = _files(spark, said, open_, hidden)
    got = raw.read_omp(spark, folder)
    below = lambda c: F.col(c).substr(F.lit(len(folder) + 2), F.length(c))
    return got.select(below("file").alias("name"), "line_no", V.text("rec", "$.role").alias("role"), V.text("rec", "$.text").alias("text"), below("project_dir").alias("project"))


@register(
    "subagent_files",
    """SELECT 'p/s' || conv_id || CASE WHEN conv_id % 3 = 1 THEN '/subagents/agent-' || conv_id || '.jsonl' ELSE '.jsonl' END AS name,
      CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS line_no, role FROM conversations WHERE conv_id % 3 <> 2""",
)
def subagent_files(spark, sf):
    """Transcripts of the second format: a project's own and its subagents'; those in other folders are none."""
    conv, kind = F.col("conv_id").cast("string"), F.col("conv_id") % 3
    tail = F.when(kind == 0, ".jsonl").when(kind == 1, F.concat(F.lit("/subagents/agent-"), conv, F.lit(".jsonl"))).otherwise(F.concat(F.lit("/tool-results/r"), conv, F.lit(".jsonl")))
    said = S.table(spark, sf, "conversations").select(F.concat(F.lit("p/s"), conv, tail).alias("name"), F.col("turn").alias("at"), _line("role").alias("text"))
    folder = _files(spark, said)
    got = raw.read_claude(spark, folder)
    return got.select(F.col("file").substr(F.lit(len(folder) + 2), F.length("file")).alias("name"), "line_no", V.text("rec", "$.role").alias("role"))


@register(
    "rollout_files",
    """SELECT 'd' || (conv_id % 4) || '/x/rollout-' || conv_id || '.jsonl' AS name, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS line_no, role
    FROM conversations WHERE conv_id % 5 NOT IN (3, 4)""",
)
def rollout_files(spark, sf):
    """Rollouts at any depth whose first line is a complete header; others, and other names, are none."""
    talks, conv, kind = S.table(spark, sf, "conversations"), F.col("conv_id").cast("string"), F.col("conv_id") % 5
    stem = F.when(kind == 4, "notes-").otherwise("rollout-")
    name = F.concat(F.lit("d"), (F.col("conv_id") % 4).cast("string"), F.lit("/x/"), stem, conv, F.lit(".jsonl")).alias("name")
    payload = F.struct(conv.alias("id"), F.when(kind != 3, "/w").alias("cwd")).alias("payload")
    heads = talks.select("conv_id").distinct().select(name, F.lit(-1).cast("bigint").alias("at"), _line(F.lit("session_meta").alias("type"), payload).alias("text"))
    folder = _files(spark, heads, talks.select(name, F.col("turn").alias("at"), _line("role").alias("text")))
    got = raw.read_codex(spark, folder).where("line_no > 0")
    return got.select(F.col("file").substr(F.lit(len(folder) + 2), F.length("file")).alias("name"), "line_no", V.text("rec", "$.role").alias("role"))


@register(
    "sidecar_labels",
    """SELECT 'agent-' || c_custkey || '.jsonl' AS who, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE c_mktsegment END AS label FROM customer WHERE c_custkey % 3 <> 2""",
)
def sidecar_labels(spark, sf):
    """Labels of subagents from the files beside their transcripts: the description, else the type."""
    kind = F.col("c_custkey") % 3
    fields = F.struct(F.when(kind == 0, F.col("c_name")).when(kind == 1, "").alias("description"), F.when(kind != 2, F.col("c_mktsegment")).alias("agentType"))
    metas = S.table(spark, sf, "customer").select(
        F.concat(F.lit("s/subagents/agent-"), F.col("c_custkey").cast("string"), F.lit(".meta.json")).alias("name"), F.lit(0).alias("at"), F.to_json(fields).alias("text")
    )
    got = raw.read_labels(spark, _files(spark, metas))
    return got.select(F.regexp_extract("who", "([^/]*)$", 1).alias("who"), "label")


@register(
    "title_index",
    """SELECT CAST(o_custkey AS VARCHAR) AS id, max_by(o_orderpriority || ' ' || o_orderkey, o_orderkey) FILTER (WHERE o_orderkey % 4 <> 0) AS title FROM orders
    GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderkey % 4 <> 0) > 0""",
)
def title_index(spark, sf):
    """Session titles: the last name of an id that is not empty."""
    n = F.col("o_orderkey")
    named = F.when(n % 4 != 0, F.concat("o_orderpriority", F.lit(" "), n.cast("string"))).otherwise("")
    lines = S.table(spark, sf, "orders").select(F.lit("session_index.jsonl").alias("name"), n.alias("at"), _line(F.col("o_custkey").cast("string").alias("id"), named.alias("thread_name")).alias("text"))
    folder = _files(spark, lines)
    return raw.read_title_index(spark, f"{folder}/session_index.jsonl")


# --- keyed state -------------------------------------------------------------------------


@register(
    "stream_pairs",
    with_sql(
        "ev",
        """
    WITH r AS (SELECT who, k % 5 AS call_id, event_id, at_us, event_type = 'purchase' AS res FROM ev WHERE event_type IN ('click', 'purchase')),
    g AS (SELECT *, coalesce(sum(CAST(res AS INT)) OVER (PARTITION BY who, call_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gen FROM r)
    SELECT CAST(who AS VARCHAR) AS who, CAST(call_id AS VARCHAR) AS call_id, min(event_id) FILTER (WHERE NOT res) AS call_line, min_by(at_us, event_id) FILTER (WHERE NOT res) AS start_us,
      min_by(at_us, event_id) FILTER (WHERE res) AS end_us, min(event_id) FILTER (WHERE res) AS result_line
    FROM g GROUP BY who, call_id, gen HAVING count(*) FILTER (WHERE NOT res) > 0""",
    ),
)
def stream_pairs(spark, sf):
    """Calls and results in five batches, paired by keyed state: closed calls and those that are still open."""
    base = _base(spark)
    e = S.ev(spark, sf).where(F.col("event_type").isin("click", "purchase")).select(
        F.col("who").cast("string").alias("who"),
        (F.col("k") % 5).cast("string").alias("call_id"),
        F.when(F.col("event_type") == "purchase", "result").otherwise("call").alias("role"),
        F.col("event_id").alias("line_no"),
        "at_us",
    )
    stream = _fed(e, base, 5, F.least(F.floor(F.col("line_no") / 50), F.lit(4)).cast("int"))
    _until_done(flows.keep_updates(states.paired_calls(stream), f"{base}/calls", f"{base}/state"))
    updates = Committed(spark, f"{base}/calls").read(states.CALLS + ", batch bigint")
    return states.latest_calls(updates).drop("state")


@register(
    "stream_status",
    with_sql(
        "ev",
        """
    WITH s AS (SELECT who AS session, min(at_us) AS start_us, max(at_us) AS last_seen_us, max(at_us) FILTER (WHERE event_type = 'error') AS x, max(at_us) FILTER (WHERE event_type <> 'error') AS o FROM ev GROUP BY who),
    w AS (SELECT max(at_us) // 1000 - 10000 AS mark FROM ev)
    SELECT CAST(session AS VARCHAR) AS session, start_us, last_seen_us, CASE WHEN x >= coalesce(o, x) THEN 'ended' WHEN last_seen_us // 1000 + 120000 <= mark THEN 'ended' ELSE 'live' END AS status,
      CASE WHEN x >= coalesce(o, x) THEN x WHEN last_seen_us // 1000 + 120000 <= mark THEN last_seen_us END AS end_us FROM s, w""",
    ),
)
def stream_status(spark, sf):
    """Sessions kept by state and timer: an end is a record or 120 silent seconds of event time."""
    base = _base(spark)
    is_exit = F.col("event_type") == "error"
    e = S.ev(spark, sf).select(F.col("who").alias("session"), F.timestamp_micros("at_us").alias("at"), is_exit.alias("is_exit"), F.when(is_exit, F.col("at_us")).alias("recorded_us"), "event_id")
    stream = _fed(e, base, 4, F.least(F.floor(F.col("event_id") / 100), F.lit(3)).cast("int"))
    _until_done(flows.keep_updates(states.live_sessions(stream), f"{base}/status", f"{base}/state"))
    updates = Committed(spark, f"{base}/status").read(states.STATUS + ", batch bigint")
    return states.latest_status(updates)


# --- runs with late rows -----------------------------------------------------------------


_QUIET = 43_200


@register(
    "stream_coalesce",
    with_sql(
        "ev",
        f"""
    WITH e AS (SELECT 'f' || k AS path, at_us, event_id, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS s FROM ev WHERE event_type = 'error'),
    o AS (SELECT *, lag(at_us) OVER (PARTITION BY path ORDER BY at_us, event_id) AS prev FROM e),
    b AS (SELECT *, sum(CASE WHEN prev IS NULL OR at_us - prev >= {_QUIET}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM o),
    c AS (SELECT path, min(event_id) AS event_id, max(at_us) AS at_us, max(s) AS top, min_by(s, event_id) AS begin, count(*) AS n_raw FROM b GROUP BY path, burst)
    SELECT path, event_id, at_us, CASE top WHEN 2 THEN 'removed' WHEN 1 THEN 'created' ELSE 'modified' END AS change, n_raw FROM c WHERE NOT (begin = 1 AND top = 2)""",
    ),
)
def stream_coalesce(spark, sf):
    """Debounced changes of a stream whose rows come in any order: late ones join, extend and unite bursts."""
    base = _base(spark)
    m = F.col("event_id") % 3
    changes = S.ev(spark, sf).where("event_type = 'error'").select(
        F.concat(F.lit("f"), F.col("k").cast("string")).alias("path"), "at_us", "event_id", F.when(m == 0, "modified").when(m == 1, "created").otherwise("removed").alias("change")
    )
    runs = fold.burst_runs(replace(DEFAULTS, debounce=_QUIET))
    stream = fold.burst_rows(_fed(changes, base, 4, _mixed("event_id", 4)))
    _until_done(fold.fold_stream(stream, f"{base}/bursts", f"{base}/state", runs, slot_us=S.DAY_US, parts=2))
    return fold.settled(fold.stored(fold.run_table(spark, f"{base}/bursts"), runs))


@register(
    "stream_spans",
    with_sql(
        "fx",
        """
    WITH o AS (SELECT who, start_us, end_us, max(end_us) OVER (PARTITION BY who ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us - reach > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY who ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run FROM o)
    SELECT who, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_intervals FROM n GROUP BY who, run""",
    ),
)
def stream_spans(spark, sf):
    """Activity spans of a stream whose intervals come in any order, the last ones included."""
    base = _base(spark)
    parts = S.fx(spark, sf).select("who", "start_us", "end_us", "event_id")
    runs = fold.span_runs(replace(DEFAULTS, idle_gap=3600))
    stream = fold.span_rows(_fed(parts, base, 4, _mixed("event_id", 4)))
    _until_done(fold.fold_stream(stream, f"{base}/spans", f"{base}/state", runs, slot_us=S.DAY_US, parts=2))
    return fold.stored(fold.run_table(spark, f"{base}/spans"), runs).drop("slot", "part")


# --- committed tables ---------------------------------------------------------------------


@register(
    "logged_changes",
    with_sql(
        "chg",
        """SELECT event_id, CAST(root_id AS BIGINT) AS root_id, rel AS path, at_us, change, CASE WHEN event_id % 4 = 0 THEN 'you' ELSE 's' || (event_id % 7) END AS who,
      CASE WHEN event_id % 4 <> 0 THEN 'c' || event_id END AS call_id FROM chg""",
    ),
)
def logged_changes(spark, sf):
    """The change log written in four commits, one of them failed and repeated, merged into few files, and read back."""
    base, n = _base(spark), F.col("event_id")
    agent = n % 4 != 0
    changes = staged(
        S.chg(spark, sf).select(
            "root_id", "rel", "at_us", "change",
            F.when(agent, F.concat(F.lit("s"), (n % 7).cast("string"))).otherwise("you").alias("who"),
            F.when(agent, F.concat(F.lit("c"), n.cast("string"))).alias("call_id"),
            F.lit("bash").alias("tool"), F.lit("make").alias("input"), n.cast("string").alias("diff"),
        )
    )
    part = lambda i: changes.where(F.pmod(F.col("diff").cast("bigint"), F.lit(4)) == i)
    log = changelog.change_log(spark, f"{base}/log")
    changelog.write_change_log(part(0), log.path, 0)
    # A writer that stops before its commit, twice; then the batch comes again, and once more after its commit.
    for _ in range(2):
        log._write(changelog.log_lines(part(1)), 1)
    for batch in (1, 1, 2):
        changelog.write_change_log(part(batch), log.path, batch)
    log.compact()
    for batch in (2, 3):
        changelog.write_change_log(part(batch), log.path, batch)
    return changelog.read_change_log(spark, log.path).select(F.col("diff").cast("bigint").alias("event_id"), "root_id", "path", "at_us", "change", "who", "call_id")


@register(
    "reingested_transcripts",
    with_sql(
        "fx",
        """SELECT event_id, CAST(who AS VARCHAR) AS who, source, rel FROM fx WHERE who % 7 <> 3 OR source NOT IN ('tool', 'inferred')
    UNION ALL SELECT event_id, CAST(who AS VARCHAR), 'tool', 'again/' || rel FROM fx WHERE who % 7 = 3 AND event_id % 2 = 0""",
    ),
)
def reingested_transcripts(spark, sf):
    """Rewritten transcripts replace what they had given, in the partitions they lie in."""
    base = _base(spark)
    events = S.fx(spark, sf).select("event_id", F.col("who").cast("string").alias("who"), "source", "rel")
    table = Committed(spark, f"{base}/events", ("part",))
    table.append(flows.by_transcript(events), 0)
    again = events.where(F.col("who").cast("bigint") % 7 == 3)
    fresh = again.where("event_id % 2 = 0").withColumn("source", F.lit("tool")).withColumn("rel", F.concat(F.lit("again/"), "rel"))
    flows.reingest(table, 1, again.select("who").distinct(), fresh)
    return table.read().drop("part")


@register(
    "saved_events",
    with_sql(
        "fx",
        """SELECT event_id, CAST(root_id AS BIGINT) AS root_id, rel, start_us, end_us FROM fx WHERE source = 'tool' AND root_id IN (0, 2) AND start_us >= 1704844800000000 AND start_us < 1705536000000000""",
    ),
)
def saved_events(spark, sf):
    """File events saved by root and day; a week of two roots is read back from its own folders."""
    base = _base(spark)
    f = S.fx(spark, sf).select("event_id", F.col("who").cast("string").alias("who"), F.col("root_id").cast("bigint").alias("root_id"), "rel", "source", "start_us", "end_us")
    few = f.select("who").limit(0)
    spans = f.select("who", "start_us", "end_us")
    tables = store.Tables(*[{"file_events": f, "spans": spans}.get(n, few) for n in store.Tables.__dataclass_fields__])
    meta = store.Meta(("/logs",), ("/r0", "/r1", "/r2"), 30)
    store.save_model(tables, f"{base}/saved", meta)
    got = store.load_between(spark, f"{base}/saved", meta, "file_events", 1_704_844_800_000_000, 1_705_536_000_000_000, [0, 2])
    return got.select("event_id", "root_id", "rel", "start_us", "end_us")


@register(
    "attributed_stream",
    with_sql(
        "chg win",
        f"""
    WITH kept AS (SELECT * FROM chg c WHERE NOT EXISTS (SELECT 1 FROM fx w WHERE w.source = 'tool' AND w.kind = 'write' AND w.root_id = c.root_id
      AND w.rel = c.rel AND w.end_us BETWEEN c.at_us - 36000000000 AND c.at_us + 3600000000)),
    hit AS (SELECT c.event_id, c.root_id, c.rel, c.at_us, c.change, w.who, w.call_id,
      row_number() OVER (PARTITION BY c.event_id ORDER BY w.start_us DESC NULLS LAST, w.ord) AS n
      FROM kept c LEFT JOIN win w ON w.root_id = c.root_id AND c.at_us >= w.start_us - 60000000 AND c.at_us <= coalesce(w.end_us, {S.NOW_US}) + 480000000)
    SELECT CAST(root_id AS BIGINT) AS root_id, rel AS path, at_us, change, coalesce(CAST(who AS VARCHAR), 'you') AS who, CAST(call_id AS VARCHAR) AS call_id FROM hit WHERE n = 1""",
    ),
)
def attributed_stream(spark, sf):
    """Settled changes of a stream, attributed batch by batch and committed to the change log; read back after a restart."""
    base = _base(spark)
    f, w = S.fx(spark, sf), S.win(spark, sf)
    changes = S.chg(spark, sf).select(
        "event_id", F.concat(F.lit("/r"), F.col("root_id").cast("string"), F.lit("/"), F.col("rel")).alias("path"), "at_us", "change",
        (F.col("change") != "removed").alias("exists"), F.lit(None).cast("string").alias("content"),
    )
    windows = w.withColumns({"who": F.col("who").cast("string"), "call_id": F.col("call_id").cast("string")})
    none = spark.createDataFrame([], "scope_key string, rel string, at_us bigint, seq bigint, content string")
    tables = {
        "prefixes": root_prefixes(spark.createDataFrame([(0, "/r0"), (1, "/r1"), (2, "/r2")], "root_id int, path string")),
        "file_events": f,
        "windows": windows,
        "calls": windows.select("who", "call_id", F.lit("bash").alias("tool"), F.lit("").alias("input")),
        "snapshots": none,
    }
    p = Params(echo_before=36_000, echo_after=3_600, slack_start=60, slack_end=480)
    stream = _fed(changes, base, 3, _mixed("event_id", 3))
    _until_done(flows.attribute_stream(stream, lambda: tables, f"{base}/log", f"{base}/state", lambda: S.NOW_US, p=p))
    return changelog.read_change_log(spark, f"{base}/log").select("root_id", "path", "at_us", "change", "who", "call_id")


# --- chains ------------------------------------------------------------------------------------


@register(
    "participant_tops",
    """WITH RECURSIVE p AS (SELECT o_orderkey AS who, CASE WHEN o_orderkey % 97 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) END AS parent FROM orders),
    w AS (SELECT who, parent, who AS top, CAST(0 AS BIGINT) AS depth FROM p WHERE parent IS NULL
      UNION ALL SELECT p.who, p.parent, w.top, w.depth + 1 FROM p JOIN w ON p.parent = w.who)
    SELECT * FROM w""",
)
def participant_tops(spark, sf):
    """Chains of parents, hundreds of steps long, followed by doubling."""
    o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("who"), (F.col("o_custkey") % 5).alias("line"))
    numbered = ordered(o, ("line",), ("who",)).scan(_prev=previous("who"))
    pairs = numbered.df.select("who", F.when(F.col("who") % 97 != 0, F.col("_prev.v")).alias("parent"))
    return tops(pairs)
