"""Running values with and without blocks, and the operators on top against brute force."""

from __future__ import annotations

import random

import pytest
from helpers import rows, us
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelane.config import US, Params
from tracelane.operators import attribution as A
from tracelane.operators import intervals as I
from tracelane.operators import ordered as O
from tracelane.operators import sessions as Q
from tracelane.operators import timeline as T

SPLIT = 7  # rows per block: every key below is split into several blocks


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"k{i % 11}", rng.randrange(60), i, rng.choice([None, *range(20)])) for i in range(400)]
    data += [(None, 5, 1000 + i, i) for i in range(20)]
    return spark.createDataFrame(data, "k string, t bigint, id bigint, v bigint").repartition(5).cache()


def test_blocks_do_not_change_running_values(points):
    values = {
        "mx": O.running_max("v"),
        "mi": O.running_min("v", inclusive=True),
        "su": O.running_sum("v"),
        "sx": O.running_sum("v", inclusive=False),
        "la": O.running_last("v"),
        "fi": O.running_first("v"),
        "pr": O.previous("v"),
    }
    plain = O.ordered(points, ("k",), ("t", "id"))
    split = O.ordered(points, ("k",), ("t", "id"), SPLIT)
    assert not plain.split and split.split
    assert split.df.groupBy("k", O.BLOCK).count().agg(F.max("count")).first()[0] < 80
    names = ["k", "t", "id", *values]
    want = rows(plain.scan(**values).df, *names)
    assert rows(split.scan(**values).df, *names) == want
    w = Window.partitionBy("k").orderBy("t", "id")
    brute = points.select("k", "t", "id", F.lag("v").over(w).alias("p"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert rows(brute) == rows(split.scan(**values).df, "k", "t", "id", "pr.v", "su")


def test_blocks_over_the_whole_table(points):
    n = O.ordered(points, (), ("t", "id"), SPLIT).scan(n=O.running_sum(F.lit(1)))
    assert n.split
    got = [r[0] for r in n.df.orderBy("t", "id").select("n").collect()]
    assert got == list(range(1, points.count() + 1))
    few = O.ordered(points, (), ("t", "id"))
    assert not few.split and rows(few.scan(n=O.running_sum(F.lit(1))).df, "id", "n") == rows(n.df, "id", "n")


def test_ties_at_one_time_are_split_too(spark):
    same = spark.range(300).select(F.lit("k").alias("k"), F.lit(5).alias("t"), "id")
    split = O.ordered(same, ("k",), ("t", "id"), 20)
    assert split.df.select(O.BLOCK).distinct().count() > 5
    assert {(r.id + 1) == r.n for r in split.scan(n=O.running_sum(F.lit(1))).df.collect()} == {True}


def test_equal_rows_are_split_too(spark):
    same = spark.range(300).select(F.lit("k").alias("k"), F.lit(5).alias("t"))
    split = O.ordered(same, ("k",), ("t",), 20, copies=True)
    assert split.df.groupBy(O.BLOCK).count().agg(F.max("count")).first()[0] < 120
    crowd = same.select(F.lit("w").alias("who"), F.lit(10).alias("start_us"), F.lit(12).alias("end_us"))
    got = I.merge_intervals(crowd, ("who",), block_rows=20)
    assert [tuple(r) for r in got.collect()] == [("w", 10, 12, 300)]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("forward", [True, False])
def test_latest_before(spark, points, strict, forward):
    probes = points.where("id % 2 = 0").select("k", F.col("t").alias("at"), "id")
    history = points.where("id % 2 = 1").select("k", F.col("t").alias("h"), F.col("id").alias("seq"))
    got = {}
    for size in (None, SPLIT):
        out = O.latest_before(probes, history, ("k",), "at", "h", F.struct("h", "seq"), seq=F.col("seq"), strict=strict, forward=forward, block_rows=size)
        got[size] = {r.id: tuple(r.found) if r.found else None for r in out.collect()}
    hist = [tuple(r) for r in history.collect()]
    want = {}
    for p in probes.collect():
        sign = -1 if forward else 1
        ok = [(h * sign, s, h) for k, h, s in hist if k == p.k and (h * sign < p.at * sign or (not strict and h == p.at))]
        best = max(ok, default=None)
        want[p.id] = (best[2], best[1]) if best else None
    assert got[None] == got[SPLIT] == want


def merged(intervals, gap):
    out = []
    for s, e in sorted((min(a, b), max(a, b)) for a, b in intervals):
        if out and s - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("size", [None, SPLIT])
@pytest.mark.parametrize("gap", [0, 3])
def test_merge_intervals(spark, gap, size):
    rng = random.Random(2)
    data = [("a" if i % 4 else "b", s := rng.randrange(3000), s + rng.randrange(-2, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "who string, start_us bigint, end_us bigint")
    got = I.merge_intervals(df, ("who",), gap=gap, block_rows=size)
    want = [(w, *x) for w in "ab" for x in merged([d[1:] for d in data if d[0] == w], gap)]
    assert sorted(map(tuple, got.select("who", "start_us", "end_us").collect())) == want
    assert got.agg(F.sum("n_intervals")).first()[0] == len(data)


def test_merge_boundaries(spark):
    for step, n in ((29, 1), (30, 1), (31, 2)):
        df = spark.createDataFrame([("w", 0, 0), ("w", step, step)], "who string, start_us bigint, end_us bigint")
        assert I.merge_intervals(df, ("who",), gap=30).count() == n


def test_turns_and_generations(spark):
    # A start at 0 and 50, ends at 5... : records at 0 1* 5 end, 10 outside, ...
    recs = [(0, "start"), (1, None), (5, "end"), (10, "start"), (12, "end"), (50, "start"), (55, None)]
    df = spark.createDataFrame([("w", us(t), i, m) for i, (t, m) in enumerate(recs)], "who string, at_us bigint, line_no bigint, marker string")
    steps = I.turn_intervals(df)
    assert rows(I.merge_intervals(steps, ("who",), gap=0), "start_us", "end_us") == [(us(0), us(5)), (us(10), us(12)), (us(50), us(55))]
    # The clock of an entry may run back; then nothing counts until it has caught up.
    gen = [(10, True), (5, True), (8, False), (9, True), (11, True)]
    df = spark.createDataFrame([("w", us(t), i, a) for i, (t, a) in enumerate(gen)], "who string, at_us bigint, line_no bigint, is_assistant boolean")
    assert rows(I.generation_intervals(df), "start_us", "end_us") == [(us(10), us(11))]


@pytest.mark.parametrize("size", [None, SPLIT])
def test_attribution_against_brute_force(spark, size):
    rng = random.Random(3)
    windows = []
    for i in range(120):
        s = rng.choice([rng.randrange(5000), 1000])  # many equal starts
        e = rng.choice([None, s + rng.randrange(300), s + rng.randrange(4000), s])
        windows.append((f"w{i % 5}", f"c{i}", rng.choice([0, 1, None]), s, e, i))
    changes = [(i, rng.randrange(2), rng.randrange(-20, 6000)) for i in range(300)]
    wdf = spark.createDataFrame(windows, "who string, call_id string, root_id bigint, start_us bigint, end_us bigint, ord bigint")
    cdf = spark.createDataFrame(changes, "event_id bigint, root_id bigint, at_us bigint")
    now, a, b = 5500, 7, 11
    got = A.attribute(cdf, wdf, now, a, b, nullable_root=True)
    want = {}
    for i, root, at in changes:
        ok = [w for w in windows if w[2] in (root, None) and w[3] - a <= at <= (now if w[4] is None else w[4]) + b]
        best = max(ok, key=lambda w: (w[3], -w[5]), default=None)
        want[i] = best[1] if best else None
    assert {r.event_id: r.call_id for r in got.collect()} == want
    del size


def test_attribution_slack_boundaries(spark):
    w = spark.createDataFrame([("s", "c", 0, us(100), us(110), 1)], "who string, call_id string, root_id bigint, start_us bigint, end_us bigint, ord bigint")
    cases = {us(99) - 1: None, us(99): "c", us(118): "c", us(118) + 1: None}
    c = spark.createDataFrame([(i, 0, at) for i, at in enumerate(cases)], "event_id bigint, root_id bigint, at_us bigint")
    got = {r.at_us: r.call_id for r in A.attribute(c, w, us(500)).collect()}
    assert got == cases


@pytest.mark.parametrize("size", [None, SPLIT])
def test_echoes(spark, size):
    rng = random.Random(4)
    writes = [(0, "hot" if i % 3 else "b", rng.randrange(4000)) for i in range(100)]
    changes = [(i, 0, "hot" if i % 4 else "b", rng.randrange(4000)) for i in range(150)]
    wdf = spark.createDataFrame(writes, "root_id bigint, rel string, end_us bigint")
    cdf = spark.createDataFrame(changes, "event_id bigint, root_id bigint, rel string, at_us bigint")
    got = A.suppress_echoes(cdf, wdf, before_us=20, after_us=5, block_rows=size)
    want = {i for i, r, p, at in changes if not any(w[1] == p and at - 20 <= w[2] <= at + 5 for w in writes)}
    assert {r.event_id for r in got.collect()} == want


def test_echo_boundaries(spark):
    w = spark.createDataFrame([(0, "a", us(100))], "root_id bigint, rel string, end_us bigint")
    at = {us(99) - 1: True, us(99): False, us(110): False, us(110) + 1: True}
    c = spark.createDataFrame([(i, 0, "a", t) for i, t in enumerate(at)], "event_id bigint, root_id bigint, rel string, at_us bigint")
    kept = {r.at_us for r in A.suppress_echoes(c, w).collect()}
    assert kept == {t for t, keep in at.items() if keep}


@pytest.mark.parametrize("size", [None, SPLIT])
def test_nearest_and_nth(spark, size):
    rng = random.Random(5)
    items = [("hot" if i % 4 else "b", i, rng.randrange(40 * US)) for i in range(120)]
    probes = [("hot" if i % 3 else "b", i, rng.randrange(45 * US)) for i in range(60)]
    idf = spark.createDataFrame(items, "who string, event_id bigint, end_us bigint")
    pdf = spark.createDataFrame(probes, "who string, probe_id bigint, at_us bigint")
    got = {r.probe_id: r.event_id for r in Q.nearest(idf, pdf, block_rows=size).collect()}
    want = {}
    for who, i, at in probes:
        own = sorted((x for x in items if x[0] == who), key=lambda x: (-x[2], x[1]))
        want[i] = min(own, key=lambda x: abs(x[2] - at) // US)[1]
    assert got == want
    times = idf.select("who", F.col("end_us").alias("at_us"))
    for forward in (True, False):
        got = {r.probe_id: r.target_us for r in Q.nth_activity(times, pdf, 5, forward, block_rows=size).collect()}
        want = {}
        for who, i, at in probes:
            own = sorted({x[2] for x in items if x[0] == who})
            side = [t for t in own if t > at] if forward else [t for t in reversed(own) if t < at]
            if side:
                want[i] = side[:5][-1]
        assert got == want


# --- time grid -------------------------------------------------------------------------

BASE = 1_699_999_980


def activity(spark, *pairs):
    return spark.createDataFrame([(BASE + a, BASE + b) for a, b in pairs], "start_s bigint, end_s bigint")


def test_gap_threshold(spark):
    # Five idle columns stay, six collapse.
    assert T.idle_gaps(activity(spark, (0, 59), (360, 419)), 60).count() == 0
    got = rows(T.idle_gaps(activity(spark, (0, 59), (420, 479)), 60))
    g = BASE // 60
    assert got == [(g + 1, g + 7, 0)]


def test_display_and_back(spark):
    act = activity(spark, (0, 59), (420, 479), (2000, 2100))
    gaps = T.idle_gaps(act, 60)
    g0 = BASE // 60
    grid = spark.range(g0 - 3, g0 + 45).select(F.col("id").alias("g"))
    cols = T.display_cols(grid, gaps)
    shown = {r.g - g0: r.d - g0 for r in cols.collect()}
    assert shown[0] == 0 and shown[1] == 1 and shown[2] == 2 and shown[5] == 2 and shown[6] == 3 and shown[7] == 4
    back = {r.d - g0: (r.type, (r.start_s - g0 * 60) // 60, (r.end_s - g0 * 60) // 60) for r in T.column_ranges(cols, gaps, 60).collect()}
    assert back[0] == ("time", 0, 1) and back[1] == ("pad", 1, 2) and back[2] == ("break", 1, 7) and back[3] == ("pad", 6, 7)
    # Every grid column lies in what its display column shows.
    for g, d in shown.items():
        _, lo, hi = back[d]
        assert lo <= g < hi


def test_fit(spark):
    act = spark.createDataFrame([(0, 600), (259_200, 259_800)], "start_s bigint, end_s bigint")
    assert T.fit_width(act, None, None, 100).first()[0] == 15
    assert T.fit_width(act, None, None, 100, collapse=False).first()[0] == 3600
    assert T.fit_width(act, None, None, 1).first()[0] == 86400


def test_activity_union(spark):
    ev = spark.createDataFrame([(us(0), us(20)), (us(420), us(470))], "start_us bigint, end_us bigint")
    sp = spark.createDataFrame([(us(15), us(50)), (us(430), us(480))], "start_us bigint, end_us bigint")
    pr = spark.createDataFrame([(us(480),)], "at_us bigint")
    base = us(0) // US
    got = sorted((a - base, b - base) for a, b in I.activity_union(ev, sp, pr).collect())
    assert got == [(0, 50), (420, 480)]


def test_grid_floors_before_the_epoch(spark):
    df = spark.createDataFrame([(-1,), (0,), (59_999_999,), (60_000_000,)], "at_us bigint")
    assert [r.grid for r in T.time_grid(df, 60).collect()] == [-1, 0, 0, 1]


def test_coalesce_quiet_period(spark):
    for step, n in ((4.999999, 1), (5, 2)):
        df = spark.createDataFrame([(1, "a", us(0), "modified"), (2, "a", us(step), "removed")], "event_id bigint, path string, at_us bigint, change string")
        assert A.coalesce_changes(df, ("path",)).count() == n
    made = spark.createDataFrame([(1, "a", us(0), "created"), (2, "a", us(1), "removed"), (3, "a", us(2), "created")], "event_id bigint, path string, at_us bigint, change string")
    assert A.coalesce_changes(made, ("path",)).count() == 0


def test_raster_and_lanes(spark):
    ev = spark.createDataFrame(
        [(1, "a", us(0), us(60), "read"), (2, "b", us(10), us(20), "write"), (3, "c", us(15), us(20), "write")],
        "event_id bigint, who string, start_us bigint, end_us bigint, kind string",
    )
    b0 = us(0) // (60 * US)
    got = {r.bucket - b0: (r.who, r.is_write) for r in T.gantt_nodes(ev.withColumn("rel", F.lit("n")), 60).collect()}
    # Equal ends: the earlier event. Ending on a column's first instant still touches it.
    assert got == {0: ("b", 1), 1: ("a", 0)}
    people = spark.createDataFrame([("m", "m"), ("s", "m")], "who string, main string")
    spans = spark.createDataFrame([("s", us(0), us(30)), ("m", us(70), us(80)), ("s", us(70), us(80))], "who string, start_us bigint, end_us bigint")
    prompts = spark.createDataFrame([(us(60),)], "at_us bigint")
    mine = spark.createDataFrame([(us(0), us(60))], "start_us bigint, end_us bigint")
    got = {(r.who, r.bucket - b0): r.mark for r in T.gantt_lanes(spans, prompts, mine, people, 60).collect()}
    assert got == {("s", 0): 2, ("m", 0): 1, ("m", 1): 2, ("s", 1): 2, ("you", 0): 2, ("you", 1): 3}


def test_dyadic_cells_make_up_their_columns(spark):
    import random

    draw = random.Random(1)
    spans = [(a, a + n) for a in (-9, -8, -1, 0, 1, 7, 8) for n in range(20)] + [(a := draw.randint(-(1 << 40), 1 << 40), a + draw.randint(0, 1 << 30)) for _ in range(50)]
    df = spark.createDataFrame(spans, "a bigint, b bigint")
    for r in df.select("a", "b", T.dyadic_cells(F.col("a"), F.col("b")).alias("c")).collect():
        parts = sorted((x.cell << x.level, (x.cell + 1 << x.level) - 1) for x in r.c)
        assert parts[0][0] == r.a and parts[-1][1] == r.b
        assert all(y[0] == x[1] + 1 for x, y in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * (r.b - r.a + 1).bit_length()


def test_a_long_interval_costs_few_rows_and_shows_every_column(spark):
    month = 30 * 86_400
    df = spark.createDataFrame([("x", us(5), us(month)), ("y", us(100), us(101)), ("z", us(-40), us(12))], "who string, start_us bigint, end_us bigint")
    assert T.cover(df.where("who = 'x'"), 10).count() <= 40
    b0 = us(0) // (10 * US)
    got = {r.bucket - b0: (r.n, r.people) for r in T.overlap_counts(df.withColumn("k", F.lit(1)), ("k",), "who", 10).collect()}
    assert got == {b: (1 + (b == 10) + (b < 2), 1 + (b == 10) + (b < 2)) if b >= 0 else (1, 1) for b in range(-4, month // 10 + 1)}
    few = T.overlap_totals(df, 10, b0 + 9, b0 + 11)
    assert {r.bucket - b0: r.n for r in few.collect()} == {9: 1, 10: 2, 11: 1}


def test_tops_of_chains_and_cycles(spark):
    from tracelane.sources.participants import tops

    n = 10_000
    chain = [(f"c{i:05d}", f"c{i - 1:05d}" if i else None) for i in range(n)]
    cycle = [("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("a-tail", "z2"), ("a-tail2", "a-tail"), ("self", "self"), ("alone", None), ("orphan", "nowhere")]
    got = {r.who: (r.top, r.depth) for r in tops(spark.createDataFrame(chain + cycle, "who string, parent string")).collect()}
    assert all(got[f"c{i:05d}"] == ("c00000", i) for i in range(n))
    assert {w: got[w] for w, _ in cycle} == {
        "z1": ("z1", None), "z2": ("z1", None), "z3": ("z1", None), "a-tail": ("z1", None), "a-tail2": ("z1", None),
        "self": ("self", None), "alone": ("alone", 0), "orphan": ("orphan", 0),
    }


def test_recency_and_status(spark):
    seen = [80, 10, 20, 30, 40, 50, 60, 70]
    df = spark.createDataFrame([(f"s{i}", us(0), us(t), None) for i, t in enumerate(seen)], "session string, start_us bigint, last_seen_us bigint, end_us bigint")
    order = [r.session for r in Q.recency(df).orderBy("rank").collect()]
    assert order == ["s0", "s7", "s6", "s5", "s4", "s3", "s2", "s1"]
    for age, status in ((119.999, "live"), (120, "ended")):
        one = df.where("session = 's0'")
        assert Q.session_status(one, us(80 + age)).first().status == status
    assert Params().live_within == 120
