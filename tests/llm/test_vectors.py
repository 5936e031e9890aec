"""Operator 13 against full search in plain integers, and its edge cases."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from text_helpers import SMALL, read

from tracelane.llm import vectors


def full_search(x, entries):
    return min(((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(entries)), default=(0, 0))


def plain(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector, label); everything by full search in Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    k = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    ints = [[math.floor(4096 * x) for x in v] + [0] * (k * parts - len(v)) for _, v, _ in kept]
    cut = [[v[p * k : (p + 1) * k] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds if k else 0):
        for p in range(parts):
            drawn = {}
            for c in cut:
                drawn.setdefault(full_search(c[p], books[p])[1], []).append(c[p])
            for e, mine in drawn.items():
                books[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = []
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [full_search(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, code, error, sums[label]) for i, label, code, error in out), key=str), digest


def run(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, error long, code string")
    coded, books = vectors.encode(df, **settings)
    got = sorted((tuple(r) for r in coded.select("vec_id", "code", "error", "label_error").collect()), key=str)
    return got, vectors.digest(books)


def f32(rng, n, d, scale=0.2):
    return (rng.standard_normal((n, d)) * scale).astype(np.float32).tolist()


def test_search_equals_full_search():
    rng = np.random.default_rng(1)
    for k, spread in ((1, 3), (2, 2), (8, 1000), (8, 3), (3, 1 << 27)):
        for m in (1, 2, 16):
            entries = rng.integers(-spread, spread + 1, (m, k))
            x = rng.integers(-spread, spread + 1, (300, k))
            index, distance = vectors.nearest(x, entries)
            for row, e, d in zip(x.tolist(), index.tolist(), distance.tolist(), strict=True):
                assert (d, e) == full_search(row, entries.tolist())


def test_equal_entries_and_equal_sums_go_to_the_lower_index():
    entries = np.array([[1, -1], [0, 0], [0, 0], [-1, 1], [2, -2]])
    index, distance = vectors.nearest(np.array([[0, 0], [1, -1], [-1, 1], [5, -5], [1, 0]]), entries)
    assert index.tolist() == [1, 0, 3, 4, 0] and distance.tolist() == [0, 0, 0, 18, 1]


def test_whole_table(spark):
    rows = read("embeddings", "vec_id, embedding, label")
    got = vectors.op13_vector_codes(spark, SMALL).collect()
    want, digest = plain(rows)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = f32(rng, 30, 16)
    rows = [(i, v, i % 3 if i % 4 else None) for i, v in enumerate(good)]
    rows += [(100, None, 1), (101, [None] * 16, 1), (102, [float("nan")] * 16, 1), (103, [float("inf"), *[0.0] * 15], 1), (104, [-float("inf")] * 16, None)]
    rows += [(None, good[3], None), (None, good[4], 7), (5, good[5], 2), (5, good[5], 2), (-3, [0.5] * 5, 1), (200, [], 1), (201, [-0.0001] * 16, 9)]
    assert run(spark, rows) == plain(rows)


def test_few_rows_and_odd_widths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v, 0) for i, v in enumerate(f32(rng, 5, 13))]
    assert run(spark, rows) == plain(rows)
    rows = [(i, v, 0) for i, v in enumerate(f32(rng, 40, 3))]
    assert run(spark, rows, entries=4, rounds=2) == plain(rows, entries=4, rounds=2)


def test_empty_inputs(spark):
    assert run(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    assert run(spark, [(1, None, 1)])[0] == []
    assert run(spark, [(1, [], 1), (2, [], None)])[0] == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]


def test_many_labels_beside_a_hot_one(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v, 0 if i % 3 == 0 else i) for i, v in enumerate(f32(rng, 1200, 8))]
    assert run(spark, rows) == plain(rows)


def test_far_components_count_as_the_bound(spark):
    rows = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]
    got, _ = run(spark, rows, entries=1, rounds=0)
    bound = vectors.limit(1)
    assert [r[2] for r in got] == [0, 8 * (2 * bound) ** 2, 8 * bound**2]
