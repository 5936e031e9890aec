"""Near-duplicate components against all pairs."""

from __future__ import annotations

import random

import numpy as np
from text_helpers import SMALL, docs, no_docs, odd_docs, read

from tracelane.llm import neardup as N
from tracelane.llm.graph import components


def sets_of(texts, size):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute(texts, size=5, percent=80):
    """(shingles, component, kept) per id from every pair."""
    sets, parent = sets_of(texts, size), {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table(spark):
    assert got(N.op8_minhash_near_duplicates(spark, SMALL)) == brute(dict(read("documents", "doc_id, text")), 2)


def test_crowd_of_near_copies_and_chains(spark):
    """A crowd whose members are near their base but often not near each other, a chain, and copies."""
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [draw.choice(vocabulary) for _ in range(120)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for at in draw.sample(range(120), draw.randint(1, 8)):
            copy[at] = draw.choice(vocabulary)
        texts.append(" ".join(copy))
    link = [draw.choice(vocabulary) for _ in range(100)]
    for step in range(12):
        link = link[: 100 - 8] if step % 2 else [*link, *[draw.choice(vocabulary) for _ in range(8)]]
        link[step] = "changed"
        texts.append(" ".join(link))
    texts += ["A  b C\td", "a b c d", "a B\nc d"] + [" ".join(draw.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    want = brute(dict(enumerate(texts, 1)), 2)
    assert len({c for _, c, _ in want.values()}) < len(texts) - 60
    block, N.BLOCK = N.BLOCK, 16  # buckets in pairs of blocks
    try:
        assert got(N.near_duplicates(docs(spark, *texts), 2)) == want
    finally:
        N.BLOCK = block


def test_estimates_follow_the_similarity():
    draw = np.random.default_rng(1)
    for wanted in (0.3, 0.8):
        errors = []
        for _ in range(40):
            all_codes = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
            shared = int(400 * wanted / (1 + wanted))
            x, y = np.unique(all_codes[:200]), np.unique(all_codes[200 - shared : 400 - shared])
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append((N.signature(x) == N.signature(y)).mean() - true)
        assert abs(np.mean(errors)) < 0.02


def test_pruning_spares_pairs_at_the_threshold():
    needed = N.least_matches(N.MISS, 80)
    draw = np.random.default_rng(5)
    same = draw.random((4000, N.HASHES)) < 0.8
    x = np.zeros((4000, N.HASHES), np.uint16)
    assert len(N._survivors(x, (~same).astype(np.uint16), needed)) == 4000
    far = draw.random((4000, N.HASHES)) < 0.5
    assert len(N._survivors(x, (~far).astype(np.uint16), needed)) == 0


def test_odd_rows(spark):
    rows = got(N.near_duplicates(odd_docs(spark)))
    assert rows[None] == (0, None, True) and rows[1] == (0, 1, True) and rows[2] == (0, 2, True) and rows[3] == (0, 3, True)
    assert rows[4] == (1, 4, True) and rows[5] == (1, 5, True) and len(rows) == 8
    kept = N.keep_one(odd_docs(spark))
    assert kept.count() == 9 and kept.columns == odd_docs(spark).columns
    assert N.near_duplicates(no_docs(spark)).count() == 0 and N.keep_one(no_docs(spark)).count() == 0
    assert [r.doc_id for r in N.keep_one(docs(spark, "a b c d e f", "other words are in here now", "A b c D e f")).orderBy("doc_id").collect()] == [1, 2]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (101, 100)]
    out = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
