"""Base rules against a plain count, and the estimate against numpy."""

from __future__ import annotations

import random
import re

import numpy as np
from text_helpers import DOCS, SMALL, docs, no_docs, odd_docs, read

from tracelane.llm import quality as Q


def counted(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows: dict = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_counts_of_whole_texts(spark):
    got = {r.doc_id: r for r in Q.op10_quality_outliers(spark, SMALL).collect()}
    texts = read("documents", "doc_id, text")
    assert len(got) == len(texts)
    for doc_id, text in texts:
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counted(text)
        assert not (r.base_failed and r.kept)


def test_good_documents_stay_and_bad_ones_go(spark):
    folder = SMALL.replace("0.001", "0.01")
    labels = dict(read("labels", "doc_id, quality", folder=folder))
    got = [(labels[r.doc_id], r.kept) for r in Q.op10_quality_outliers(spark, folder).where("NOT base_failed").collect() if r.doc_id in labels]
    assert all(kept for good, kept in got if good)
    assert sum(not kept for good, kept in got if not good) >= 0.9 * sum(not good for good, _ in got)


def test_distance_finds_the_odd_one(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 8))) for _ in range(900)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(80, 300))) + "." for _ in range(60)]
    texts.append(" ".join("#" + draw.choice(words) + "&&" for _ in range(150)))
    got = {r.doc_id: r for r in Q.judge(docs(spark, *texts)).collect()}
    assert [i for i, r in got.items() if not r.kept] == [61]
    assert got[61].distance2 > 2 * Q.CUTOFF


def test_inverse_of_the_covariance(spark):
    draw = np.random.default_rng(2)
    x = (draw.normal(size=(500, 6)) @ draw.normal(size=(6, 6)) * 300 + 1000).round()
    names = [f"m{i}" for i in range(6)]
    mean, second = x.mean(axis=0), x.T @ x / len(x)
    row = spark.createDataFrame([tuple([*map(float, mean), *[float(second[i, j]) for i, j in Q.PAIRS]])], ", ".join(f"{n} double" for n in [*names, *[f"c{i}_{j}" for i, j in Q.PAIRS]]))
    got = Q._estimate(row, []).first()
    cov = (second - np.outer(mean, mean)) * Q.CONSISTENT + np.diag([(Q.FLOORS[n] * Q.UNIT) ** 2 for n in Q.NAMES])
    low = np.zeros((6, 6))
    for i, j in Q.PAIRS:
        low[i, j] = got[f"v{i}_{j}"]
    assert np.allclose(low.T @ low, np.linalg.inv(cov), rtol=1e-6)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "STEPS", {"language": 1, "group": 1})
    got = Q.judge(odd_docs(spark)).collect()
    assert len(got) == 9 and not any(r.kept for r in got)
    kept = Q.filter_documents(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == 0
    assert Q.judge(no_docs(spark)).count() == 0 and Q.filter_documents(no_docs(spark)).count() == 0


def test_null_and_shared_ids_do_not_take_good_documents(spark):
    good = " ".join(f"word{i} and" for i in range(60))
    rows = [(None, good, "en", "s", 1), (None, "bad", "en", "s", 1), (None, None, "en", "s", 1), (7, "bad", "en", "s", 1), (7, good + " more", "en", None, 1), (8, good, "en", "s", 1), (8, good, "en", "s", 1), (9, "bad", None, None, 1)]
    df = spark.createDataFrame([(*r, *["x"] * 10) for r in rows], DOCS)
    kept = Q.filter_documents(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("None", good), ("7", good + " more"), ("8", good), ("8", good)])
