"""Operator 6: toxicity by a convolutional text classifier, trained and run in numpy.

A word is the sum of hashed embeddings: its letters as a whole and its first three and five letters, so a form not
seen before still shares what its stem has. Filters of width 1, 2 and 3 run over the words of the whole text;
each filter's maximum feeds a logistic layer. One task trains on at most ``TRAIN_ROWS`` labelled rows
(those with the smallest hash of the id; a documented bound) and returns the weights, whose size is fixed.
All documents are scored once; the score's point 0.7 is where F1 is best on all labelled rows that are neither held
out nor among the four fifths that the network learned from; by language, the same rows give a threshold each, drawn
towards 0.7 by ``LEAN`` imagined rows, and 0.7 itself where none of them is toxic. The cuts come from histograms of
``BINS`` bins a logit.

Defined cases: null, empty or word-free texts get the score of an empty text; repeated rows get equal scores;
labels that are null or of unknown ids are ignored; without labels every score is 0; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm.common import WordCodes, table
from tracelane.session import staged

TRAIN_ROWS = 8000
BUCKETS, DIM = 1 << 15, 16
WIDTHS, FILTERS = (1, 2, 3), 12
EPOCHS, BATCH, RATE = 8, 32, 0.05
HIDDEN = 0.4
POINT = 0.7
LEAN = 200
#: Bins of the score histograms in a logit, which is cut off at ``FAR``.
BINS, FAR = 256, 100
SEED = 6

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def _parts(word: str) -> tuple[int, int, int]:
    """Embedding rows of a word; the row 0 of a missing part stays zero."""
    core = _EDGE.sub("", word)
    if not core:
        return 0, 0, 0
    code = lambda kind, s: 1 + xxhash.xxh32_intdigest(f"{kind}{s}") % (BUCKETS - 1)
    return code("w", core), code("3", core[:3]), code("5", core[:5])


def _words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Network:
    """Embedding table, filters and logistic layer."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.table = (draw.normal(0, 0.1, (BUCKETS, DIM))).astype(np.float32)
        self.table[0] = 0
        self.filters = [draw.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = draw.normal(0, 0.3, len(self.bias)).astype(np.float32)
        self.out_bias = np.float32(-2.0)

    def pooled(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: bool = False):
        """Maximum of each filter per document (and where it is). ``x`` holds the word vectors of all documents,
        each followed by ``max(WIDTHS) - 1`` zero rows."""
        best, at = [], []
        for k, f in enumerate(self.filters):
            n = len(x) - len(f) + 1
            y = x[:n] @ f[0]
            for j in range(1, len(f)):
                y += x[j : n + j] @ f[j]
            y += self.bias[k * FILTERS : (k + 1) * FILTERS]
            for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                part = y[a : min(b, n)]
                if where:
                    place = part.argmax(axis=0)
                    at.append((k, i, a + place))
                    best.append((k, i, part[place, np.arange(FILTERS)]))
                else:
                    best.append((k, i, part.max(axis=0)))
        out = np.zeros((len(starts), len(self.bias)), np.float32)
        for k, i, v in best:
            out[i, k * FILTERS : (k + 1) * FILTERS] = v
        return (out, at) if where else out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.out_bias


def _lay(docs: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all documents one after the other with zero rows between them; starts and ends."""
    gap = max(WIDTHS) - 1
    sizes = np.array([max(1, len(d)) for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
    rows = np.zeros((int((sizes + gap).sum()), width), np.int64)
    for d, s in zip(docs, starts, strict=True):
        if len(d):
            rows[s : s + len(d)] = d
    return rows, starts, starts + sizes


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> Network:
    """``docs``: (words, 3) embedding rows. Adagrad; only the words that won a filter get a gradient."""
    net, draw = Network(seed), np.random.default_rng(seed)
    memory: dict[str, np.ndarray] = {}

    def move(name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        seen = memory.setdefault(name, np.full_like(value, 1e-3))
        seen += gradient**2
        value -= RATE * gradient / np.sqrt(seen)

    table_seen = np.full(net.table.shape, 1e-3, np.float32)
    for _ in range(EPOCHS):
        order = draw.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            rows, starts, ends = _lay([docs[i] for i in picked], 3)
            # A part of a word is hidden now and then, so that no form is learned by heart.
            rows *= draw.random(rows.shape) >= HIDDEN
            x = net.table[rows].sum(axis=1)
            pooled, places = net.pooled(x, starts, ends, where=True)
            p = 1 / (1 + np.exp(-net.logits(pooled)))
            error = ((p - labels[picked]) / len(picked)).astype(np.float32)
            active = np.maximum(pooled, 0)
            back = error[:, None] * net.out[None, :] * (pooled > 0)
            filter_grad = [np.zeros_like(f) for f in net.filters]
            touched, grads = [], []
            for k, i, place in places:
                g = back[i, k * FILTERS : (k + 1) * FILTERS]
                on = np.flatnonzero(g)
                if not len(on):
                    continue
                for j in range(WIDTHS[k]):
                    here = place[on] + j
                    filter_grad[k][j][:, on] += x[here].T * g[on]
                    touched.append(here)
                    grads.append(net.filters[k][j][:, on].T * g[on, None])
            out_grad, bias_grad = active.T @ error, back.sum(axis=0)
            if touched:
                own = rows[np.concatenate(touched)]
                codes, back_to = np.unique(own.ravel(), return_inverse=True)
                total = np.zeros((len(codes), DIM), np.float32)
                np.add.at(total, back_to.reshape(own.shape), np.concatenate(grads)[:, None, :])
                total[codes == 0] = 0
                table_seen[codes] += total**2
                net.table[codes] -= RATE * total / np.sqrt(table_seen[codes])
            move("out", net.out, out_grad)
            move("bias", net.bias, bias_grad)
            for k in range(len(net.filters)):
                move(f"f{k}", net.filters[k], filter_grad[k])
            net.out_bias -= np.float32(RATE) * error.sum()
    return net


def _best_cut(bins: dict[int, tuple[int, int]]) -> float:
    """From (rows, toxic rows) by logit bin: the middle of the cut with the best F1; between the classes where they lie apart."""
    order = sorted(bins, reverse=True)
    rows, hits = np.cumsum([bins[k] for k in order], axis=0).T
    k = int(np.argmax(2 * hits / (rows + max(1, hits[-1]))))
    low = order[k + 1] if k + 1 < len(order) else order[k] - BINS
    return (order[k] + low + 1) / 2 / BINS


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = WordCodes(_parts)
    docs, labels, picks = [], [], []
    for batch in batches:
        for text, label, pick in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = _words(text)
            docs.append(np.array([codes[w] for w in found], np.int32).reshape(-1, 3))
            labels.append(label)
            picks.append(pick)
    order = sorted(range(len(docs)), key=lambda i: picks[i])  # the same model in every run
    docs, labels, picks = [docs[i] for i in order], np.array([labels[i] for i in order], np.float32), [picks[i] for i in order]
    if len(docs):
        learn = np.flatnonzero(np.arange(len(docs)) % 5 != 4)
        net = train([docs[i] for i in learn], labels[learn])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net, [picks[i] for i in learn]))], pa.binary())], names=["model"])


def _pick(id_col: Column) -> Column:
    return F.xxhash64(id_col.cast("string"), F.lit(SEED))


def fit(labelled: DataFrame) -> tuple | None:
    """Train on (id, text, label): network and the hashes of the ids that it learned from; None without any row."""
    found = labelled.where("label is not null").select("text", F.col("label").cast("int"), _pick(F.col("id")).alias("pick")).coalesce(1).mapInArrow(_fit, "model binary").collect()
    return pickle.loads(found[0][0]) if found else None


def cuts(scored: DataFrame, labelled: DataFrame, learned: list[int]) -> tuple[float, dict[str, float]]:
    """The cut and those by language, from all rows of (id, lang, logit) with a label in (id, label) that the network did not learn from.

    Where none of these is toxic, from all rows with a label.
    """
    spark = scored.sparkSession
    known = spark.createDataFrame([(p,) for p in learned], "pick long").withColumn("learned", F.lit(True))
    rows = scored.join(labelled.select("id", F.col("label").cast("int").alias("label")), "id").dropDuplicates(["id"]).withColumn("pick", _pick(F.col("id")))
    bins = F.floor(F.greatest(F.least("logit", F.lit(float(FAR))), F.lit(float(-FAR))) * BINS).cast("int").alias("bin")
    counted = rows.join(F.broadcast(known), "pick", "left").groupBy("lang", F.coalesce("learned", F.lit(False)).alias("learned"), bins).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).collect()
    if any(r.toxic for r in counted if not r.learned):
        counted = [r for r in counted if not r.learned]
    whole: dict[int, tuple[int, int]] = {}
    by_lang: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counted:
        for held in (whole, by_lang.setdefault(r.lang, {})):
            n, toxic = held.get(r.bin, (0, 0))
            held[r.bin] = n + r.n, toxic + r.toxic
    cut = _best_cut(whole) if whole else 0.0
    languages = {}
    for lang, held in by_lang.items():
        n, toxic = map(sum, zip(*held.values(), strict=True))
        if lang is not None and toxic:
            weight = n / (n + LEAN)
            languages[lang] = weight * _best_cut(held) + (1 - weight) * cut
    return cut, languages


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        place: dict[str, int] = {}
        vectors = np.zeros((1 << 12, DIM), np.float32)
        gap = max(WIDTHS) - 1

        def learn(words: set[str]) -> None:
            nonlocal vectors
            if len(place) + len(words) > 500_000:
                place.clear()
            while len(place) + len(words) + 1 > len(vectors):
                vectors = np.concatenate([vectors, np.zeros_like(vectors)])
            for w in words:
                place[w] = n = len(place) + 1
                vectors[n] = net.table[list(_parts(w))].sum(axis=0)

        def scores(texts: list) -> np.ndarray:
            docs = []
            split = [_words(t) for t in texts]
            unknown = set().union(*split).difference(place)
            if len(place) + len(unknown) > 500_000:
                place.clear()
                unknown = set().union(*split)
            if unknown:
                learn(unknown)
            for found in split:
                docs.append(np.fromiter(map(place.__getitem__, found), np.int64, len(found)))
            sizes = np.array([max(1, len(d)) for d in docs])
            starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
            ids = np.zeros(int((sizes + gap).sum()), np.int64)
            for d, s in zip(docs, starts, strict=True):
                ids[s : s + len(d)] = d
            return net.logits(net.pooled(vectors[ids], starts, starts + sizes))

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                if net is None:
                    logit = np.full(batch.num_rows, -np.inf)
                else:
                    logit = scores(batch.column(1).to_pylist()).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(logit, pa.float64())], names=["id", "lang", "logit"])

    return run


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> DataFrame:
    """One row per input row: ``held_out``, ``score``, ``predicted`` (score >= 0.7), the language's ``threshold`` and ``flagged``."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    learn = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label).alias("label")).dropDuplicates(["id"])
    chosen = learn.orderBy(_pick(F.col("id")), "id").limit(rows)
    net, learned = fit(plain.join(F.broadcast(chosen), "id").dropDuplicates(["id"])) or (None, [])  # ``rows`` ids at most
    shared = docs.sparkSession.sparkContext.broadcast(net)
    raw = staged(plain.select("id", "text", "lang").mapInArrow(_score(shared), "id long, lang string, logit double"))
    cut, languages = cuts(raw, learn, learned) if net else (0.0, {})
    shift = float(np.log(POINT / (1 - POINT))) - cut
    scored = raw.withColumn("score", 1 / (1 + F.exp(-(F.col("logit") + shift))))
    points = {k: float(1 / (1 + np.exp(-(v + shift)))) for k, v in languages.items()}
    threshold = F.lit(POINT)
    for k, v in sorted(points.items()):
        threshold = F.when(F.col("lang") == k, F.lit(v)).otherwise(threshold)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= POINT).cast("int").alias("predicted"), threshold.alias("threshold")).withColumn(
        "flagged", F.col("score") >= F.col("threshold")
    )


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


REGISTERED = {"op6_toxicity_cnn": (op6_toxicity_cnn, None)}
