"""Operator 13: vector codes by product quantisation, with equal-average search for the nearest entry.

Components become integers, so every sum, distance and tie is exact and no result depends on the order of rows. A
vector is cut into ``PARTS`` parts; each part position has a codebook, begun with the parts of the smallest ids and
improved in ``ROUNDS`` rounds. A round is one pass over the written integers: tasks assign their rows and give one sum
per (part, entry, component), Spark adds these up, and what comes back is as large as the codebooks.

Equal-average search: the squared distance of two parts of k components is at least the squared difference of their
component sums over k. Entries are sorted by their sum; from the place of a part's own sum the search goes outward,
nearer sum first, and ends when that bound strictly exceeds the best distance. Ties go to the lower index. Many rows
move outward together, and those that are done leave.

Defined cases: vectors that are null or hold null or non-finite components are dropped; shorter ones than the widest
(rounded up to a multiple of ``PARTS``) count as padded with zeros; a scaled component beyond ``limit(k)``
(32,768 before scaling, for parts of up to 8 components) counts as that bound, so that all sums fit a long; null ids come
last; equal ids are ordered by their vectors; fewer rows than entries make a smaller codebook; null labels belong
together; an error sum beyond a long is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm.common import table
from tracelane.session import staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
ROWS = 4096
#: A label with at least this share of the rows counts as hot; so there are at most as many hot labels.
HOT_LABELS = 256


def limit(k: int) -> int:
    """The largest component for parts of ``k``: squared sums of two parts' differences stay below 2^62."""
    return min(1 << 27, (1 << 30) // max(k, 1))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of the nearest entry and the squared distance, by equal-average search."""
    n, k = x.shape
    m = len(entries)
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    own = x.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    far = np.int64(1) << 62
    best, index = np.full(n, far), np.full(n, m)
    rows = np.arange(n)
    while len(rows):
        below = np.where(left[rows] >= 0, own[rows] - sums[np.maximum(left[rows], 0)], far)
        above = np.where(right[rows] < m, sums[np.minimum(right[rows], m - 1)] - own[rows], far)
        gap = np.minimum(below, above)
        open_ = gap < far
        # gap * gap > best * k, where best is known; nothing is known yet of rows whose index is m.
        open_[open_] = (index[rows[open_]] == m) | (gap[open_] * gap[open_] <= np.where(index[rows[open_]] == m, 0, best[rows[open_]]) * max(k, 1))
        rows, down = rows[open_], (below <= above)[open_]
        entry = order[np.where(down, left[rows], right[rows])]
        left[rows] -= down
        right[rows] += ~down
        gaps = x[rows] - entries[entry]
        distance = np.einsum("ij,ij->i", gaps, gaps)
        better = (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = distance[better], entry[better]
    return index, best


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integers by row) of at most ``ROWS`` rows each."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield at, part.column(part.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, width)


def _sums(books: np.ndarray):
    """Per task: how many parts each entry drew, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, k = books.shape
        total, count = np.zeros((parts, entries, k), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, block in _blocks(batch, parts * k):
                for p in range(parts):
                    x = block[:, p * k : (p + 1) * k]
                    index, _ = nearest(x, books[p])
                    for e in np.unique(index):
                        mine = x[index == e]
                        total[p, e] += mine.sum(axis=0)
                        count[p, e] += len(mine)
        used = [(p, e, at, int(total[p, e, at]), int(count[p, e])) for p in range(parts) for e in range(entries) if count[p, e] for at in range(k)]
        columns = list(zip(*used, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "at", "total", "n"])

    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, k = books.shape
        for batch in batches:
            codes, errors = [], np.zeros(batch.num_rows, np.int64)
            for at, block in _blocks(batch, parts * k):
                found = np.zeros((len(block), parts), np.uint8)
                for p in range(parts):
                    index, distance = nearest(block[:, p * k : (p + 1) * k], books[p])
                    found[:, p] = index
                    errors[at : at + len(block)] += distance
                digits = found.tobytes().hex()
                codes += [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "v"]
            arrays = [batch.column(i) for i in kept] + [pa.array(codes, pa.string()), pa.array(errors)]
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in kept] + ["code", "error"])

    return run


def integers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """The kept vectors as integers of one width, written; and the components of a part."""
    v = F.col("x")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("x")).where(good)
    widest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    k = -(-widest // parts)
    bound = F.lit(limit(k))
    scaled = F.transform(v, lambda c: F.greatest(F.least(F.floor(c * SCALE), bound), -bound).cast("int"))
    padded = F.concat(scaled, F.array_repeat(F.lit(0), F.lit(parts * k) - F.size(v)))
    return staged(kept.select("id", "label", padded.alias("v"))), k


def codebooks(rows: DataFrame, k: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The entries, as an array (part, entry, component)."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, k).transpose(1, 0, 2).copy()
    if not len(first) or not k:
        return books
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sums(books), "part long, entry long, at long, total long, n long")
        # At most one row per component of the codebooks.
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_sums(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``. Rows of hot labels take it from a broadcast of at most ``HOT_LABELS`` rows; the others are joined by label."""
    totals = staged(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    everything = totals.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_LABELS >= everything
    few = F.broadcast(totals.where(hot).select(F.col("label").alias("hot_label"), F.col("label_error").alias("hot_error"), F.lit(True).alias("hot")))
    rest = totals.where(~hot).select(F.col("label").alias("cold_label"), F.col("label_error").alias("cold_error"), F.lit(0).alias("cold_salt"))
    marked = coded.join(few, F.col("label").eqNullSafe(F.col("hot_label")), "left")
    # Rows that need nothing from the second join are dealt out evenly.
    marked = marked.withColumn("salt", F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("id", "code"), F.lit(4096))).otherwise(0).cast("int"))
    both = marked.join(rest, F.col("label").eqNullSafe(F.col("cold_label")) & (F.col("salt") == F.col("cold_salt")), "left")
    return both.select(*coded.columns, F.when(F.col("hot"), F.col("hot_error")).otherwise(F.col("cold_error")).alias("label_error"))


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """One row per kept vector (id, label, code, error, label_error), and the codebooks. ``entries`` is 256 at most."""
    rows, k = integers(vectors, id_col, vec_col, label_col, parts)
    books = codebooks(rows, k, parts, entries, rounds)
    kinds = dict(rows.dtypes)
    coded = staged(rows.mapInArrow(_codes(books), f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    return with_label_sums(coded).withColumnsRenamed({"id": id_col, "label": label_col}), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by full search: every round is one table of assignments and one of entries."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, vec_id, label, p, x, e, d FROM (
  SELECT r, vec_id, label, parts.p, x, e, d, row_number() OVER (PARTITION BY r, parts.p ORDER BY d, e) AS n
  FROM parts JOIN c{i} ON c{i}.p = parts.p, LATERAL (SELECT CAST(coalesce(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS BIGINT) AS d)) WHERE n = 1)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.p, c{i}.e, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
  SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS c FROM (SELECT p, e, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, (SELECT k FROM size) + 1)) AS j) GROUP BY p, e, j) GROUP BY p, e) AS m
  ON m.p = c{i}.p AND m.e = c{i}.e)"""
            )
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT max(len(v)) // {PARTS} AS k FROM kept),
parts AS MATERIALIZED (SELECT r, vec_id, label, p, v[p * k + 1 : (p + 1) * k] AS x FROM kept, size, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES}),
{', '.join(steps)},
coded AS (SELECT r, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM coded
"""


REGISTERED = {"op13_vector_codes": (op13_vector_codes, _oracle())}
