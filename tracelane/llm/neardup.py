"""Operator 8: MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives each document its shingle count, a digest of its shingle set and
   a MinHash signature (16-bit values). Documents of one digest are one class; from here on only the
   least id of a class takes part.
2. Signatures are cut into bands; equal bands are buckets. A pair at the threshold shares no bucket
   with probability ``(1 - t**ROWS)**BANDS`` (4.6e-7 at 0.8).
3. First round: each bucket has a hub, the member that meets the most others in all its buckets, and each
   document is paired with the hub that it meets most often. The links that hold join most of a crowd with
   one pair for each document.
4. What is left are members of one bucket that are not yet joined. Twice, every component is
   paired with its likeliest partner outside. Then every pair of one bucket that still lies in two
   components is decided, so no link is lost, and none is looked at that could join nothing.
   Buckets are compared inside tasks, those above ``BLOCK`` members as pairs of blocks.
5. All rounds compare signatures batch by batch and give a pair up as soon as the posterior probability
   (uniform prior) that its similarity reaches the threshold is below ``MISS``. Survivors are
   decided on the full shingle sets, so every link is exact.

Defined cases: a null or empty text, or one without words, has no shingles and links with nothing; a text
shorter than a shingle is one shingle; repeated rows of one id count once; null ids are kept and link with
nothing; an empty table gives an empty result; other columns are ignored (``near_duplicates``) or kept
(``keep_one``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm.common import WordCodes, table
from tracelane.llm.graph import components
from tracelane.session import staged

ROWS, BANDS = 6, 48
HASHES = ROWS * BANDS
BATCH = 32
MISS = 1e-7
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
PERCENT = 80

_MASK = (1 << 64) - 1
_rng = np.random.default_rng(8)
_MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def _word_code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def shingles(text: str | None, size: int, codes: dict) -> np.ndarray:
    """Sorted 64-bit codes of the distinct shingles of a text."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    code = np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))
    width = min(size, len(code))
    mixed = np.full(len(code) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + code[k : k + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(codes: np.ndarray) -> np.ndarray:
    """Minimum per hash function over the shingles, in pieces that fit the cache."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    half = (codes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(half), 512):
        value = half[at : at + 512, None] * _MULTIPLY
        value += _ADD
        np.minimum(low, value.min(axis=0), out=low)
    return ((low ^ (low >> np.uint32(16))) & np.uint32(0xFFFF)).astype(np.uint16)


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(_word_code)
        for batch in batches:
            out: list = [[], [], []]
            for text in batch.column(1).to_pylist():
                found = shingles(text, size, codes)
                out[0].append(len(found))
                out[1].append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                out[2].append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                names=["id", "n_shingles", "digest", "sig"],
            )

    return run


def least_matches(miss: float, percent: int) -> np.ndarray:
    """For each whole number of batches, the matches below which P(similarity >= t) < ``miss``.

    With a uniform prior and m matches among n, that probability is P(Binomial(n + 1, t) <= m).
    """
    t, needed = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
            if total >= miss:
                needed.append(m)
                break
    return np.array(needed)


def _survivors(x: np.ndarray, y: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Positions of the pairs (row i of ``x``, row i of ``y``) that no batch rules out."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), np.int32)
    for k, least in enumerate(needed):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (x[alive, cut] == y[alive, cut]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _prune_pairs(needed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = _survivors(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), needed)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], names=["a", "b"])

    return run


def _block_pairs(needed: np.ndarray, best: bool, percent: int):
    """Compare the members of a bucket (or two blocks of one) that lie in different components.

    ``best``: of each component only the likeliest partner outside it. Otherwise every pair that no
    batch rules out, once: in the first band that its members share, and only if the sets of
    32-bit shingle codes come within a hundredth of the threshold. Such codes collide too
    rarely to move a similarity that far.
    """

    def run(key: tuple, part: pa.Table) -> pa.Table:
        p, q = key[1].as_py(), key[2].as_py()
        part = part.combine_chunks()
        side, sig = np.asarray(part.column("own")), _matrix(part.column("sig"))
        ids, comp, band = np.asarray(part.column("id")), np.asarray(part.column("comp")), part.column("band")[0].as_py()
        first, second = np.flatnonzero(side == p), np.flatnonzero(side == q)
        sets = None if best else [np.frombuffer(c, np.uint32) for c in part.column("codes").to_pylist()]
        found: list[tuple] = []
        head = np.ascontiguousarray(sig[:, :BATCH])
        for at in range(0, len(first), 256):
            rows = first[at : at + 256]
            same = np.zeros((len(rows), len(second)), np.uint8)
            for k in range(BATCH):
                same += head[rows, k][:, None] == head[second, k][None, :]
            apart = (comp[rows][:, None] != comp[second][None, :]) & (ids[rows][:, None] < ids[second][None, :] if p == q else True)
            i, j = np.nonzero((same >= needed[0]) & apart)
            i, j = rows[i], second[j]
            for cut in range(0, len(i), 65536):
                x, y = i[cut : cut + 65536], j[cut : cut + 65536]
                alive = _survivors(sig[x], sig[y], needed)
                x, y = x[alive], y[alive]
                equal = sig[x] == sig[y]
                if not best:
                    new = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
                    new = np.flatnonzero(new)
                    new = new[[_close(sets[a], sets[b], percent - 1) for a, b in zip(x[new], y[new], strict=True)]] if len(new) else new
                    x, y, equal = x[new], y[new], equal[new]
                found.append(_likeliest(comp, x, y, equal.sum(axis=1)) if best else (comp[x], x, y, equal.sum(axis=1)))
        c, x, y, m = (np.concatenate(v) for v in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 4
        return pa.table({"comp": pa.array(c, pa.int64()), "a": pa.array(ids[x], pa.int64()), "b": pa.array(ids[y], pa.int64()), "m": pa.array(m, pa.int64())})

    return run


def _close(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _code_sets(size: int):
    """Sorted distinct 32-bit shingle codes of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(_word_code)
        for batch in batches:
            sets = [np.unique((shingles(t, size, codes) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "codes"])

    return run


def _likeliest(comp: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple:
    """For each component that a pair touches, its pair with the most matches."""
    owner, x, y, m = np.concatenate([comp[x], comp[y]]), np.tile(x, 2), np.tile(y, 2), np.tile(m, 2)
    order = np.lexsort((y, x, -m, owner))
    owner, x, y, m = owner[order], x[order], y[order], m[order]
    top = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    return owner[top], x[top], y[top], m[top]


def _decide(size: int, percent: int):
    """Exact similarity of pairs that carry both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(_word_code)
        last: tuple = (None, None)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            text_a, text_b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            held = []
            for k in range(len(a)):
                x = shingles(text_a[k], size, codes)
                if last[0] != b[k]:
                    last = (b[k], shingles(text_b[k], size, codes))
                y = last[1]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and 100 * common >= percent * (len(x) + len(y) - common):
                    held.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in held], pa.int64()), pa.array([b[k] for k in held], pa.int64())], names=["a", "b"])

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. Each pair brings in two texts."""
    of = lambda n: texts.select(F.col("id").alias(n), F.col("text").alias(f"text_{n}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_decide(size, percent), "a long, b long")


def _buckets(signed: DataFrame) -> DataFrame:
    """(key, band, id) per band of each document."""
    band = F.expr("substring(sig, cast(band * %d + 1 as int), %d)" % (2 * ROWS, 2 * ROWS))
    return signed.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select(F.xxhash64("band", band).alias("key"), "band", "id")


def _apart(crowds: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, in pairs of blocks."""
    placed = crowds.join(joined, "id", "left").select("key", "band", "id", "n", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = placed.join(mixed, "key").select("key", "band", "id", "comp", blocks.alias("blocks")).select("*", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"))
    dealt = left.select("key", "band", "id", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "band", "id", "comp", "own")


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after more links between members of known components, or of none."""
    root = lambda n: joined.select(F.col("id").alias(n), F.col("component").alias(f"root_{n}"))
    upper = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tops = staged(components(upper))
    moved = joined.join(tops.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return moved.unionByName(tops.join(joined, "id", "left_anti"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, miss: float = MISS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per id: ``n_shingles``, ``component_id`` (least id reachable over links) and ``kept``."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    raw = staged(plain.mapInArrow(_signed(size), "id long, n_shingles long, digest binary, sig binary"))
    needed = least_matches(miss, percent)

    linkable = raw.where("digest is not null and id is not null")
    leads = linkable.groupBy("digest").agg(F.min("id").alias("lead"))
    members = staged(linkable.select("id", "digest").join(leads, "digest").select("id", "lead").distinct())
    signed = staged(raw.select("id", "sig").join(members.where("id = lead").select("id").distinct(), "id").dropDuplicates(["id"]))

    rows = _buckets(signed)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowds = staged(rows.join(sizes, "key"))

    weight = crowds.groupBy("id").agg(F.sum("n").alias("weight"))
    hubs = crowds.join(weight, "id").groupBy("key").agg((-F.max(F.struct("weight", (-F.col("id")).alias("i"))).i).alias("hub"))
    met = crowds.join(hubs, "key").where("id != hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n"))
    led = met.groupBy(F.col("id").alias("a")).agg(F.max(F.struct("n", (-F.col("hub")).alias("h"))).alias("m")).select("a", (-F.col("m.h")).alias("b"))
    sig = lambda n: signed.select(F.col("id").alias(n), F.col("sig").alias(f"sig_{n}"))
    likely = led.join(sig("a"), "a").join(sig("b"), "b").mapInArrow(_prune_pairs(needed), "a long, b long")
    texts = staged(plain.where("id is not null").join(crowds.select("id").distinct(), "id").dropDuplicates(["id"]))
    joined = staged(components(_confirm(likely, texts, size, percent)))

    for best in (True, True, False):
        left = _apart(crowds, joined)
        if not best:
            left = staged(left)
            sets = texts.join(left.select("id").distinct(), "id").select("id", "text").mapInArrow(_code_sets(size), "id long, codes binary")
            left = left.join(sets, "id")
        pairs = left.join(signed, "id").groupBy("key", "p", "q").applyInArrow(_block_pairs(needed, best, percent), "comp long, a long, b long, m long")
        if best:
            pairs = pairs.groupBy("comp").agg(F.max(F.struct("m", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        joined = staged(_merged(joined, staged(_confirm(pairs.select("a", "b"), texts, size, percent))))

    named = members.join(joined.withColumnRenamed("id", "lead"), "lead", "left").select("id", F.coalesce("component", "lead").alias("component_id"))
    counts = raw.where("id is not null").groupBy("id").agg(F.max("n_shingles").alias("n_shingles"))
    whole = counts.join(named.groupBy("id").agg(F.min("component_id").alias("component_id")), "id", "left")
    lone = raw.where("id is null").select("id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = whole.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id")).unionByName(lone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that have a smaller near-duplicate group member; all columns stay, repeated rows of a kept id too."""
    found = near_duplicates(docs, size, percent, id_col=id_col, text=text).where(~F.col("kept")).select(F.col(id_col).alias("_gone"))
    return docs.join(found, docs[id_col].cast("long") == found["_gone"], "left_anti")


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


REGISTERED = {"op8_minhash_near_duplicates": (op8_minhash_near_duplicates, None)}
