"""Operator 9: benchmark passages in documents, by q-gram counts in diagonal bands.

Texts are compared lower-cased with each run of white space as one space. A region of a document matches
an item of m characters if it is within ``k = m * PERCENT / 100`` edits of the whole item. An alignment
with k edits keeps at least ``m + 1 - q * (k + 1)`` of the item's q-grams, and their diagonals (position in
the document less position in the item) span at most k. So:

1. every q-gram of a document is looked up in the items' q-grams (first in a bit table);
2. hits are counted per item in diagonal bands of width 2w, w = k + 1, that overlap by half: a span of
   up to k + 1 diagonals always lies inside one band, whole;
3. bands with enough hits inside a window of m + k positions are kept;
4. an alignment on the diagonals up to k beside the hits of each band (item whole, text free at both ends), decides and gives
   the exact ends. It holds one row of the band at a time: m steps over 2k + 1 diagonals, and those between its hits.

The items are the stated set that all documents are compared with. They go to the workers in blocks of at
most ``BLOCK_CHARS`` characters (one pass over the documents for each), so memory has a bound.

Defined cases: null or empty texts match nothing, nor do items shorter than ``MIN_ITEM`` characters after
normalising (they name no passage); below 71 characters fewer edits than ``PERCENT`` are allowed, (m + 1) // q - 2;
parts of an item are no match; repeated items give the least id, null last; repeated rows are searched as often as they come;
empty tables give empty results; other columns are ignored (``matches``) or kept (``clean``).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm.common import table

Q = 8
PERCENT = 10
MIN_ITEM = 40
BLOCK_CHARS = 2_000_000
#: Cells of the bands that are aligned together.
CELLS = 1 << 18
_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, item_id long, start long, end long, edits long"


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[0xC0:0xDF] += 32
_FOLD[0xD7] = 0xD7
_FOLD[[9, 10, 11, 12, 13, 0xA0]] = 32


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and where each one comes from."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _FOLD.take(raw, mode="clip")
    if raw.max(initial=0) > 255:
        low = np.where(raw < 256, low, raw)
    space = low == 32
    double = space[1:] & space[:-1]
    if not double.any():
        return low, np.arange(len(low))
    at = np.flatnonzero(~np.concatenate([[False], double]))
    return low[at], at


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit code of each q-gram."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    pair = codes[:-1].astype(np.uint64) * np.uint64(0x1F123BB5) + codes[1:]
    four = pair[:-2] * _BASE + pair[2:]
    eight = (four[:-4] ^ (four[:-4] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + four[4:]
    return eight ^ (eight >> np.uint64(29))


class Items:
    """The q-grams of a block of items, sorted, with a bit table in front."""

    def __init__(self, rows: list[tuple[int, str]], percent: int):
        self.ids, self.codes, self.edits = [], [], []
        seen = set()
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            codes = normalised(text.strip())[0]
            if len(codes) >= MIN_ITEM and codes.tobytes() not in seen:
                seen.add(codes.tobytes())
                self.ids.append(item_id)
                self.codes.append(codes)
                # The count bound must stay above zero.
                self.edits.append(min(len(codes) * percent // 100, (len(codes) + 1) // Q - 2))
        found = [grams(c) for c in self.codes]
        sizes = [len(g) for g in found]
        keys = np.concatenate(found) if found else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(found)), sizes)
        place = np.concatenate([np.arange(n) for n in sizes]) if found else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[keys & np.uint64((1 << _BITS) - 1)] = True
        self.edit = np.array(self.edits, np.int64)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.least = self.length + 1 - Q * (self.edit + 1)

    def bands(self, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By item, the bands in which enough of its q-grams lie close together: first and last diagonal of their hits."""
        keys = grams(codes)
        at = np.flatnonzero(self.bits[keys & np.uint64((1 << _BITS) - 1)])
        if not len(at):
            return {}
        key = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        real = self.keys[key] == keys[at]
        at, key = at[real], key[real]
        lo, n = self.first[key], self.count[key]
        if not len(at):
            return {}
        hit = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item = self.owner[hit]
        enough = np.bincount(item, minlength=len(self.length)) >= self.least
        if not enough.any():
            return {}
        kept = enough[item]
        pos, item, place = np.repeat(at, n)[kept], item[kept], self.place[hit[kept]]
        diagonal = pos - place
        half = self.edit[item] + 1
        band = np.floor_divide(diagonal, half)
        # Each hit counts in the two overlapping bands that cover its diagonal.
        item, pos, diagonal = np.tile(item, 2), np.tile(pos, 2), np.tile(diagonal, 2)
        band = np.concatenate([band, band - 1])
        order = np.lexsort((pos, band, item))
        item, pos, band, diagonal = item[order], pos[order], band[order], diagonal[order]
        group = np.concatenate([[0], np.cumsum((np.diff(item) != 0) | (np.diff(band) != 0))])
        least = self.least[item]
        last = np.arange(len(item)) + least - 1
        ok = last < len(item)
        last = np.minimum(last, len(item) - 1)
        # As many hits as the bound asks for, within a window of the item's length and its edits.
        ok &= (group[last] == group) & (pos[last] - pos <= self.length[item] + self.edit[item])
        if not ok.any():
            return {}
        edges = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
        first, final = np.minimum.reduceat(diagonal, edges), np.maximum.reduceat(diagonal, edges)
        found: dict[int, set[tuple[int, int]]] = {}
        for g in np.unique(group[ok]).tolist():
            found.setdefault(int(item[edges[g]]), set()).add((int(first[g]), int(final[g])))
        return {x: sorted(bands) for x, bands in found.items()}

    def align(self, x: int, codes: np.ndarray, bands: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Non-overlapping (start, end, edits) of item ``x`` in the text, fewest edits first, from the given bands.

        A match's diagonals lie within k of those of its q-grams, which lie in one band; so each band is verified by
        itself, on the diagonals up to k beside its hits. Where unchanged copies leave no room for another match, nothing has to be aligned.
        """
        item, k = self.codes[x], int(self.edit[x])
        m = len(item)
        found: dict[int, tuple[int, int]] = {}  # by end: edits, start
        todo: dict[int, list[int]] = {}  # by width: first diagonals
        for low, high in bands:
            a, b = max(0, low - k), min(len(codes), high + k + m)
            copies = _copies(item, codes[a:b])
            for start in copies:
                found[a + start + m] = 0, a + start
            ends, starts = [0, *(c + m for c in copies)], [*copies, b - a]
            if any(start - end >= m - k for end, start in zip(ends, starts, strict=True)):
                todo.setdefault(high - low + 2 * k + 1, []).append(low - k)
        for width, first in todo.items():
            at_once = max(1, CELLS // width)
            for i in range(0, len(first), at_once):
                _banded(item, codes, np.array(first[i : i + at_once]), width, k, found)
        out: list[tuple[int, int, int]] = []
        taken = _Spans()
        for end, (edits, start) in sorted(found.items(), key=lambda f: (f[1][0], f[0])):
            if taken.add(start, end):
                out.append((start, end, edits))
        return out


_EDIT = np.int64(1) << 40


def _banded(item: np.ndarray, codes: np.ndarray, first: np.ndarray, width: int, k: int, found: dict[int, tuple[int, int]]) -> None:
    """Distances of the whole item, both ends in the text free, on ``width`` diagonals from each of ``first``.

    One step per character of the item, for all bands together. A cell is one number: its distance times ``_EDIT``, and below that
    the place it started from, counted from the text's end, so that of equal distances the later start is kept. Only one row is held.
    """
    m, n = len(item), len(codes)
    base = int(first.min())
    # Text around the bands, with signs that equal nothing where there is none.
    text = np.full(int(first.max()) - base + width + m, 0xFFFFFFFF, np.uint32)
    a, b = max(0, base), min(n, base + len(text))
    text[a - base : b - base] = codes[a:b]
    seen = np.lib.stride_tricks.sliding_window_view(text, width)
    rows = first - base
    steps = np.arange(width, dtype=np.int64)
    diagonal = first[:, None] + steps
    cell = np.where((diagonal >= 0) & (diagonal <= n), n - diagonal, _EDIT << 20)
    slope = steps * _EDIT
    for i in range(m):
        own = cell + (seen[rows + i] != item[i]) * _EDIT  # a character of each
        np.minimum(own[:, :-1], cell[:, 1:] + _EDIT, out=own[:, :-1])  # one of the item alone
        own -= slope  # one of the text alone: the least so far, one more for each step
        np.minimum.accumulate(own, axis=1, out=own)
        own += slope
        cell = own
        if i % 64 == 63:
            alive = cell.min(axis=1) < (k + 1) * _EDIT
            if not alive.all():
                if not alive.any():
                    return
                rows, diagonal, cell = rows[alive], diagonal[alive], cell[alive]
    edits, starts, ends = cell // _EDIT, n - cell % _EDIT, diagonal + m
    for r, c in zip(*np.nonzero((edits <= k) & (ends <= n) & (ends > starts)), strict=True):
        end, value = int(ends[r, c]), (int(edits[r, c]), int(starts[r, c]))
        if end not in found or (value[0], -value[1]) < (found[end][0], -found[end][1]):
            found[end] = value


class _Spans:
    """Spans of a text that do not overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def _copies(item: np.ndarray, region: np.ndarray) -> list[int]:
    """Where unchanged copies of the item start, left to right, none overlapping."""
    whole, part, out, at = region.tobytes(), item.tobytes(), [], 0
    while (at := whole.find(part, at)) >= 0:
        if at % 4:
            at += 1
        else:
            out.append(at // 4)
            at += len(part)
    return out


def search(text: str | None, items: Items) -> list[tuple[int, int, int, int]]:
    """(item_id, start, end, edits) in code points of the text, by item and place."""
    if not text:
        return []
    codes, origin = normalised(text)
    found = []
    for x, bands in items.bands(codes).items():
        for start, end, edits in items.align(x, codes, bands):
            found.append((items.ids[x], int(origin[start]), int(origin[end - 1]) + 1, edits))
    return sorted(set(found), key=lambda f: (f[0] is None, f[0] or 0, *f[1:]))


def _run(rows: list[tuple[int, str]], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, percent)
        for batch in batches:
            out = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in search(t, items)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one partition of the table at a time."""
    block, size = [], 0
    for row in benchmark.where(F.col(text).isNotNull()).select(F.col(item_col).cast("long"), F.col(text).cast("string")).toLocalIterator():
        block.append(tuple(row))
        size += len(row[1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per passage found: doc, item, [start, end) in code points, and edits."""
    plain = docs.select(F.col(id_col).cast("long"), F.col(text).cast("string"))
    out = None
    for rows in _blocks(benchmark, item_col, item_text):
        found = plain.mapInArrow(_run(rows, percent), SCHEMA)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], SCHEMA)
    return out.withColumnRenamed("doc_id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no benchmark passage is found, with all their columns; told apart by text, so ids may be null."""
    by_text = docs.select(F.xxhash64(F.col(text).cast("string")).alias("_gone"), F.col(text).alias("text"))
    found = matches(by_text, benchmark, percent, "_gone").select("_gone").distinct()
    return docs.join(found, F.xxhash64(docs[text].cast("string")) == found["_gone"], "left_anti")


def op9_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


REGISTERED = {"op9_benchmark_passages": (op9_benchmark_passages, None)}
