"""Operator 4: harmonic packing of tokenised documents into sequences of one capacity.

A piece of length in (C/(j+1), C/j] belongs to class j, whose bins hold j pieces each. Documents may be cut,
so lengths are cut to fit: whole sequences first, then what is left is kept if it fills its
class well, else a piece of exactly C/(j+1) is cut off and the rest is looked at again. Every class
fills its bins by a running number alone: no worker has to know what another does. Per class one bin at
most stays incomplete; these pieces (fewer than C * ln C, whatever the input) share the last sequences.

Steps: one pass tokenises, cuts and numbers pieces within (partition, class); the counts per (partition,
class) give global numbers; number // j is the bin.

Defined cases: a null or empty text has the end id alone; repeated rows are packed as often as they come;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelane.llm.common import table
from tracelane.session import staged

CAPACITY = 2048
END_ID = 1
#: A piece stays whole if it leaves at most this share of its class's length empty, or is this short.
SLACK, SHORT = 32, 48
#: Texts that are encoded together.
GROUP_BYTES, GROUP_ROWS = 2 << 20, 1024

_WORD = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")


def _lower(word: str) -> str:
    """Lower case letter by letter, as the tokenizer does; the one letter that depends on its place is left to it."""
    return word if "\u03a3" in word else word.lower()


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document, in order."""
    pieces = [(capacity, 1)] * (length // capacity)
    left = length % capacity
    while left:
        j = capacity // left
        room = capacity // j
        if left <= SHORT or (room - left) * SLACK <= room:
            pieces.append((left, j))
            break
        pieces.append((capacity // (j + 1), j + 1))
        left -= capacity // (j + 1)
    return pieces


class Memory:
    """Known values of many keys, in two generations: when the young one is full it becomes the old one, from which
    values that are met again come back. So what is met often stays, and memory is bounded."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], limit: int):
        self.learn, self.limit = learn, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, keys: list[str]) -> list[bytes]:
        """The values of distinct keys; those not known are learnt together."""
        found = list(map(self.young.get, keys))
        missing = [i for i, value in enumerate(found) if value is None]
        again = [self.old.get(keys[i]) for i in missing]
        unknown = [keys[i] for i, value in zip(missing, again, strict=True) if value is None]
        learnt = iter(self.learn(unknown) if unknown else [])
        for i, value in zip(missing, again, strict=True):
            found[i] = next(learnt) if value is None else value
        if len(self.young) + len(missing) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update((keys[i], found[i]) for i in missing)
        return found


class Encoder:
    """Token ids of many texts at once, with a memory for words.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    space-separated chunks, one after the other. Letters followed by ASCII marks are two
    pre-tokens of their own. Arrow splits the texts and numbers their distinct chunks; only these are looked up, and
    the ids of all texts are then gathered from one buffer.
    """

    CHUNKS, WORDS, TOGETHER = 400_000, 400_000, 500

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Memory(self._words, self.WORDS)
        self.chunks = Memory(self._chunks, self.CHUNKS)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, many encoded together."""
        out: list[bytes] = []
        for at in range(0, len(words), self.TOGETHER):
            part = words[at : at + self.TOGETHER]
            done = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            owner = np.array([-1 if w is None else w for w in done.word_ids], np.int64)
            ends = np.flatnonzero(np.diff(owner)) + 1
            if len(ends) + 1 == len(part) and owner[-1] == len(part) - 1:
                ids, cuts = np.array(done.ids, "<u4").tobytes(), [0, *(4 * ends).tolist(), 4 * len(owner)]
                out += [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            else:  # a letter that the tokenizer itself rewrites into several pre-tokens
                out += map(self._encode, part)
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        split = [(_lower(m[1]), m[2]) if (m := _WORD.fullmatch(c)) else None for c in chunks]
        names = list({x for s in split if s for x in s if x})
        ids = dict(zip(names, self.words.values(names), strict=True))
        ids[""] = b""
        return [(self._encode(c) if c else b"") if s is None else ids[s[0]] + ids[s[1]] for c, s in zip(chunks, split, strict=True)]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id; and where each text's ids end."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        ends = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
        numbered = parts.flatten().dictionary_encode()
        known = self.chunks.values(numbered.dictionary.to_pylist()) + [END_ID.to_bytes(4, "little")]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(sizes) - sizes
        codes = np.insert(numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(known) - 1)
        lengths = sizes[codes]
        upto = np.cumsum(lengths)
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(first[codes] - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, upto[ends + np.arange(len(ends))]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per worker process: the words that earlier tasks met stay known."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of groups of at most ``GROUP_BYTES`` of text, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and (held + size > GROUP_BYTES or i - at >= GROUP_ROWS):
            yield at, i - at
            at, held = i, 0
        held += size
    if len(sizes):
        yield at, len(sizes) - at


def _pieces(path: str, capacity: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "number", "ids", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, numbers = _encoder(path), TaskContext.get().partitionId(), {}
        for whole in batches:
            for at, n in _groups(whole.column(1)):
                ids, ends = encoder.encode(whole.column(1).slice(at, n))
                data = ids.astype("<u4").tobytes()
                owner, start, length, crc, tokens, classes, number, kept = ([] for _ in range(8))
                first = 0
                for row, end in enumerate(ends.tolist()):
                    total, done = end - first, 0
                    for size, cls in cut(total, capacity):
                        piece = data[4 * (first + done) : 4 * (first + done + size)]
                        numbers[cls] = numbers.get(cls, -1) + 1
                        owner.append(row)
                        start.append(done)
                        length.append(size)
                        crc.append(zlib.crc32(piece))
                        tokens.append(total)
                        classes.append(cls)
                        number.append(numbers[cls])
                        if with_ids:
                            kept.append(piece)
                        done += size
                    first = end
                arrays = [whole.column(0).slice(at, n).take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens, classes, number))]
                arrays += [pa.array(kept, pa.binary()) if with_ids else pa.nulls(len(owner), pa.binary()), pa.array(np.full(len(owner), part, np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _share(capacity: int):
    """First fit by falling length for the few pieces of incomplete bins."""

    def run(part: pa.Table) -> pa.Table:
        lengths = np.asarray(part.column("length"))
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], part.column("global")[i].as_py(), part.column("cls")[i].as_py()))
        free: list[int] = []
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i in order:
            at = next((b for b, room in enumerate(free) if room >= lengths[i]), len(free))
            if at == len(free):
                free.append(capacity)
            bins[i], offsets[i] = at, capacity - free[at]
            free[at] -= int(lengths[i])
        return part.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets))

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence; with its ids if asked."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    plain = docs.select(F.col(id_col).cast("long"), F.col(text).cast("string"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls long, number long, ids binary, part long"
    pieces = staged(plain.mapInArrow(_pieces(tokenizer, capacity, with_ids), schema))

    counts = pieces.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("cls").orderBy("part")
    first = counts.select("cls", "part", (F.sum("n").over(run) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("cls")).alias("all"))
    # A class per row, fewer than 2 * sqrt(capacity) of them.
    classes = counts.groupBy("cls").agg(F.floor(F.sum("n") / F.col("cls")).cast("long").alias("bins"))
    order = Window.partitionBy(F.lit(0)).orderBy("cls")
    base = classes.select("cls", "bins", (F.sum("bins").over(order) - F.col("bins")).alias("base"), F.sum("bins").over(Window.partitionBy(F.lit(0))).alias("sequences"))
    placed = staged(
        pieces.join(first.join(F.broadcast(base), "cls"), ["cls", "part"])
        .select(*pieces.columns, (F.col("before") + F.col("number")).alias("global"), "bins", "base", "sequences")
        .withColumn("bin", F.floor(F.col("global") / F.col("cls")).cast("long"))
    )
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    tail = ["ids"] if with_ids else []
    inside = Window.partitionBy("sequence_id").orderBy("global")
    full = placed.where("bin < bins").select(*keep, *tail, (F.col("base") + F.col("bin")).alias("sequence_id"), "global")
    full = full.select(*keep, "sequence_id", (F.sum("length").over(inside) - F.col("length")).alias("offset"), *tail)

    rest = placed.where("bin >= bins").select(*keep, "global", "cls", "sequences", *tail)
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, global long, cls long, sequences long" + (", ids binary" if with_ids else "") + ", bin long, offset long"
    shared = rest.groupBy("sequences").applyInArrow(_share(capacity), fields)
    shared = shared.select(*keep, (F.col("bin") + F.col("sequences")).alias("sequence_id"), "offset", *tail)
    return full.unionByName(shared).withColumnRenamed("doc_id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: ``pack(with_ids=True)`` gathered by sequence (one capacity each)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p.ids)).alias("ids"),
        F.transform("parts", lambda p: F.struct(p.doc_id.alias("doc_id"), p.offset.alias("offset"), p.length.alias("length"))).alias("pieces"),
    )


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


REGISTERED = {"op4_harmonic_packing": (op4_harmonic_packing, None)}
