"""Operator 11: secrets in texts, by pattern and by token efficiency.

Three kinds are found by pattern (``assign``, ``access``, ``hex``). The fourth, ``random``, is the token-efficiency
test: a byte-pair vocabulary was made from written language, so it covers words with few tokens and random
characters with many. A run of ``[A-Za-z0-9+/_.=-]`` of ``MIN_RUN`` or more characters whose characters per
token stay under ``MAX_RATIO`` is random, unless it has the shape of

* a digest: hexadecimal of a digest's length, base-32 SHA-1, or one that its algorithm's name introduces;
* an identifier: a UUID, a number or date, words with short numbers joined by ``_ . / + = -`` or by capitals;

or is one of the strings of ``known`` (a table, joined on the string's hash). A random run that touches a span of the
other kinds is left out, so the kinds never overlap it.

Whole texts are read; the only per-row state is one text. Tokens of a run are counted over pieces of ``PIECE``
characters, which bounds the time for a run of any length.

Defined cases: a null text is empty and has no spans; repeated rows are scanned as often as they come; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm.common import table

KINDS = ("assign", "access", "hex", "random")
MIN_RUN, MAX_RATIO, PIECE = 16, 2.0, 256
ROWS = 256

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
# A run of one class has one match, so a least length in the pattern gives the matches that are long enough.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_RUN},}}")
MARKS = "+/_.=-"

# Lengths of digests in hexadecimal, and the names that introduce a digest.
DIGEST = re.compile(r"([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[A-Z2-7]{32})\Z")
NAMED_DIGEST = re.compile(r"(md5|sha-?1|sha-?224|sha-?256|sha-?384|sha-?512|sha3-\d{3}|blake2[bs]|blake3|crc32)[-_=.]", re.IGNORECASE | re.ASCII)
DIGEST_BEFORE = re.compile(r"(md5|sha-?\d{1,3}|blake2[bs]|blake3|digest|checksum|etag|commit|urn:btih)[\"']?\x20?[:=]?\x20?[\"']?\Z", re.IGNORECASE | re.ASCII)
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z")
NUMBER = re.compile(r"[0-9TZ+/_.=-]+\Z")
#: One piece of a name between marks: letters, with short numbers before or after.
NAME = re.compile(r"[0-9]{0,4}[A-Za-z]*+[0-9]{0,4}\Z")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: The words of a name are this long on average; those of random letters are shorter.
WORD_LENGTH = 3


def is_digest(run: str, before: str = "") -> bool:
    return bool(DIGEST.match(run) or NAMED_DIGEST.match(run) or DIGEST_BEFORE.search(before))


def is_identifier(run: str) -> bool:
    if UUID.match(run) or NUMBER.match(run):
        return True
    if not all(map(NAME.match, re.split(r"[+/_.=-]", run))):
        return False
    words = WORD.findall(run)
    return sum(map(len, words)) >= WORD_LENGTH * len(words)


class Ratio:
    """Characters per token of a run under a tiktoken vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, run: str) -> float:
        count = sum(len(self.encoding.encode_ordinary(run[at : at + PIECE])) for at in range(0, len(run), PIECE))
        return len(run) / count


_RATIOS: dict[str, Ratio] = {}


def _ratio(path: str, pattern: str) -> Ratio:
    """One vocabulary per worker process."""
    if path not in _RATIOS:
        _RATIOS[path] = Ratio(path, pattern)
    return _RATIOS[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by pattern, sorted."""
    spans = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def random_spans(text: str, taken: list[tuple[int, int, int]], ratio) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs that fail the token-efficiency test, apart from ``taken``."""
    out, at, reach = [], 0, 0
    for m in RUN.finditer(text):
        run = m[0].strip(MARKS)
        start = m.start() + len(m[0]) - len(m[0].lstrip(MARKS))
        end = start + len(run)
        if len(run) < MIN_RUN:
            continue
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][2])
            at += 1
        if reach > start or is_identifier(run) or is_digest(run, text[max(start - 24, 0) : start]):
            continue
        if ratio(run) < MAX_RATIO:
            out.append((start, 3, end))
    return out


def find(text: str, ratio) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans by pattern and spans by token efficiency. Runs are looked for only where some word is long enough."""
    if max(map(len, text.split()), default=0) < MIN_RUN:
        low = text.lower()
        return (base_spans(text) if any(word in low for word in KEYWORDS) else []), []
    base = base_spans(text)
    return base, random_spans(text, base, ratio)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("value", pa.string())]))
_SCHEMA = "id long, base array<struct<start:long,kind:int,stop:long,value:string>>, random array<struct<start:long,kind:int,stop:long,value:string>>"


def _scan(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = _ratio(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                base, random = [], []
                for text in batch.column(1).to_pylist():
                    text = text or ""
                    for out, spans in zip((base, random), find(text, ratio), strict=True):
                        out.append([{"start": s, "kind": k, "stop": e, "value": text[s:e]} for s, k, e in spans])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPAN), pa.array(random, _SPAN)], names=["id", "base", "random"])

    return run


def scan(docs: DataFrame, known: DataFrame | None = None, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``base`` and ``random`` spans (start, kind, stop, value), in order.

    ``known``: a table with a column ``value`` of digests and identifiers that are no secrets, of any size.
    """
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary, pattern = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    found = plain.mapInArrow(_scan(vocabulary, pattern), _SCHEMA)
    if known is not None:
        found = _without(found, known)
    return found.withColumnRenamed("id", id_col)


def _without(found: DataFrame, known: DataFrame) -> DataFrame:
    """Random spans whose value is in ``known`` go. Only the distinct values travel, not the rows."""
    from tracelane.session import staged

    rows = staged(found.withColumn("row", F.monotonically_increasing_id()))
    spans = rows.select("row", F.explode("random").alias("s")).withColumn("value", F.col("s.value"))
    names = known.select(F.col("value").cast("string").alias("value")).where("value IS NOT NULL").distinct()
    left = spans.join(names, "value", "left_anti").groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("left"))
    none = F.array().cast("array<struct<start:long,kind:int,stop:long,value:string>>")
    return rows.join(left, "row", "left").select("id", "base", F.coalesce("left", none).alias("random"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what ``scan`` found."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.stop)), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")

    counts = [count(at).alias(f"n_{KINDS[at]}") for at in range(3)]
    every = F.sort_array(F.concat("base", "random"))
    return found.select(id_col, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("random").cast("long").alias("n_random"))


def op11_secret_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents")))


REGISTERED = {"op11_secret_runs": (op11_secret_runs, None)}
