"""Operator 2: deterministic sharded WARC writer, and the reader of its archives.

Records are sorted by (page id, digest) and cut into shards where the running sum of exact sizes passes a multiple of
the shard's size; every shard writes files of its own and starts the next one when the compressed size reaches
``roll_bytes``. So the cuts depend on the records alone, not on samples, tasks or the cluster. Headers and digests are made
anew from the payload, times are a parameter and each record is a gzip member without a time stamp: the same
records give the same files, byte by byte. A file is written under a temporary name that belongs to the task attempt, then
renamed. The manifest (one row per file with size and SHA-256) is written into the archives' folder, under a temporary
name too, and renamed last: that is the commit, and the reader opens only what it names. A lost or repeated task can
leave a temporary file behind, or write the same file again, never a half one.

Among records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page id is the
response and the others are revisits of it. Only (id, digest) pairs are compared for that.

Defined cases: null html is an empty payload; a null url gives an empty target; a null id is below all others;
of equal rows one is the response; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelane.llm.common import table
from tracelane.session import shared_folder, staged
from tracelane.sources.committed import Store

ROLL_BYTES = 64 << 20
#: Bytes of a shard before compression, or the total over ``MAX_SHARDS`` where that is more.
SHARD_BYTES, MAX_SHARDS = 16 << 20, 50_000
#: What a record's headers add.
HEAD_BYTES = 500
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6

MANIFEST = "file string, bytes long, sha256 string, records long, first_id long, last_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(uri: str):
    """File system and path of a folder, by any scheme that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}{f':{copy}' if copy else ''}>"


def record_bytes(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None, copy: int, date: str) -> bytes:
    """``refers_to``: None for a response, else a 1-tuple with the response's page id."""
    digest = base32_sha1(payload)
    target = quote(url or "", safe="".join(chr(c) for c in range(33, 127)))
    headers = [("WARC-Record-ID", _name(page_id, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        headers += [("WARC-Refers-To", _name(refers_to[0], digest)), ("WARC-Profile", PROFILE)]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record_bytes("response" if refers_to is None else "revisit", headers, block + payload if refers_to is None else block)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Shard:
    """One archive file in the making."""

    def __init__(self, system, folder: str, name: str, attempt: str, date: str):
        self.system, self.name, self.final = system, name, f"{folder}/{name}"
        self.temporary = f"{folder}/_tmp-{attempt}-{name}"
        self.stream, self.hash = system.open_output_stream(self.temporary, compression=None), hashlib.sha256()
        self.bytes = self.records = 0
        self.first = self.last = None
        info = b"software: tracelane\r\nformat: WARC File Format 1.1\r\n"
        headers = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        self._put(_member(record_bytes("warcinfo", headers, info)))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def add(self, page_id: int | None, data: bytes) -> None:
        self._put(_member(data))
        self.first = page_id if self.records == 0 else self.first
        self.last, self.records = page_id, self.records + 1

    def close(self) -> tuple:
        self.stream.close()
        self.system.move(self.temporary, self.final)
        return self.name, self.bytes, self.hash.hexdigest(), self.records, self.first, self.last


def _write(folder_uri: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.taskAttemptId()}"
        system, folder = _open(folder_uri)
        shard, part, number, done = None, None, 0, []
        last, copies, mark = None, 0, None
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for place, page_id, url, html, digest, is_page, lead in rows:
                if not is_page:  # stands before the pages of its id and digest: their payload has a response at ``lead``
                    mark = page_id, digest, lead
                    continue
                if place != part:
                    if shard is not None:
                        done.append(shard.close())
                    shard, part, number = None, place, 0
                copies = copies + 1 if (page_id, digest) == last else 0
                last = (page_id, digest)
                known = mark is not None and mark[:2] == last
                first = not known or (page_id == mark[2] and copies == 0)
                if shard is None:
                    shard = _Shard(system, folder, f"pages-{part:06d}-{number:06d}.warc.gz", attempt, date)
                    number += 1
                shard.add(page_id, page_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), None if first else (mark[2],), copies, date))
                if shard.bytes >= roll_bytes:
                    done.append(shard.close())
                    shard = None
        if shard is not None:
            done.append(shard.close())
        columns = list(zip(*done, strict=True)) if done else [()] * 6
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "bytes", "sha256", "records", "first_id", "last_id"])

    return run


def shard_starts(keys: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[tuple]:
    """The first (id, digest) of each shard but the first, nulls first; ``keys``: id, digest, bytes.

    Exact whatever the partitions: sizes are summed along the order in two levels, inside the parts of a range-sorted table and over
    one row per part. At most ``MAX_SHARDS`` rows come back.
    """
    sizes = keys.groupBy("id", "digest").agg(F.sum("bytes").alias("bytes"))
    order = [F.col("id").asc_nulls_first(), "digest"]
    placed = staged(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.shiftright("pos", 33)))
    totals = placed.groupBy("part").agg(F.sum("bytes").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    everything = totals.agg(F.sum("total")).first()[0] or 0
    size = max(shard_bytes, -(-everything // MAX_SHARDS))
    inside = F.sum("bytes").over(Window.partitionBy("part").orderBy("pos")) - F.col("bytes")
    ranked = placed.withColumn("inside", inside).join(before, "part").select("id", "digest", F.floor((F.col("before") + F.col("inside")) / size).cast("long").alias("shard"))
    first = ranked.groupBy("shard").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "digest")).alias("k")).where("shard > 0")
    return sorted(_order(r["k"]["id"], r["k"]["digest"]) for r in first.collect())


def _order(page_id: int | None, digest: str) -> tuple:
    return (page_id is not None, page_id or 0, digest)


def _shard_of(starts: list[tuple]):
    return F.udf(lambda page_id, digest: bisect.bisect_right(starts, _order(page_id, digest)), "int", useArrow=True)


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, min_bytes: int = 0, date: str = DATE, id_col: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the archives into ``folder`` and return the manifest, whose last renaming is the commit."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    store = Store(pages.sparkSession, folder)
    if "manifest" in store.names(""):
        raise FileExistsError(f"{folder} holds committed archives")
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("html")).withColumn("digest", F.sha1("html"))
    keys = staged(plain.select("id", "digest", F.octet_length("html").cast("long").alias("payload")))
    starts = shard_starts(keys.select("id", "digest", (F.col("payload") + HEAD_BYTES).alias("bytes")), shard_bytes)
    rows = keys.where(F.col("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("lead"), F.count(F.lit(1)).alias("n"))
    shared = rows.where("n > 1").select("digest", "lead")
    # Pages move once: what is known of shared payloads travels as rows of its own, which sort before their pages.
    marks = keys.select("id", "digest").distinct().join(shared, "digest").select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.lit(False).alias("page"), "lead")
    every = plain.select("id", "url", "html", "digest", F.lit(True).alias("page"), F.lit(None).cast("long").alias("lead")).unionByName(marks)
    shard = _shard_of(starts)("id", "digest") if starts else F.lit(0)
    dealt = every.select(shard.alias("shard"), "id", "url", "html", "digest", "page", "lead")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartitionById(min(parts, len(starts) + 1), "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "digest", "page", "url")
    hidden = f"_manifest-{uuid.uuid4().hex}"
    ordered.mapInArrow(_write(folder, roll_bytes, date), MANIFEST).write.parquet(f"{store.top}/{hidden}")
    if not store.rename(hidden, "manifest"):
        raise FileExistsError(f"{folder} holds committed archives")
    return committed(pages.sparkSession, folder)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of the archives in a folder; an error where they were never committed."""
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def _page(name: str) -> int | None:
    value = name[1:-1].split(":")[2]
    return None if value == "none" else int(value)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an opened archive."""
    with gzip.GzipFile(fileobj=stream) as unpacked:
        while line := unpacked.readline():
            if not line.strip():
                continue
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"not a record: {line[:40]!r}")
            headers = {}
            while (line := unpacked.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[key.lower()] = value
            block = unpacked.read(int(headers["content-length"]))
            if len(block) != int(headers["content-length"]) or f"sha1:{base32_sha1(block)}" != headers["warc-block-digest"]:
                raise ValueError(f"damaged record {headers.get('warc-record-id')}")
            yield headers, block


def _read(folder_uri: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(folder_uri)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if system.get_file_info(f"{folder}/{name}").size != size:
                    raise ValueError(f"{name} is not as the manifest says")
                rows: list[tuple] = []
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if headers["warc-type"] == "response" and (length != len(payload) or base32_sha1(payload) != digest):
                            raise ValueError(f"damaged payload {headers['warc-record-id']}")
                        refers = _page(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
                        kept = payload if with_payload and headers["warc-type"] == "response" else None
                        rows.append((_page(headers["warc-record-id"]), headers["warc-target-uri"], length, digest, headers["warc-type"], refers, kept))
                        if len(rows) == 512:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    return run


def read(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives that the manifest names, with their digests verified."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "bytes").repartition(parts, "file").mapInArrow(_read(folder, with_payload), RECORD)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), folder)
    return read(committed(spark, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


REGISTERED = {"op2_warc_round_trip": (op2_warc_round_trip, None)}
