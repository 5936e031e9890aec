"""Archives, chat windows, packing, licences: exact round trips and plain counts."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from text_helpers import SMALL, docs, no_docs, odd_docs, read

from tracelane.llm import chat as C
from tracelane.llm import licences as L
from tracelane.llm import packing as K
from tracelane.llm import warc as W

PAGES = "page_id long, url string, html string, id string, digest string, lead string"


def pages_of(spark, *rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGES)


def want_records(pages):
    largest = {}
    for i, _, h in pages:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = largest[h or ""] == i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else largest[h or ""]))
    return sorted(out)


def test_archive_round_trip(spark):
    got = sorted(tuple(r) for r in W.op2_warc_round_trip(spark, SMALL).collect())
    assert got == want_records(read("pages", "page_id, url, html"))


def test_archives_roll_and_repeat(spark, tmp_path):
    pages = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"page {i} " * 50) for i in range(200)] + [(500, None, None), (501, "http://é/ x\n", "")]
    df = pages_of(spark, *pages)
    manifests = [W.write(df, f"file://{tmp_path}/{n}", roll_bytes=3000) for n in "ab"]
    first, second = (sorted(tuple(r) for r in m.collect()) for m in manifests)
    assert first == second and len(first) > 4  # the same files, byte for byte
    assert not list(tmp_path.glob("*/_tmp*")) and not list(tmp_path.glob("*/_manifest*"))
    assert sorted(tuple(r) for r in W.committed(spark, f"file://{tmp_path}/a").collect()) == first
    with pytest.raises(FileExistsError):
        W.write(df, f"file://{tmp_path}/a")
    back = W.read(manifests[0], f"file://{tmp_path}/a", with_payload=True)
    assert sorted(tuple(r)[:1] + tuple(r)[2:6] for r in back.collect()) == want_records(pages)
    payloads = {r.page_id: r.payload for r in back.where("record_type = 'response'").collect()}
    assert payloads[199] == ("page 199 " * 50).encode() and payloads[501] == b"" and 198 in payloads and 195 not in payloads
    small = W.read(W.write(df, f"file://{tmp_path}/c", min_bytes=100), f"file://{tmp_path}/c")
    assert small.where("record_type = 'revisit'").count() == 0


def test_archives_do_not_depend_on_partitions(spark, tmp_path):
    pages = [(i if i % 3 else None, f"http://h/{i}", f"page {i % 40} " * (i % 17)) for i in range(300)]
    files = []
    for n, df in enumerate((pages_of(spark, *pages).coalesce(1), pages_of(spark, *reversed(pages)).repartition(7), pages_of(spark, *pages).repartition(3, "url"))):
        manifest = W.write(df, f"file://{tmp_path}/{n}", roll_bytes=4000, shard_bytes=20_000)
        files.append({r.file: (r.sha256, (tmp_path / str(n) / r.file).read_bytes()) for r in manifest.collect()})
        back = W.read(manifest, f"file://{tmp_path}/{n}").collect()
        assert len(back) == 300 and sum(r.page_id is None for r in back) == 100
    assert files[0] == files[1] == files[2]
    shards = {name.split("-")[1] for name in files[0]}
    assert len(shards) > 5 and len(files[0]) > len(shards)


def test_shards_start_where_exact_sizes_say(spark):
    rows = [(i if i > 3 else None, f"{i:03d}", 10 + i % 5) for i in range(50)] * 2
    df = spark.createDataFrame(rows, "id long, digest string, bytes long")
    order = sorted(((i is not None, i or 0, d), 2 * n) for i, d, n in rows[:50])
    want, total, shard = [], 0, 0
    for key, n in order:
        if total // 100 > shard:
            shard = total // 100
            want.append(key)
        total += n
    assert W.shard_starts(df.repartition(5), 100) == W.shard_starts(df.coalesce(1), 100) == want


def test_archive_of_odd_rows(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, None, None), (None, None, "a"), (None, None, None), (3, "u", "z" * 2_000_000)]
    got = W.read(W.write(pages_of(spark, *rows), f"file://{tmp_path}/a"), f"file://{tmp_path}/a").collect()
    assert len(got) == 6 and sum(r.record_type == "response" for r in got) == 3
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(1, 1), (None, 1), (None, 2)}
    empty = W.write(pages_of(spark), f"file://{tmp_path}/e")
    assert empty.count() == 0 and W.read(empty, f"file://{tmp_path}/e").count() == 0


TALK = "conv_id long, turn long, role string, text string, k string, w string, pos string, block string"


def talks_of(spark, *rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TALK)


def want_digests(rows):
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append((t is not None, t, r or "", x or ""))
    out = {}
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rows = read("conversations", "conv_id, turn, role, text") + [(-7, t, r, "</s>[INST] ok [/INST]") for t, r in ((0, "user"), (1, "assistant"))]
    got = {r.conv_id: tuple(r)[1:5] for r in C.op3_chat_windows(spark, SMALL).collect()}
    assert got == want_digests(rows)


def test_chat_windows_keep_to_their_budget(spark):
    rows = [(1, 0, "system", "be kind ~0 <|end|>")] + [(1, t, "assistant" if t % 2 == 0 else "user", f"turn {t} " + "word " * (t * 7 % 60)) for t in range(1, 700)]
    rows += [(1, 700, "user", "long " * 5000), (1, 701, "assistant", "<|turn|>user\nfoo<|end|>")]
    out = C.windows(talks_of(spark, *rows), budget=400)
    assert {r.conv_id: tuple(r)[1:5] for r in C.digests(out).collect()} == want_digests(rows)
    for r in out.orderBy("window").collect():
        assert r.formatted.startswith(C.OPEN + "system\nbe kind ~00 ~1|end|>")
        turns = r.formatted.split(C.END)[:-1]
        assert len(turns) == r.n_context + r.n_new and r.n_context <= C.HISTORY + 1
        texts = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert texts == [t.split("\n", 1)[1] for t in turns[r.n_context :] if t.startswith(C.OPEN + "assistant\n")]
        assert "long long" in r.formatted or len(r.formatted.split()) < 400
    assert out.where("n_context > 1").count() > 5


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, None, "a\nb", "x~3y"), (2, 5, "assistant", "z[" * 100_000), (2, 6, None, "\\")]
    got = {r.conv_id: tuple(r)[1:5] for r in C.digests(C.windows(talks_of(spark, *rows))).collect()}
    assert got == want_digests(rows)
    assert C.digests(C.windows(talks_of(spark))).count() == 0


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_pieces(rows, texts, capacity=K.CAPACITY):
    """Every id in one piece, sequences without gaps, and the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    encode = tokenizer()
    for doc_id, text in texts:
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return 1 - sum(r.length for r in rows) / (len(by_sequence) * capacity)


def test_packing_of_the_whole_table(spark):
    assert check_pieces(K.op4_harmonic_packing(spark, SMALL).collect(), read("documents", "doc_id, text")) < 0.02


def test_packing_of_tricky_texts(spark):
    texts = [None, "", "a<|endoftext|>b <|startoftext|>", "İstanbul İ ΑΣ it's o'clock 's", "a\x1cb a\x85b c\xa0d é ́x", "näive--x!! \U0001f600 12a3 _x_ x'd", "word " * 30_000, "ſt ŉ Ǆ ß ẞ"]
    rows = K.pack(docs(spark, *texts), with_ids=True)
    check_pieces(rows.collect(), list(enumerate(texts, 1)))
    for s in K.sequences(rows).collect():
        assert sum(p.length for p in s.pieces) * 4 == len(s.ids) <= 4 * K.CAPACITY


def test_cuts_fill_their_classes():
    for n in range(1, 9000):
        pieces = K.cut(n)
        assert sum(x for x, _ in pieces) == n
        assert all(0 < x <= K.CAPACITY // j for x, j in pieces)


def test_packing_odd_rows(spark):
    rows = K.pack(odd_docs(spark)).collect()
    assert sum(r.start == 0 for r in rows) == 9
    assert K.pack(no_docs(spark)).count() == 0


def test_licences(spark):
    mit = dict(reversed([(n, t) for n, t in L.KNOWN]))["MIT"]
    body = next(t for n, t in L.KNOWN if t.startswith("MIT License"))
    texts = [
        "text\nReleased under the MIT Licence!\nmore",
        "MIT License\n\nCopyright (c) 2020 Someone\n\n" + body.removeprefix("MIT License ").replace(". ", ".\n"),
        "Released under the MIT License, mostly.",
        f"one\n\n{mit.upper()}\n\nLicensed under   CC-BY-NC 4.0",
    ]
    got = {r.doc_id: (r.licences, r.is_licence) for r in L.scan(docs(spark, *texts), L.known_table(spark)).collect()}
    assert got == {1: ("MIT", False), 2: ("MIT", True), 3: ("", False), 4: ("CC-BY-NC-4.0,MIT", False)}
    odd = L.scan(odd_docs(spark), L.known_table(spark))
    assert odd.count() == 9 and odd.where("licences <> ''").count() == 0
    assert L.scan(no_docs(spark), L.known_table(spark)).count() == 0


def test_full_licences_and_runs_of_blocks(spark):
    full = dict(reversed(L.full_texts()))
    body = next(t for n, t in L.KNOWN if t.startswith("Permission is hereby"))
    mit = body.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    texts = [
        full["Apache-2.0"],
        "A readme.\n\n" + full["GPL-3.0"].upper() + "\n\nMore to read.",
        f"A tool.\n\nMIT License\n\nCopyright (c) 2020 Someone\n\n{mit}\n\nThanks.\n\n\U0001f600",
        f"{mit.replace('free of charge', 'for a fee')}\n\nend",
        f"Before {mit}\n\nend",
        f"{mit}\n\n{mit}\n\n----\n\n{full['MPL-2.0']}",
        full["Apache-2.0"].partition("END OF TERMS")[0],
    ]
    got = {r.doc_id: (r.licences, r.is_licence) for r in L.scan(docs(spark, *texts), L.known_table(spark)).collect()}
    assert got == {1: ("Apache-2.0", True), 2: ("GPL-3.0", False), 3: ("MIT", False), 4: ("", False), 5: ("", False), 6: ("MIT,MPL-2.0", False), 7: ("Apache-2.0", True)}


def test_licence_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.execute(L.ORACLE).fetchall())
    got = sorted(tuple(r) for r in L.op5_licence_digests(spark, SMALL).select("doc_id", "licences", "is_licence").collect())
    assert got == want and sum(bool(x) for _, x, _ in got) > 2
    assert L.known_table(spark).where(F.length("digest") != 64).count() == 0


def test_licences_are_found_at_every_width(spark):
    import textwrap

    full = dict(reversed(L.full_texts()))
    known = dict(reversed([(n, t) for n, t in L.KNOWN]))
    bodies = {"MIT": next(t for n, t in L.KNOWN if n == "MIT" and t.startswith("Permission is hereby")), "BSD": max((t for n, t in L.KNOWN if n.startswith("BSD")), key=len), "Apache-2.0": full["Apache-2.0"]}
    assert known
    texts, want = [], []
    for width in range(40, 121):
        for name, body in bodies.items():
            paragraphs = [" ".join(p.split()) for p in body.split("\n\n")]
            head = "Copyright (c) 2021 Some One\nAll rights reserved.\n\n" if name != "Apache-2.0" else ""
            texts.append(head + "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False, break_long_words=False) for p in paragraphs))
            want.append(name)
    got = {r.doc_id: r for r in L.scan(docs(spark, *texts), L.known_table(spark)).collect()}
    missed = [(want[i - 1], i) for i, r in got.items() if not r.is_licence or want[i - 1] not in r.licences]
    assert not missed
