"""Base spans against Python's own patterns, and what contexts add."""

from __future__ import annotations

import hashlib
import random
import re

from text_helpers import SMALL, docs, no_docs, odd_docs, read

from tracelane.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        odd = [int(d) for d in digits[::-1][::2]]
        even = [2 * int(d) - 9 * (int(d) > 4) for d in digits[::-1][1::2]]
        return 16 <= len(digits) <= 19 and sum(odd + even) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def check(df, texts):
    got = {r.doc_id: r for r in df.collect()}
    for doc_id, text in texts:
        want = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[doc_id]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN], text
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (text, r.spans, joined)
        assert (r.spans + ",").startswith(joined)


def test_whole_table(spark):
    check(P.op1_personal_data(spark, SMALL), read("documents", "doc_id, text"))


def test_patterns_on_tricky_and_random_texts(spark):
    texts = [
        "a@b.c..d@e.f g@h x@y@z.org %a@-.- é@b.co .@a.b 1.2.3.4@5.6",
        "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.01 1.2.3 1.2.3.4.5 00000000000000000000001.2.3.4",
        "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 4111111111111111 4111 1111 1111 1112 - 5500000000000004- 340000000000009",
        "+1 (803) 555-5351 +12 +1234567 +12345678 +1.2.3.4.5.6.7.8.9 ++49 30 1234567- +1(2)",
        "\U0001f600 \U0001f600 mail é.x@mail.example.com, \U0001f600 10.0.0.255\n+49 (30) 1234-5678",
        "1 " * 3000 + "a@" * 300 + "b." * 900 + " q@" + "c." * 900 + "d",
    ]
    draw = random.Random(4)
    texts += ["".join(draw.choice("1234567890 .-+@ab()_é\n") for _ in range(400)) for _ in range(120)]
    check(P.report(docs(spark, *texts)), list(enumerate(texts, 1)))


def test_long_runs_neither_overflow_nor_stall(spark):
    text = "1 " * 40_000 + "a@" * 3000 + "b." * 20_000 + " q@" + "c." * 20_000 + "d +1" + "(" * 50_000 + " 4111111111111111"
    got = P.report(docs(spark, text)).first()
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (2, 0, 1, 0)


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"they wrote customer contact user{i}@mail.example.com about it" for i in range(12)]
    texts += ["they wrote customer contact AB-90817-X about it", "again AB-90817-X turned up", "model AB-55555-Y is in the list", "serial AB-66666-Y is in the list", "number AB-77777-Z is in the list"]
    got = {r.doc_id: r.spans for r in P.report(docs(spark, *texts)).collect()}
    at = texts[12].index("AB-")
    assert got[13] == f"context:{at}:{at + 10}"
    assert got[14] == "context:6:16"
    assert got[15] == got[16] == got[17] == ""


def test_contexts_count_words_of_all_documents(spark):
    texts = [f"they wrote customer contact user{i}@mail.example.com about it" for i in range(12)] + ["they wrote customer contact AB-90817-X about it"]
    number_free = ["the Customer contact person is away"] * 40 + [None, "", "customer"]
    spans = lambda df: {r.doc_id: r.spans for r in P.report(df).collect()}
    assert spans(docs(spark, *texts))[13].startswith("context:")
    assert spans(docs(spark, *texts, *number_free))[13] == ""


def test_counts_are_the_same_listed_or_joined(spark):
    df = docs(spark, "one two three one two", "One two", None, "", "4 two 5 two", "two one two")
    shared = spark.createDataFrame([("one two",), ("0 two",), ("nine ten",)], "pattern string")
    want = [("0 two", 2), ("one two", 4)]
    assert sorted(map(tuple, P.spoken_pairs(df, "text", shared).collect())) == sorted(map(tuple, P.spoken_pairs(df, "text", shared, listed=1).collect())) == want


def test_words_longer_than_the_window_are_whole_patterns(spark):
    long = "k" * 200
    texts = [f"see {long} id user{i}@mail.example.com end" for i in range(12)] + [f"see {long} id AB-90817-X end", f"see {'k' * 199} id AB-11111-Y end"]
    texts += [f"the {'z' * 300} user{i}@mail.example.com end" for i in range(12)] + [f"the {'z' * 300} QQ-12345-X end", f"the y{'z' * 299} QQ-54321-X end"]
    got = {r.doc_id: r.spans for r in P.report(docs(spark, *texts)).collect()}
    assert got[13].startswith("context:") and got[14] == ""
    assert got[27].startswith("context:") and got[28] == ""


def test_masking(spark):
    df = docs(spark, "write to a.b@mail.example.com or +1 (803) 555-5351.", "nothing here", None, "x 10.0.0.1 y 10.0.0.1")
    out = P.mask(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "write to [EMAIL] or [PHONE].", 2: "nothing here", 3: None, 4: "x [IP] y [IP]"}


def test_odd_rows(spark):
    got = P.report(odd_docs(spark)).collect()
    assert len(got) == 9 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert P.mask(odd_docs(spark)).count() == 9
    assert P.report(no_docs(spark)).count() == 0 and P.mask(no_docs(spark)).count() == 0
