"""Decontamination against plain distances, wrappers on small sites, held-out toxicity."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from text_helpers import SMALL, docs, no_docs, odd_docs, read
from pyspark.sql import functions as F

from tracelane.llm import decontaminate as D
from tracelane.llm import html as H
from tracelane.llm import toxicity as X

BENCH = "item_id long, text string, doc_id string, start string"


def bench_of(spark, *texts):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(texts)], BENCH)


def distance_in(text, item):
    """Fewest edits of the whole item to any part of the text."""
    row = np.zeros(len(text) + 1, np.int64)
    codes = np.array([ord(c) for c in text])
    for i, c in enumerate(item, 1):
        new = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        out = np.concatenate([[i], new])
        row = np.minimum.accumulate(out - np.arange(len(out))) + np.arange(len(out))
    return int(row.min())


def plain(text):
    return " ".join(text.lower().split())


def test_passages_with_up_to_the_budget_of_edits(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrst") for _ in range(draw.randint(1, 8)))
    items = [" ".join(word() for _ in range(draw.randint(10, 60))) for _ in range(12)]
    texts, hits = [], []
    for n in range(90):
        item = list(items[n % 12])
        edits = draw.randint(0, len(item) // 7)
        for _ in range(edits):
            at, how = draw.randrange(len(item)), draw.randrange(3)
            item[at : at + 1] = [[], [draw.choice("xyz")], [item[at], "z"]][how]
        before, after = (" ".join(word() for _ in range(draw.randint(0, 80))) for _ in range(2))
        texts.append(f"{before}\n {''.join(item).upper() if n % 5 == 0 else ''.join(item)}  {after}")
    got = {}
    for r in D.matches(docs(spark, *texts), bench_of(spark, *items)).collect():
        got[(r.doc_id, r.item_id)] = min(r.edits, got.get((r.doc_id, r.item_id), 999))
        hits.append(r)
    for d, text in enumerate(texts, 1):
        for i, item in enumerate(items):
            budget, fewest = len(plain(item)) // 10, distance_in(plain(text), plain(item))
            assert got.get((d, i)) == (fewest if fewest <= budget else None), (d, i, fewest, budget)
    for r in hits:
        assert distance_in(plain(items[r.item_id]), plain(texts[r.doc_id - 1][r.start : r.end])) <= r.edits + 2
    gone = {d for d, _ in got}
    assert {r.doc_id for r in D.clean(docs(spark, *texts), bench_of(spark, *items)).collect()} == set(range(1, 91)) - gone


def test_whole_table(spark):
    items = read("benchmark", "item_id, text")
    got = {r.doc_id for r in D.op9_benchmark_passages(spark, SMALL).collect()}
    exact = {d for d, t in read("documents", "doc_id, text") if any(plain(x) in plain(t) for _, x in items)}
    assert exact <= got and len(got) <= len(exact) + 5


def plain_matches(text, item, percent=10):
    """Ends of all places where the whole item lies within its edits, by one full distance table (a row per character of the item)."""
    text, item = (np.array([ord(c) for c in x]) for x in (text, item))
    k, row = min(len(item) * percent // 100, (len(item) + 1) // 8 - 2), np.zeros(len(text) + 1, int)
    at = np.arange(len(text) + 1)
    for i, c in enumerate(item):
        new = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + (text != c)]))
        row = np.minimum.accumulate(new - at) + at
    return {int(j): int(row[j]) for j in np.flatnonzero(row <= k)}


def flat(text):
    return "".join(chr(c) for c in D.normalised(text)[0])


def test_every_passage_of_the_small_table_is_found(spark):
    """An item within k edits keeps one of its k + 1 pieces unchanged: the texts with such a piece are compared in full."""
    docs_, items = read("documents", "doc_id, text"), read("benchmark", "item_id, text")
    got = {}
    for r in D.op9_benchmark_passages(spark, SMALL).collect():
        got.setdefault((r.doc_id, r.item_id), []).append((r.start, r.end, r.edits))
    texts = {i: flat(t or "") for i, t in docs_}
    want = {}
    for item_id, item in items:
        item = flat(item.strip())
        if len(item) < D.MIN_ITEM:
            continue
        k = min(len(item) // 10, (len(item) + 1) // 8 - 2)
        cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
        pieces = [item[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for doc_id, text in texts.items():
            if any(p in text for p in pieces) and (ends := plain_matches(text, item)):
                want[doc_id, item_id] = ends
    assert set(got) == set(want) and len(want) >= 3
    for key, spans in got.items():
        assert min(e for _, _, e in spans) == min(want[key].values())


def test_bands_against_full_tables():
    draw = random.Random(8)
    letters = "abcde fgh"

    def changed(text, n):
        out = list(text)
        for _ in range(n):
            i = draw.randrange(len(out))
            out[i : i + 1] = draw.choice([[], [draw.choice(letters)], [out[i], draw.choice(letters)]])
        return "".join(out)

    for _ in range(60):
        item = flat("".join(draw.choice(letters) for _ in range(draw.randint(45, 260))).strip())
        parts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 200)))]
        for _ in range(draw.randint(0, 4)):
            parts += [changed(item, draw.randint(0, len(item) // 8)), "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))]
        text = flat("".join(parts))
        ends = plain_matches(text, item)
        found = D.search(text, D.Items([(1, item)], 10))
        assert bool(found) == bool(ends)
        for _, start, end, edits in found:
            assert ends[end] == edits and plain_matches(text[start:end], item)[end - start] == edits
        for a, b in zip(found, found[1:], strict=False):
            assert a[2] <= b[1]
        for end, edits in ends.items():  # whatever else matches overlaps something at least as good
            assert any(s < end and e > end - len(item) * 2 and d <= edits for _, s, e, d in found)


def test_long_items_and_many_near_copies_stay_small():
    import time
    import tracemalloc

    draw = random.Random(9)
    item = "".join(draw.choice("abcdefghijklm ") for _ in range(20_000)).strip()
    near = item[:5000] + "xx" + item[5003:15_000] + item[15_010:]
    tracemalloc.start()
    began = time.time()
    (found,) = D.search(f"zz {near} yy", D.Items([(1, item)], 10))
    assert found[3] <= 15 and time.time() - began < 60
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    short = flat("".join(draw.choice("abcdefgh ijklmnop") for _ in range(349)).strip())
    many = " ".join(short[:i] + "#" + short[i + 1 :] for i in range(1, 301))
    assert len(D.search(many, D.Items([(1, short)], 10))) == 300


def test_decontamination_of_odd_rows(spark):
    odd = odd_docs(spark)
    assert D.matches(odd, bench_of(spark, None, "", "short", "word " * 20)).select("doc_id").distinct().count() == 1
    assert D.matches(odd, bench_of(spark)).count() == 0 and D.clean(odd, bench_of(spark)).count() == 9
    assert D.matches(no_docs(spark), bench_of(spark, "x" * 80)).count() == 0
    repeated = docs(spark, f"{'abcdefgh ' * 9} and {'abcdefgh ' * 9}")
    assert D.matches(repeated, bench_of(spark, "abcdefgh " * 9, "ABCDEFGH  " * 9)).select("item_id").distinct().count() == 1


PAGES = "page_id long, url string, html string, host string, wrapper string, text string"


def pages_of(spark, *rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGES)


def texts_of(df):
    return {r.page_id: r.text for r in df.collect()}


def test_whole_pages(spark):
    import html

    got = texts_of(H.op7_wrapper_text(spark, SMALL))
    for page_id, page in read("pages", "page_id, html"):
        article = page.split("<article>")[1].split("</article>")[0]
        for mark in ("<h1>", "</h1>", "<p>", "</p>", "<b>"):
            article = article.replace(mark, "\n" if mark != "<b>" else "")
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in article.replace("<br>", " ").split("\n<")[0].split("\n")) if x)
        if article.count("\n") == article.replace("\n\n", "\n").count("\n") or got[page_id] == want:
            assert got[page_id].replace("\n", " ") == want.replace("\n", " ")


def page(n, title, body, extra=""):
    return (
        f"<html><head><title>t</title><script>if (a < b) {{ '</p>' }}</script></head><body><header class=top>Site</header><div id='menu-2'><a href=/>Home</a></div>"
        f"<div class='post'><h2>{title}</h2>{body}</div>{extra}<div class=comments><p>I disagree {n}</p></div><div class='cookie notice'>We use cookies</div>"
        f"<p>Always the same line</p><form><p>Sign up</p></form><aside>Other</aside><footer>(c) {n}</footer></body></html>"
    )


def test_wrappers_of_a_site_without_article_tags(spark):
    rows = [(n, f"https://site.example/{n}", page(n, f"Title {n}", "".join(f"<p>Body&nbsp;{n}\n  part {k} &lt;x&gt; <i>it</i><br>on</p>" for k in range(n % 3 + 1)))) for n in range(1, 9)]
    got = texts_of(H.extract(pages_of(spark, *rows)))
    for n in range(1, 9):
        assert got[n] == "\n".join([f"Title {n}", *[f"Body {n} part {k} <x> it on" for k in range(n % 3 + 1)]])
    wrapper = H.decoded(H.wrappers(pages_of(spark, *rows)).first().wrapper)
    assert "(<p> # </>)+" in H.expression(wrapper)


def test_alignment_makes_optional_and_repeated_groups():
    a = H.shape("<body><div class=x><p>1</p></div></body>")
    b = H.shape("<body><div class=x><p>2</p><p>3</p></div><ul><li>q</ul></body>")
    both = H.align(a, b)
    assert H.expression(both) == "<body> <div.x> (<p> # </>)+ </> (<ul> <li> # </> </>)? </>"
    assert H.expression(H.align(b, a)) == H.expression(both)


def test_pages_of_odd_rows(spark):
    rows = [(None, None, None), (1, "nonsense", ""), (2, "http://h/", "<p>open <b>never closed<p>next<scr"), (3, "http://h/", "<article><p>x</article>" * 2), (3, "http://h/", "plain & text"), (4, "http://h/", "<p>" + "y " * 300_000), (5, "http://i/", "<!-- c --><p title='a>b'>in</p><![CDATA[z]]>&am")]
    got = H.extract(pages_of(spark, *rows)).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert texts_of(H.extract(pages_of(spark, rows[2]))) == {2: "open never closed\nnext"}
    assert texts_of(H.extract(pages_of(spark, rows[6]))) == {5: "in\n&am"}
    assert H.extract(pages_of(spark)).count() == 0


def test_templates_of_one_host_do_not_empty_each_other(spark):
    kinds = ["<article><p>tagged {}</p></article><p>left {}</p>", "<div class=post><p>named {}</p></div><p>left {}</p>", "<p>rest {}</p>", "<div class='has-sidebar'><article><p>framed {}</p></article></div><p>left {}</p>"]
    for url in ("http://mixed.example/", None):
        got = texts_of(H.extract(pages_of(spark, *[(n, url, f"<body>{kinds[n % 4].format(n, n)}</body>") for n in range(24)])))
        assert got == {n: f"{('tagged', 'named', 'rest', 'framed')[n % 4]} {n}" for n in range(24)}
    comments = "<main><div class=has-sidebar><article>own</article></div><div class=comments><article>theirs</article></div></main>"
    only = "<div class=post>own</div><div class=comments><article>theirs</article></div>"
    assert texts_of(H.extract(pages_of(spark, (1, None, comments), (2, None, only)))) == {1: "own", 2: "own"}


def test_labels_keep_all_words(spark):
    many = "align bg block border center col column content d flex grid items justify mb p pt"
    pages = [(n, "http://u.example/", f"<body><div class='{many} text'><p>own {n}</p></div><div class='{many} sidebar'><p>other {n}</p></div><div class='{many} widget'><p>more {n}</p></div></body>") for n in range(6)]
    assert texts_of(H.extract(pages_of(spark, *pages))) == {n: f"own {n}" for n in range(6)}


def test_siblings_at_separate_places_are_separate_slots(spark):
    plain = [(n, "http://p.example/", f"<body><div>constant menu</div><div>article {n}</div></body>") for n in range(12)]
    assert texts_of(H.extract(pages_of(spark, *plain))) == {n: f"article {n}" for n in range(12)}
    # An optional element in front, articles of several parts, and the same last line.
    mixed = [(n, "http://m.example/", "<body>" + "<div>banner</div>" * (n % 2) + "<div>menu</div>" + "".join(f"<div>part {n} {k}</div>" for k in range(n % 3 + 1)) + "<p>end</p></body>") for n in range(24)]
    got = texts_of(H.extract(pages_of(spark, *mixed)))
    assert {n: x.removeprefix("banner\n") for n, x in got.items()} == {n: "\n".join(f"part {n} {k}" for k in range(n % 3 + 1)) for n in range(24)}
    assert sum("banner" in x for x in got.values()) < 6


def test_common_subsequences():
    draw = random.Random(3)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = H.common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_passages_with_null_ids(spark):
    item = "where does the old river meet the sea and who lives on its banks today"
    bench = spark.createDataFrame([(None, item), (None, "another passage that nobody will ever find anywhere in here"), (3, "x" * 60)], "item_id long, text string")
    df = spark.createDataFrame([(None, f"so {item} then"), (None, "clean"), (1, f"so {item}"), (2, "clean"), (3, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.item_id, r.start) for r in D.matches(df, bench).collect()), key=str) == [(1, None, 3), (None, None, 3)]
    assert sorted((tuple(r) for r in D.clean(df, bench).collect()), key=str) == [(2, "clean"), (3, None), (None, "clean")]


def test_toxicity_on_held_out_rows(spark):
    folder = SMALL.replace("0.001", "0.1")
    labelled = read("labels", "doc_id, toxic", "toxic IS NOT NULL", folder)[:2400]
    wanted = {d for d, _ in labelled}
    rows = [r for r in read("documents", "doc_id, text, lang", folder=folder) if r[0] in wanted]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    out = {r.doc_id: r for r in X.classify(df, labels).collect()}
    held = [(t, out[d].score, out[d].predicted) for d, t in labelled if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, _ in labelled)
    yes, no = [s for t, s, _ in held if t], [s for t, s, _ in held if not t]
    assert np.mean([[(a > b) for b in no] for a in yes]) > 0.93
    hits = sum(p for t, _, p in held if t)
    assert hits > 0.7 * len(yes) and sum(p for t, _, p in held if not t) < 0.05 * len(no)


def test_thresholds_use_all_labelled_rows(spark):
    texts = [(n, f"you awful idiot number {n}" if n % 3 == 0 else f"a kind word about day {n}", "en") for n in range(300)]
    own = [n for n in range(300, 900) if zlib.crc32(str(n).encode()) % 3 != 1]
    texts += [(n, "awful idiot" if n % 2 else "kind word", "xx") for n in own]
    labels = spark.createDataFrame([(n, int(n % 3 == 0)) for n in range(300)] + [(n, n % 2) for n in own], "doc_id long, toxic int")
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    seen = []
    whole = X.cuts
    try:
        X.cuts = lambda scored, labelled, learned: seen.append((labelled.count(), len(learned))) or whole(scored, labelled, learned)
        out = X.classify(df, labels, rows=10).where("lang = 'xx'").select("threshold").distinct().collect()
    finally:
        X.cuts = whole
    assert seen[0][1] == 8 and seen[0][0] > 500
    assert len(out) == 1 and out[0].threshold != X.POINT
    made = spark.createDataFrame([(n, "en", float(n % 7 - 3)) for n in range(2100)], "id long, lang string, logit double")
    marks = made.select("id", (F.col("logit") > 1).cast("int").alias("label"))
    cut, languages = X.cuts(made, marks, [])
    assert 1 < cut < 2 and abs(languages["en"] - cut) < 1e-9


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (99, 1), (7, 1), (4, 0)], "doc_id long, toxic int")
    got = X.classify(odd_docs(spark), labels).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    none = X.classify(odd_docs(spark), labels.where("false")).collect()
    assert {r.score for r in none} == {0.0} and X.classify(no_docs(spark), labels).count() == 0


def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as P

    docs_in = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs_in
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs_in.columns, name
        assert out.count() <= kept.count()
        kept = P.staged(out)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {r.doc_id for r in P.run(spark, SMALL).select("doc_id").distinct().collect()} == ids
    assert 0.4 * docs_in.count() < len(ids) < docs_in.count()


def test_deep_pages_and_long_sibling_lists(spark):
    deep = "<body>" + "<div>" * 20_000 + "<p>in {0}</p>" + "</div>" * 20_000 + "</body>"
    wide = "<body><article>" + "".join(f"<p>line {i} of {{0}}</p>" for i in range(3000)) + "</article></body>"
    got = texts_of(H.extract(pages_of(spark, *[(n, "http://d.example/", deep.format(n)) for n in range(3)], *[(10 + n, "http://w.example/", wide.format(n)) for n in range(3)])))
    assert [got[n] for n in range(3)] == ["in 0", "in 1", "in 2"]
    assert [got[10 + n].split("\n") for n in range(3)] == [[f"line {i} of {n}" for i in range(3000)] for n in range(3)]


def test_articles_keep_their_links_and_boxes(spark):
    page = (
        "<body><nav><a href=/>Home</a></nav><article><p>Intro {0} here.</p><ul><li><a href=/x>First link {0}</a></li><li><a href=/y>Second</a></li></ul>"
        "<div class='alert'><p>Take care {0}.</p></div><div class='social'><p>They met {0}.</p></div><div class='advert'><p>Buy!</p></div><section class='comments'><p>nice {0}</p></section><p>End.</p></article></body>"
    )
    want = "Intro {0} here.\nFirst link {0}\nSecond\nTake care {0}.\nThey met {0}.\nEnd."
    got = texts_of(H.extract(pages_of(spark, *[(n, "http://l.example/", page.format(n)) for n in range(8)], (100, "http://one.example/", page.format(100)))))
    assert got == {n: want.format(n) for n in [*range(8), 100]}


def test_a_teaser_does_not_outweigh_a_story(spark):
    story = "".join(f"<p>Paragraph {i} of the story that is told here.</p>" for i in range(9))
    page = "<body><article><p>Also read this.</p></article><div class='entry'>" + story + "</div></body>"
    got = texts_of(H.extract(pages_of(spark, (1, "http://t.example/1", page))))
    assert got[1].split("\n") == [f"Paragraph {i} of the story that is told here." for i in range(9)]


def test_wrappers_survive_their_encoding():
    a = H.shape("<body><div class=x><p>1</p><ul><li>a<li>b</ul></div>tail</body>")
    b = H.align(a, H.shape("<body><div class=x><p>2</p><p>3</p></div></body>"))
    for node in (a, b, H.shape("")):
        assert H.decoded(H.encoded(node)) == node
