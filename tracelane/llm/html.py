"""Operator 7: main text by wrappers, union-free regular expressions inferred per host.

A page is read as a tree of structural elements and text slots, siblings in their order. Two trees of one host are
aligned level by level: siblings that say the same match first, then those of one label between them, by longest
common subsequences. Each mismatch is resolved: differing text becomes a slot, a sibling too many next to others of
its label a repeated group, any other an optional element; siblings at separate places stay separate slots. (A
repeated pattern of several elements is kept as one repeated group per label.) Folding page after page gives the
host's wrapper; wrappers of different tasks are aligned the same way, so each task folds its own pages first and
only small wrappers are shuffled. As with any folding in turns, which of several alignments is found may depend on
the order of pages. Slots keep how many pages filled them, how much text and link text they held, and whether it was
always the same text. A page is then aligned with its host's wrapper to look up its slots.

The wrapper then says which slots can be the article: outside of elements that tags or names mark as
menu, header, footer, sidebar, notice, advert, form or reader comment, though an article element opens again what a
name has closed; outside of articles, not slots that say the same on all of several pages, nor those made of links. Each page decides for
itself which of them it uses: those in article or main elements if it fills any, else those in elements named as
content, else the rest.

Defined cases: null or empty html gives an empty text; a null url or one without a host belongs to the host "";
tags that are never closed end with the page, and a tag cut off by its end is markup; repeated rows give equal
rows; elements may be nested to any depth; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm.common import table
from tracelane.session import staged

# HTML elements by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("script style noscript template svg math canvas iframe object select textarea button head title option datalist audio video".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav aside footer form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that mark a part as outside the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu "
    "menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related replies respond share sharing sidebar "
    "signup skyscraper social sponsor sponsored subscribe subscription toolbar widget widgets complementary contentinfo search alert".split()
)
#: Those of them whose parts hold articles of others, or pointers to other articles.
OTHER_NAMES = frozenset("ad ads advert adverts advertisement advertising comment comments disqus promo promoted promotion recommended related replies respond sponsor sponsored widget widgets".split())
KNOWN = BLOCKS | SKIPPED | VOID
ARTICLE = frozenset("article main".split())
ARTICLE_NAMES = frozenset("article main content post entry story body maincontent articlebody".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Za-z]+")
#: Elements that an opening tag closes when they are still open.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

#: Those that close a part inside an article too; the other names may stand for parts of it.
INSIDE_NAMES = NAMES - frozenset("alert banner masthead pager pagination popup respond search share sharing signup skyscraper social subscribe subscription toolbar widget widgets".split())

SAME_PAGES = 5
LINK_SHARE = 0.6
TEASER = 3


def _label(tag: str, attributes: str) -> str:
    """Tag with all words of class, id and role: what elements are told apart by."""
    if not attributes or tag not in BLOCKS or "=" not in attributes:
        return tag
    found = sorted({w.lower() for m in _NAME.finditer(attributes) for w in _PART.findall(m[2] or m[3] or m[4] or "")})
    return f"{tag}.{'.'.join(found)}" if found else tag


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, label), ("close", tag, ""), ("text", raw, "")."""
    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], ""
            return
        found = _TAG.match(page, start)
        if found and found[2] is None:  # comment or declaration
            if start > at:
                yield "text", page[at:start], ""
            at = found.end()
            continue
        if not found:
            found = _PLAIN_TAG.match(page, start)  # quotes that are never closed
        if not found:
            yield "text", page[at : start + 1], ""
            at = start + 1
            continue
        if start > at:
            yield "text", page[at:start], ""
        tag, at = found[2].lower(), found.end()
        if found[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, _label(tag, found[3])
        if tag in RAW and not found[3].rstrip().endswith("/"):
            close = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            yield "close", tag, ""


# A node of a page or wrapper: an element, or a text slot (label "#") without nodes below. The digest stands for all
# text and labels inside; 0: differs between pages. The link share is kept by text, the nodes below in page order.
LABEL, PAGES, CHARS, LINKED, DIGEST, REPEATED, OPTIONAL, BELOW = range(8)
TEXT = "#"


def _node(label: str = "") -> list:
    return [label, 1, 0, 0, 0, False, False, []]


def parsed(page: str) -> tuple[list, list[tuple[list, list[str]]]]:
    """The tree of a page's elements and text slots, each sibling a node of its own, and (slot, raw pieces) in page order.

    A slot ends where a block starts or ends. Elements that only style text are not nodes, nor are those without text.
    """
    root = _node()
    tags: list[str] = []
    nodes = [root]  # the root and the node of each open element
    texts: list[tuple[list, list[str]]] = []
    skip, links, slot = 0, 0, None
    for kind, tag, label in tokens(page):
        if kind == "text":
            if skip:
                continue
            said = tag.strip()
            if slot is None and said:
                slot = _node(TEXT)
                nodes[-1][BELOW].append(slot)
                texts.append((slot, []))
            if slot is not None:
                texts[-1][1].append(tag)
                if said:
                    slot[CHARS] += len(tag)
                    slot[LINKED] += len(tag) if links else 0
            continue
        if tag == "a":
            links = links + 1 if kind == "open" else max(0, links - 1)
        elif tag not in KNOWN:
            continue
        elif kind == "open":
            if tag in VOID:
                if tag == "br" and not skip and slot is not None:
                    texts[-1][1].append(" ")
                elif tag == "hr":
                    slot = None
                continue
            if tag in BLOCKS:
                ends = _CLOSES.get(tag, _CLOSES["p"] if tag not in ("html", "body") else ())
                while tags and tags[-1] in ends:
                    tags.pop()
                    nodes.pop()
                node, slot = _node(label), None
                nodes[-1][BELOW].append(node)
            else:
                skip += 1
                node = nodes[-1]
            tags.append(tag)
            nodes.append(node)
        elif tag in tags:
            while tags:
                last = tags.pop()
                nodes.pop()
                skip -= last in SKIPPED
                if last == tag:
                    break
            if tag in BLOCKS:
                slot = None
    for slot, pieces in texts:
        slot[DIGEST] = xxhash.xxh32_intdigest("\n".join(x for x in map(str.strip, pieces) if x)) or 1
    _close(root)
    return root, texts


def _close(root: list) -> None:
    """Drops what holds no text and gives elements their digests, the innermost first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node[BELOW] if x[LABEL] != TEXT]
    for node in reversed(order):
        node[BELOW] = [x for x in node[BELOW] if x[LABEL] == TEXT or x[BELOW]]
        node[DIGEST] = xxhash.xxh32_intdigest("\n".join(f"{x[LABEL]} {x[DIGEST]}" for x in node[BELOW])) or 1


def shape(page: str) -> list:
    """The wrapper of one page."""
    return parsed(page)[0]


def _rows(a: list, b: list) -> list[int]:
    """For each prefix of ``a``, the bits of ``b`` at which the longest common subsequence does not grow."""
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    out = []
    for x in a:
        m = v & at.get(x, 0)
        v = ((v + m) | (v - m)) & full
        out.append(v)
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """The positions of a longest common subsequence, computed on whole rows as bits."""
    n, m, start = len(a), len(b), 0
    while start < n and start < m and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = [(k, k) for k in range(start)] + list(zip(range(n, len(a)), range(m, len(b)), strict=True))
    i, j = n - start, m - start
    if i and j:
        if i > j:
            return sorted([*out, *((start + y, start + x) for x, y in _back(b[start:m], a[start:n]))])
        return sorted([*out, *((start + x, start + y) for x, y in _back(a[start:n], b[start:m]))])
    return out


def _back(a: list, b: list) -> list[tuple[int, int]]:
    i, j = len(a), len(b)
    if i > 1 and i * j > 400_000_000:  # halves, so that the rows are never held at once
        half = i // 2

        def grown(rows_of: list, over: list) -> list[int]:
            v, total = _last(rows_of, over), [0]
            for k in range(len(over)):
                total.append(total[-1] + (v[k] == "0"))
            return total

        head, tail = grown(a[:half], b), grown(a[half:][::-1], b[::-1])
        cut = max(range(j + 1), key=lambda k: head[k] + tail[j - k])
        return common(a[:half], b[:cut]) + [(x + half, y + cut) for x, y in common(a[half:], b[cut:])]
    rows, out = _rows(a, b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def _last(a: list, b: list) -> str:
    """The last of ``_rows``, first position first."""
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        m = v & at.get(x, 0)
        v = ((v + m) | (v - m)) & full
    return f"{v:0{len(b)}b}"[::-1]


def _settled(node: list) -> bool:
    """Whether several pages say the same here: such a node takes no other text while there is another way."""
    return node[DIGEST] != 0 and node[PAGES] > 1


_KEYS = (
    lambda x: (x[LABEL], x[DIGEST]) if x[DIGEST] else None,
    lambda x: None if _settled(x) else x[LABEL],
    lambda x: x[LABEL],
)


def match(xs: list, ys: list) -> tuple[list[tuple[int, int]], dict[int, int], dict[int, int]]:
    """Two sequences of siblings aligned in order: pairs; the ys, and the xs, that repeat a node of ``xs``.

    Nodes that say the same are matched first, then, between these, nodes of one label, last those that said the same
    until now. A node without a partner repeats one of its label between the same two equal nodes; if there is none
    it is optional.
    """
    ends = (len(xs), len(ys))
    found = [(-1, -1), ends]
    anchors = found
    for level, key in enumerate(_KEYS):
        new = [found[0]]
        for (i0, j0), (i1, j1) in zip(found, found[1:], strict=False):
            if i1 - i0 > 1 and j1 - j0 > 1:
                a = [(k, i) for i in range(i0 + 1, i1) if (k := key(xs[i])) is not None]
                b = [(k, j) for j in range(j0 + 1, j1) if (k := key(ys[j])) is not None]
                new += [(a[p][1], b[q][1]) for p, q in common([k for k, _ in a], [k for k, _ in b])]
            new.append((i1, j1))
        found = new
        if not level:
            anchors = found
    pairs = found[1:-1]
    again_y: dict[int, int] = {}
    again_x: dict[int, int] = {}
    if len(pairs) == len(xs) == len(ys):
        return pairs, again_y, again_x
    of_x = dict(pairs)
    taken = set(of_x.values())
    for (i0, j0), (i1, j1) in zip(anchors, anchors[1:], strict=False):
        if i1 - i0 == 1 or i1 - i0 + j1 - j0 == 2:
            continue
        held: dict[str, int] = {}
        for i in range(i0 + 1, i1):
            if i in of_x:
                held.setdefault(xs[i][LABEL], i)
        near = dict(held)
        for i in range(i0 + 1, i1):
            label = xs[i][LABEL]
            if i in of_x:
                near[label] = i
            elif label in near and not _settled(xs[i]):
                again_x[i] = near[label]
        loose: dict[str, int] = {}
        for i in range(i0 + 1, i1):
            if i not in of_x and i not in again_x and not _settled(xs[i]):
                loose.setdefault(xs[i][LABEL], i)
        back = {j: i for i, j in pairs if i0 < i < i1}
        near = loose | held
        for j in range(j0 + 1, j1):
            label = ys[j][LABEL]
            if j in taken:
                near[label] = back[j]
            elif label in near and not _settled(ys[j]):
                again_y[j] = near[label]
    return pairs, again_y, again_x


def _head(a: list, b: list, together: bool) -> list:
    out = [a[LABEL], max(a[PAGES], b[PAGES]) if together else a[PAGES] + b[PAGES], a[CHARS] + b[CHARS], a[LINKED] + b[LINKED]]
    return [*out, a[DIGEST] if a[DIGEST] == b[DIGEST] else 0, a[REPEATED] or b[REPEATED], a[OPTIONAL] or b[OPTIONAL], []]


def _aligned(a: list, b: list, together: bool) -> Iterator[tuple[list, list, bool]]:
    """One level of ``align``: yields the pairs below that it needs aligned, is sent each result, returns its own."""
    out = _head(a, b, together)
    xs, ys = a[BELOW], b[BELOW]
    pairs, again_y, again_x = match(xs, ys)
    new: dict[int, list] = {}
    order: list = []  # numbers of xs, and nodes that only ys has
    i0 = j0 = 0
    for i, j in [*pairs, (len(xs), len(ys))]:
        order += range(i0, i)
        order += [[*ys[k][:OPTIONAL], True, ys[k][BELOW]] for k in range(j0, j) if k not in again_y]
        if i < len(xs):
            order.append(i)
            new[i] = _head(xs[i], ys[j], together) if xs[i][LABEL] == TEXT else (yield xs[i], ys[j], together)
        i0, j0 = i + 1, j + 1
    for i in range(len(xs)):
        if i not in new:
            new[i] = [*xs[i][:OPTIONAL], True, xs[i][BELOW]]
    for k, again in [*((k, xs[i]) for i, k in again_x.items()), *((k, ys[j]) for j, k in again_y.items())]:
        new[k] = _head(new[k], again, True) if again[LABEL] == TEXT else (yield new[k], again, True)
        new[k][REPEATED] = True
    out[BELOW] = [new[x] if isinstance(x, int) else x for x in order if not isinstance(x, int) or x not in again_x]
    return out


def align(a: list, b: list, together: bool = False) -> list:
    """The wrapper that both sides match: what only one has is optional, what either repeats is repeated.

    ``together``: both are parts of the same pages. Levels wait on a list, so pages may be nested to any depth.
    """
    waiting, value = [_aligned(a, b, together)], None
    while waiting:
        try:
            below = waiting[-1].send(value)
        except StopIteration as done:
            waiting.pop()
            value = done.value
        else:
            waiting.append(_aligned(*below))
            value = None
    return value


def expression(root: list) -> str:
    """A wrapper as the regular expression that it stands for."""
    out: list[str] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        label, end = node[LABEL], ")+" if node[REPEATED] and not node[OPTIONAL] else ")*" if node[REPEATED] else ")?" if node[OPTIONAL] else ""
        below = [x for y in node[BELOW] for x in (" ", y)][1:]
        body = [TEXT] if label == TEXT else below if not label else [f"<{label}> ", *below, " </>"]
        stack += reversed(["(", *body, end] if end else body)
    return "".join(out)


def _words_of(label: str) -> tuple[str, set[str]]:
    tag, *names = label.split(".")
    return tag, set(names)


#: Ranks of slots: in an article or main element; in one inside an element whose name marks its frame; in an element
#: named as content; in an article element inside comments and the like; any other outside of marked elements.
TAGGED, FRAMED, NAMED, OTHERS, REST = range(5)
SHUT_BY_FRAME, SHUT_BY_OTHERS, SHUT = 1, 2, 3


def inside_of(label: str, rank: int, shut: int) -> tuple[int, int]:
    """(rank, whether closed and by what) inside an element, from those around it."""
    tag, names = _words_of(label)
    if tag in OUTSIDE or shut == SHUT:
        return rank, SHUT
    if tag in ARTICLE:  # opens what names around it have closed
        if shut == SHUT_BY_OTHERS or rank == OTHERS:
            return OTHERS, 0
        return (FRAMED if rank == FRAMED or (shut and rank != TAGGED) else TAGGED), 0
    if tag not in ("body", "html"):
        if names & (INSIDE_NAMES if rank in (TAGGED, FRAMED) and not shut else NAMES):
            shut = max(shut, SHUT_BY_OTHERS if names & OTHER_NAMES else SHUT_BY_FRAME)
        elif tag == "header" and rank in (NAMED, REST):
            shut = max(shut, SHUT_BY_FRAME)
        elif names & ARTICLE_NAMES and rank == REST and not shut:
            rank = NAMED
    return rank, shut


class Paths:
    """Numbers for the label paths of a wrapper, step by step: a path's length costs nothing."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}

    def below(self, path: int, label: str) -> int:
        return self.numbers.setdefault((path, label), len(self.numbers) + 1)


Known = tuple[dict[int, list[int]], list, Paths]


def article_slots(wrapper: list) -> Known:
    """Text and link text by path, the wrapper, and its paths."""
    shares: dict[int, list[int]] = {}
    paths = Paths()
    stack = [(wrapper, 0)]
    while stack:
        node, path = stack.pop()
        for child in node[BELOW]:
            if child[LABEL] == TEXT:
                share = shares.setdefault(path, [0, 0])
                share[0] += child[CHARS]
                share[1] += child[LINKED]
            else:
                stack.append((child, paths.below(path, child[LABEL])))
    return shares, wrapper, paths


def main_text(page: str | None, known: Known) -> str:
    """The slots of a page that have the best rank, decoded, a line each.

    The best rank is the first that the page fills; but parts named as content come before article elements that hold
    less than a ``TEASER``-th of their text: those point to articles elsewhere. Inside articles nothing is judged by its links.
    """
    shares, wrapper, paths = known
    root, texts = parsed(page or "")
    places: dict[int, tuple[int, bool]] = {}  # by slot: rank, whether it belongs to the article
    stack = [(root, wrapper, 0, REST, 0)]
    while stack:
        node, model, path, rank, shut = stack.pop()
        xs, ys = model[BELOW], node[BELOW]
        pairs, again_y, _ = match(xs, ys)
        of_y = {j: i for i, j in pairs} | again_y
        for j, y in enumerate(ys):
            x = xs[of_y[j]] if j in of_y else y
            if y[LABEL] != TEXT:
                below = inside_of(y[LABEL], rank, shut)
                if below[1] != SHUT:
                    stack.append((y, x, paths.numbers.get((path, y[LABEL]), -1), *below))
            elif not shut:
                same = x[DIGEST] != 0 and x[PAGES] >= SAME_PAGES and rank in (NAMED, REST)
                chars, linked = shares.get(path, (y[CHARS], y[LINKED]))
                judged = rank in (NAMED, REST, OTHERS) and _words_of(node[LABEL])[0] not in HEADINGS
                places[id(y)] = rank, not same and not (judged and linked > LINK_SHARE * chars)

    lines = [(*places[id(slot)], " ".join(entities.unescape("".join(pieces)).split())) for slot, pieces in texts if id(slot) in places]
    held = {rank: sum(len(line) for r, kept, line in lines if r == rank and kept) for rank, _, line in lines if line}
    best = min(held, default=REST)
    if best in (TAGGED, FRAMED) and held.get(NAMED, 0) > TEASER * sum(held.get(r, 0) for r in (TAGGED, FRAMED)):
        best = NAMED
    return "\n".join(line for rank, kept, line in lines if line and kept and rank == best)


def encoded(root: list) -> str:
    """A wrapper as flat JSON: its nodes in page order, each with the number of nodes right below it."""
    rows, stack = [], [root]
    while stack:
        node = stack.pop()
        rows.append([*node[:BELOW], len(node[BELOW])])
        stack += reversed(node[BELOW])
    return json.dumps(rows, separators=(",", ":"))


def decoded(text: str) -> list:
    top: list = []
    stack = [(top, 1)]  # where nodes go, and how many still do
    for row in json.loads(text):
        while not stack[-1][1]:
            stack.pop()
        into, left = stack[-1]
        stack[-1] = into, left - 1
        node = [*row[:BELOW], []]
        into.append(node)
        stack.append((node[BELOW], row[BELOW]))
    return top[0]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held = TaskContext.get().partitionId(), {}

    def out() -> pa.RecordBatch:
        rows = [(h, part, encoded(w)) for h, w in held.items()]
        held.clear()
        columns = zip(*rows, strict=True) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["host", "part", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = shape(page or "")
            held[host] = align(held[host], new) if host in held else new
        if len(held) > 2000:
            yield out()
    yield out()


def _together(part: pa.Table) -> pa.Table:
    whole = None
    for text in sorted(part.column("wrapper").to_pylist()):
        node = decoded(text)
        whole = node if whole is None else align(whole, node)
    return pa.table({"host": part.column("host")[:1], "wrapper": pa.array([encoded(whole)])})


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One wrapper (JSON) per host. Wrappers of tasks are merged in two steps, 64 groups of tasks first."""
    plain = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    first = plain.mapInArrow(_partial, "host string, part int, wrapper string").withColumn("part", F.col("part") % 64)
    some = first.groupBy("host", "part").applyInArrow(_together, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(_together, "host string, wrapper string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Known] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts = []
            for host, page, wrapper in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = article_slots(decoded(wrapper))
                texts.append(main_text(page, known[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )


def extract(pages: DataFrame, known: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page with its article's ``text``. ``known``: wrappers made before."""
    found = staged(wrappers(pages, url, html)) if known is None else known
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host_of(F.col(url)).alias("host"))
    joined = plain.join(found, "host", "left").select("id", "url", "html", "host", F.coalesce("wrapper", F.lit('[["",0,0,0,0,false,false,0]]')).alias("wrapper"))
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long").withColumnRenamed("page_id", id_col)


def op7_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


REGISTERED = {"op7_wrapper_text": (op7_wrapper_text, None)}
