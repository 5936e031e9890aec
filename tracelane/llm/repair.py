"""Operator 12: repair of conversation structure by an auction for shortest paths.

A conversation is a path through a lattice. A node is (rows read, state of the structure ``(s?(ua)+)?``); its arcs
are the edits of the next row (Keep, Rerole, Delete) and Insert, with integer costs. Every node has a price, a lower
bound of its cost to the end: ``price(node) <= cost + price(target)`` on each arc. The auction grows a path from an
origin: at the path's last node it takes the cheapest ``cost + price``; if the node's price is below it, the price
rises to it and the path loses that node (contraction), else the path gains the arc's target (extension). It ends at
a node whose price is final. Origins are taken from the last row to the first and keep the prices found, so each
origin needs few steps and a conversation of n rows O(n). Then an arc is tight (``price == cost + price(target)``) exactly if it lies on
a cheapest repair, and the ASCII-least one is read off by following the least tight edit.

A conversation of any length is cut into blocks of ``BLOCK`` rows. A block has one cost from each entry state to each
exit state; the blocks are the rows of a lattice of the same kind, whose prices close the blocks' own lattices.
Inserts in front of a row belong to that row's block, so the least string inside a block never depends on the next.
A block enters its lattice as one letter per row, so equal blocks are solved once per worker.

Rows get their places by one range-sorted write, which splits a conversation that holds much of the table.

Defined cases: nulls of role, text, conversation and turn are one space where they are read as text; a null conversation is a conversation;
rows are ordered by turn (nulls first), then role and text; an empty role fits nowhere, as an unknown one; gaps beyond a long are
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelane.llm.common import table
from tracelane.session import staged

BLOCK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant. What must be put next, and where that leads.
STATES = range(4)
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ACCEPTED = (0, None, None, 0)

# An arc: cost, edit, layer and state of its target, role letter that it gives ("" leaves the row's own).
Arc = tuple[int, str, int, int, str]
Lattice = list[list[list[Arc]]]
END = -1


def _leading(arcs: Lattice) -> Lattice:
    """The arcs that lead to an end; others would let prices rise without limit."""
    out: Lattice = [[] for _ in arcs]
    alive = [[False] * len(layer) for layer in arcs]
    for i in range(len(arcs) - 1, -1, -1):
        kept: list[list[Arc]] = []
        while True:
            kept = [[a for a in states if a[2] == END or alive[a[2]][a[3]]] for states in arcs[i]]
            if alive[i] == [bool(states) for states in kept]:
                break
            alive[i] = [bool(states) for states in kept]
        out[i] = kept
    return out


def converge(arcs: Lattice) -> list[list[float]]:
    """Final prices by auction, infinite where no way leads to an end. ``arcs[layer][state]``; an arc to layer ``END`` ends."""
    arcs = _leading(arcs)
    price: list[list[float]] = [[0 if states else float("inf") for states in layer] for layer in arcs]
    final = [[not states for states in layer] for layer in arcs]
    for layer in range(len(arcs) - 1, -1, -1):
        for state in range(len(arcs[layer])):
            path = [(layer, state)]
            while True:
                i, q = path[-1]
                if i == END or final[i][q]:
                    break
                best, to = min((cost if j == END else cost + price[j][r], (j, r)) for cost, _, j, r, _ in arcs[i][q])
                if price[i][q] == best:
                    path.append(to)  # extension
                    continue
                price[i][q] = best
                if len(path) > 1:
                    path.pop()  # contraction
            for i, q in path:
                if i != END:
                    final[i][q] = True
    return price


def rows_lattice(code: str, exits: tuple, last: bool) -> Lattice:
    """The lattice of a block. ``code``: a letter per row (s, u, a, x; upper case: truncated; d: must go); ``exits``: cost after each state."""
    arcs: Lattice = []
    for i, letter in enumerate(code):
        own, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
        layer = []
        for q in STATES:
            put, to = NEXT[q]
            out = [(DELETE, "D", i + 1, q, ""), (INSERT, "I", i, to, put)]
            if own != "d":
                if (own, q) in KEPT:
                    out.append((KEEP + extra, "K", i + 1, KEPT[own, q], ""))
                if own != put:
                    out.append((REROLE + extra, "R", i + 1, to, put))
            layer.append(out)
        arcs.append(layer)
    ends = []
    for q in STATES:
        put, to = NEXT[q]
        out = [] if exits[q] is None else [(exits[q], "", END, q, "")]
        ends.append(out + [(INSERT, "I", len(code), to, put)] if last else out)
    return [*arcs, ends]


def trace(arcs: Lattice, price: list[list[float]], state: int) -> tuple[int, str, list[tuple[int, str]], int]:
    """Along the least tight edits: cost before the exit, edits, (row or -1, role letter) of what stays, exit state."""
    i, cost, edits, items = 0, 0, [], []
    while True:
        tight = [a for a in arcs[i][state] if price[i][state] == a[0] + (0 if a[2] == END else price[a[2]][a[3]])]
        paid, edit, j, r, put = min(tight, key=lambda a: a[1])
        if j == END:
            return cost, "".join(edits), items, state
        cost += paid
        edits.append(edit)
        if edit != "D":
            items.append((-1 if edit == "I" else i, put))
        i, state = j, r


@lru_cache(20_000)
def transfer(code: str, last: bool) -> list[int | None]:
    """Cheapest cost from each entry state to each exit state, by entry; None: no way."""
    out: list[int | None] = [None] * 16
    for to in STATES:
        prices = converge(rows_lattice(code, tuple(0 if q == to else None for q in STATES), last))[0]
        for q in STATES:
            out[4 * q + to] = None if prices[q] == float("inf") else int(prices[q])
    return out


def between(transfers: list[list[int | None]]) -> list[list[int | None]]:
    """What the rest costs after each block, by state."""
    arcs: Lattice = [[[(t[4 * q + to], "", i + 1, to, "") for to in STATES if t[4 * q + to] is not None] for q in STATES] for i, t in enumerate(transfers)]
    arcs.append([[] if ACCEPTED[q] is None else [(ACCEPTED[q], "", END, q, "")] for q in STATES])
    return [[None if p == float("inf") else int(p) for p in layer] for layer in converge(arcs)[1:]]


@lru_cache(20_000)
def solved(code: str, exits: tuple, last: bool) -> list[tuple | None]:
    """``trace`` from each entry state; None where there is no way."""
    arcs = rows_lattice(code, exits, last)
    price = converge(arcs)
    return [None if price[0][q] == float("inf") else trace(arcs, price, q) for q in STATES]


TRACED = "struct<cost:long,audit:string,items:array<struct<row:int,put:string>>,exit:int>"


def _record(found: tuple | None) -> dict | None:
    if found is None:
        return None
    cost, audit, items, out = found
    return {"cost": cost, "audit": audit, "items": [{"row": row, "put": put} for row, put in items], "exit": out}


def _whole(code):
    return _record(solved(code, ACCEPTED, True)[0])


def _entries(code, exits, last):
    return [_record(x) for x in solved(code, ACCEPTED if last else tuple(exits), last)]


def _chain(exits):
    """The entry state of each block, from each block's exit states by entry state."""
    state, out = 0, []
    for e in exits:
        out.append(state)
        state = e[state]
    return out


def _arrow(function: Callable, kind: str) -> Callable[..., Column]:
    return F.udf(function, kind, useArrow=True)


def damaged(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) after the damage that the row's own name decides."""
    space = F.lit(" ")
    rows = talks.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("fault", F.crc32(name) % 20).where("fault <> 0")
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), copies.alias("copy")).drop("copy")


def _key(conv: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("null"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their conversation's key ``k`` and a place ``pos`` that rises in their order, written."""
    # The last sort key lets a range bound fall between equal rows too.
    named = rows.select(_key("conv").alias("k"), "turn", "role", "text").withColumn("tie", F.monotonically_increasing_id())
    order = ["k", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    return staged(named.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("pos", F.monotonically_increasing_id()))


def _judged(rows: DataFrame) -> DataFrame:
    """(k, pos, fault, initial) per row: the first fault of blank, duplicate, truncated."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    narrow = rows.select(
        "k", "pos", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"), (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"), F.substring("role", 1, 1).alias("initial"),
    )
    first = narrow.groupBy("k", "said").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return narrow.join(first, "pos", "left").select("k", "pos", fault.alias("fault"), F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x").alias("initial"))


def _blocks(judged: DataFrame, block: int) -> DataFrame:
    """One row per block of a conversation: its letters, its fault counts and its illegal neighbours."""
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    rows = judged.select("k", F.floor(F.col("pos") / block).alias("block"), "fault", F.struct("pos", letter.alias("letter"), "initial").alias("r"))
    counts = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    found = rows.groupBy("k", "block").agg(F.sort_array(F.collect_list("r")).alias("r"), *counts)  # BLOCK rows at most
    found = found.select("k", "block", "blank", "duplicate", "truncated", F.array_join("r.letter", "").alias("code"), F.array_join("r.initial", "").alias("initials"))
    order = Window.partitionBy("k").orderBy("block")
    joined = F.concat(F.coalesce(F.substring(F.lag("initials").over(order), -1, 1), F.lit("")), "initials")
    legal = F.regexp_count("joined", F.lit("(?=su|ua|au)"))
    whole = Window.partitionBy("k")
    found = found.withColumns({"joined": joined, "n": F.count(F.lit(1)).over(whole), "last": F.col("block") == F.max("block").over(whole)})
    return staged(found.withColumn("illegal", F.length("joined") - 1 - legal).drop("joined", "initials"))


def _plans(blocks: DataFrame) -> DataFrame:
    """(k, block, cost, audit, items) of the cheapest, least repair."""
    short = blocks.where("n = 1").select("k", "block", _arrow(_whole, TRACED)("code").alias("t"))
    long = blocks.where("n > 1")
    costs = long.select("k", F.struct("block", _arrow(transfer, "array<int>")("code", "last").alias("t")).alias("b")).groupBy("k").agg(F.sort_array(F.collect_list("b")).alias("b"))
    exits = costs.select("k", F.explode(F.arrays_zip(F.col("b.block").alias("block"), _arrow(between, "array<array<int>>")("b.t").alias("exits"))).alias("x")).select("k", "x.block", "x.exits")
    traced = staged(long.join(exits, ["k", "block"]).select("k", "block", _arrow(_entries, f"array<{TRACED}>")("code", "exits", "last").alias("t")))
    ways = traced.select("k", F.struct("block", F.transform("t", lambda x: x.exit).alias("e")).alias("b")).groupBy("k").agg(F.sort_array(F.collect_list("b")).alias("b"))
    entry = ways.select("k", F.explode(F.arrays_zip(F.col("b.block").alias("block"), _arrow(_chain, "array<int>")("b.e").alias("entry"))).alias("x")).select("k", "x.block", "x.entry")
    chosen = traced.join(entry, ["k", "block"]).select("k", "block", F.element_at("t", F.col("entry") + 1).alias("t"))
    return staged(short.unionByName(chosen).select("k", "block", "t.cost", "t.audit", "t.items"))


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation key: the repaired rows (``role``, ``text``), the edits and what was found.

    ``rows``: conv, turn, role, text. A conversation's result is one row, as large as the conversation.
    """
    placed = _placed(rows)
    blocks = _blocks(_judged(placed), block)
    plans = _plans(blocks)
    texts = placed.groupBy("k", F.floor(F.col("pos") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows"))

    def row(x: Column) -> Column:
        own = F.get("rows", x.row)
        role = F.when(x.put == "u", "user").when(x.put == "a", "assistant").otherwise(own.role)
        return F.struct(role.alias("role"), F.when(x.row < 0, "").otherwise(own.text).alias("text"))

    pieces = texts.join(plans, ["k", "block"]).select("k", F.struct("block", "audit", F.transform("items", row).alias("rows")).alias("b"), "cost")
    fixed = pieces.groupBy("k").agg(F.sort_array(F.collect_list("b")).alias("b"), F.sum("cost").alias("cost"))
    fixed = fixed.select("k", "cost", F.array_join("b.audit", "").alias("audit"), F.flatten("b.rows").alias("repaired"))
    facts = blocks.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    turns = placed.groupBy("k").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    gaps = F.when(F.col("n") == 0, 0).otherwise(F.try_subtract(F.try_subtract("hi", "lo"), F.col("n") - 1))
    return facts.join(turns.select("k", gaps.alias("gaps")), "k").join(fixed, "k")


def report(talks: DataFrame, rows: DataFrame, conv: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """A row for every conversation of ``talks``, also where ``rows`` has none left."""
    found = repair(rows, block)
    every = talks.groupBy(F.col(conv).alias("conv_id")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("k", _key("conv_id"))
    zero = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    said = F.array_join(F.transform("repaired", lambda r: F.concat(r.role, F.lit(":"), r.text)), "\n")
    return every.join(found, "k", "left").select(
        "conv_id", F.when(F.col("cost").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(said, F.lit("")), 256).alias("repaired_sha256")
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return report(talks, damaged(talks))


def _best(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _closed(v: str) -> str:
    """SQL: the four states' best ways when inserts may come first. Two inserts in a row lead back at the third."""

    def put(q: int, rest: str) -> str:
        role = {"u": "user:", "a": "assistant:"}[NEXT[q][0]]
        return f"CASE WHEN {rest} IS NOT NULL THEN {{'c': {rest}.c + {INSERT}, 'a': 'I' || {rest}.a, 'r': list_prepend('{role}', {rest}.r)}} END"

    def at(q: int) -> str:
        return f"{v}[{q + 1}]"

    # The innermost expressions are columns, so that none is written out many times.
    return f"[{', '.join(_best(at(q), put(q, at(NEXT[q][1])), put(q, f'(SELECT {put(NEXT[q][1], at(NEXT[NEXT[q][1]][1]))})')) for q in STATES)}]"


def _oracle() -> str:
    """The same by dynamic programming from the last row, one recursion step per row."""

    def way(cost: str, edit: str, row: str | None, to: int) -> str:
        rest = f"s.v[{to + 1}]"
        kept = f"list_prepend({row}, {rest}.r)" if row else f"{rest}.r"
        return f"CASE WHEN {rest} IS NOT NULL THEN {{'c': {cost} + {rest}.c, 'a': '{edit}' || {rest}.a, 'r': {kept}}} END"

    edits = []
    for q in STATES:
        put, to = NEXT[q]
        ways = [way(str(DELETE), "D", None, q)]
        ways += [f"CASE WHEN NOT gone AND i = '{own}' THEN {way('extra', 'K', 'role || chr(58) || text', kept)} END" for (own, at), kept in KEPT.items() if at == q]
        name = {"u": "user:", "a": "assistant:"}[put]
        ways.append(f"CASE WHEN NOT gone THEN {way(f'{REROLE} + extra', 'R', f'{chr(39)}{name}{chr(39)} || text', to)} END")
        edits.append(_best(*ways))
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
named AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
faults AS (SELECT k, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS f FROM named, crc),
dam AS (SELECT k, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faults, (SELECT unnest([0, 1]) AS copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS n, substr(role, 1, 1) AS i FROM dam),
judged AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault, lead(i) OVER (PARTITION BY k ORDER BY n) AS j
  FROM (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY n) AS seen FROM placed))),
steps AS (
  SELECT k, max(n) AS n, {_closed("[{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}, NULL, NULL, {'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}]")} AS v FROM judged GROUP BY k
  UNION ALL
  SELECT k, n, {_closed('w')} FROM (SELECT j.k, j.n - 1 AS n, [{', '.join(edits)}] AS w FROM steps AS s JOIN judged AS j ON j.k = s.k AND j.n = s.n)),
facts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (j IS NOT NULL AND i || j NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY k)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v[1].c, 0) AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM named) AS o LEFT JOIN facts USING (k) LEFT JOIN (SELECT * FROM steps WHERE n = 0) AS z USING (k)
"""


REGISTERED = {"op12_conversation_repair": (op12_conversation_repair, _oracle())}
