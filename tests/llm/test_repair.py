"""Operator 12 against dynamic programming and against plain search, and its edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from text_helpers import SMALL, read

from tracelane.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")


def searched(code):
    """Cheapest, least repair of a short code by trying all edits with up to two inserts in each place."""
    best = None
    places = ["", "u", "a", "ua", "au"]
    edits = [["D"] if c == "d" else ["D", "K", "Ru", "Ra"] for c in code]
    for chosen in itertools.product(*edits):
        for put in itertools.product(places, repeat=len(code) + 1):
            roles, audit, cost = put[0], "I" * len(put[0]), 3 * len(put[0])
            for c, e, more in zip(code, chosen, put[1:], strict=True):
                cost += 4 if e == "D" else (3 if e[0] == "R" else 0) + (3 if c.isupper() else 0)
                roles += ("" if e == "D" else c.lower() if e == "K" else e[1]) + more
                audit += e[0] + "I" * len(more)
                cost += 3 * len(more)
            if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def planned(code, exits=repair.ACCEPTED):
    """Cheapest, least repair by dynamic programming from the end: (cost, audit) per state."""
    def closed(v):
        for _ in range(3):
            for q in repair.STATES:
                to = repair.NEXT[q][1]
                if v[to] is not None:
                    way = (v[to][0] + 3, "I" + v[to][1])
                    v[q] = way if v[q] is None else min(v[q], way)
        return v

    v = closed([None if e is None else (e, "") for e in exits])
    for c in reversed(code):
        w = []
        for q in repair.STATES:
            put, to = repair.NEXT[q]
            extra = 3 if c.isupper() else 0
            ways = [(4 + v[q][0], "D" + v[q][1])] if v[q] else []
            if c != "d":
                kept = repair.KEPT.get((c.lower(), q))
                if kept is not None and v[kept]:
                    ways.append((extra + v[kept][0], "K" + v[kept][1]))
                if v[to]:
                    ways.append((3 + extra + v[to][0], "R" + v[to][1]))
            w.append(min(ways, default=None))
        v = closed(w)
    return v[0]


def plain(rows):
    """The query's row of one conversation, from its rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    code, seen, counts = "", set(), dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        end = text.rstrip(repair.WHITE)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        own = role[:1] if role[:1] in ("s", "u", "a") else "x"
        code += "d" if fault in ("blank", "duplicate") else own.upper() if fault else own
    cost, audit = planned(code)
    out, state, at = [], 0, iter(rows)
    for edit in audit:
        put, to = repair.NEXT[state]
        name = {"u": "user", "a": "assistant"}[put]
        if edit == "I":
            out.append(f"{name}:")
        else:
            _, role, text = next(at)
            if edit == "K":
                out.append(f"{role}:{text}")
                to = repair.KEPT[role[0], state]
            elif edit == "R":
                out.append(f"{name}:{text}")
            else:
                continue
        state = to
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    return dict(
        counts, cost=cost, audit=audit, gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        repaired_sha256=hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def plain_damage(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if fault == 0:
        return []
    text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
    return [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def compare(spark, talks, block):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string, k string, pos long")
    got = {r["conv_id"]: r.asDict() for r in repair.report(df, repair.damaged(df), block=block).collect()}
    by = {}
    for conv, turn, role, text, *_ in talks:
        by.setdefault(conv, []).extend(plain_damage(conv, turn, role, text))
    assert set(got) == set(by)
    for conv, rows in by.items():
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == plain(rows), conv
    return got


def test_against_plain_search():
    for n in (0, 1, 2, 3):
        for code in itertools.product("suaxSUd", repeat=n):
            code = "".join(code)
            cost, audit, _, _ = repair.solved(code, repair.ACCEPTED, True)[0]
            assert (cost, audit) == searched(code) == planned(code)


def test_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(200):
        code = "".join(rng.choices("suaxSUAXd", weights=[1, 4, 4, 1, 1, 2, 2, 1, 2], k=rng.randint(4, 60)))
        cost, audit, items, _ = repair.solved(code, repair.ACCEPTED, True)[0]
        assert (cost, audit) == planned(code)
        assert len(items) == sum(e != "D" for e in audit)


def test_prices_are_feasible_and_tight_on_the_way():
    arcs = repair.rows_lattice("suauUxdda", repair.ACCEPTED, True)
    price = repair.converge(arcs)
    for layer, states in enumerate(arcs):
        for q, out in enumerate(states):
            costs = [a[0] + (0 if a[2] == repair.END else price[a[2]][a[3]]) for a in out]
            if costs:
                assert price[layer][q] == min(costs)


def test_blocks_give_the_same_as_whole_codes():
    rng = random.Random(6)
    for _ in range(60):
        code = "".join(rng.choices("suaxSUAXd", k=rng.randint(2, 40)))
        size = rng.randint(1, 7)
        parts = [code[i : i + size] for i in range(0, len(code), size)]
        transfers = [repair.transfer(p, i == len(parts) - 1) for i, p in enumerate(parts)]
        exits = repair.between(transfers)
        traced = [repair.solved(p, repair.ACCEPTED if i == len(parts) - 1 else tuple(exits[i]), i == len(parts) - 1) for i, p in enumerate(parts)]
        states = repair._chain([[None if x is None else x[3] for x in t] for t in traced])
        chosen = [t[s] for t, s in zip(traced, states, strict=True)]
        assert (sum(c[0] for c in chosen), "".join(c[1] for c in chosen)) == planned(code)


@pytest.mark.parametrize("block", [3, 256])
def test_random_conversations(spark, block):
    rng = random.Random(block)
    talks = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None, "", "ursula", "User"])
            text = rng.choice(["Ja.", "Nein!", "offen", "", " \n\t", None, "Ende. \n", " ", "é?", "a.b", "\U0001f600"])
            talks.append((conv, rng.choice([turn, turn, turn, 3, None]), role, text, "x", 1))
    compare(spark, talks, block)


def test_a_long_conversation_and_many_equal_rows(spark):
    rng = random.Random(9)
    talks = [(1, t, ("user", "assistant")[t % 2] if rng.random() < 0.8 else "system", f"t{t}.", "x", 1) for t in range(900)]
    talks += [(2, 5, "user", "same.", "x", 1)] * 700 + [(3, None, "user", f"n{i}", "x", 1) for i in range(300)]
    got = compare(spark, talks, 64)
    assert got[2]["duplicate"] >= 699


def test_conversations_that_lose_all_rows(spark):
    lost = [(c, 0) for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = compare(spark, [(c, t, "user", "x.", "x", 1) for c, t in lost], 256)
    for c, _ in lost:
        assert got[c]["audit"] == "" and got[c]["cost"] == 0 and got[c]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(none, repair.damaged(none)).collect() == []


def test_whole_table_by_rows(spark):
    got = {r["conv_id"]: r.asDict() for r in repair.op12_conversation_repair(spark, SMALL).collect()}
    by = {}
    for conv, turn, role, text in read("conversations", "conv_id, turn, role, text"):
        by.setdefault(conv, []).extend(plain_damage(conv, turn, role, text))
    assert {c: {k: v for k, v in r.items() if k != "conv_id"} for c, r in got.items()} == {c: plain(rows) for c, rows in by.items()}
