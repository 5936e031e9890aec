"""Operator 3: chat formatting in budgeted windows (DataFrame functions only).

Prefix sums of turn tokens choose the windows: a turn belongs to the window in whose stride its last token
falls, so spans are aligned to turns and every turn is new in exactly one window. A turn longer than
a stride has a window of its own. With ``stride = 3/8`` of the budget a window holds less than 3/4 of it in
new turns (one long turn apart); up to ``history`` earlier turns within 1/8 of it are repeated in front, and
the first system turn is kept in every window. Repeated turns are context: only assistant texts that are
new in a window lie under its loss mask.

Prefix sums have two levels: inside blocks of 256 turn numbers, and over one row per block. So a very long
conversation is not sorted in one task.

A turn is ``<|turn|>role\\ntext<|end|>``. In roles and texts ``~``, ``<``, ``[`` (and a role's line end) are
written ``~0``, ``~1``, ``~2``, ``~3``, so no text can hold a control string, of this template or the usual
others, and every text is read back exactly.

Defined cases: null text or role is empty; rows are ordered by turn, then role and text, nulls first;
repeated rows are turns of their own; null conversation ids form one conversation; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelane.llm.common import let, table
from tracelane.session import staged

BUDGET = 1024
HISTORY = 2
BLOCK_TURNS = 256
OPEN, END = "<|turn|>", "<|end|>"
#: Tokens that the marks of a turn count for.
MARKS = 4


def escaped(text: Column) -> Column:
    for plain, mark in (("~", "~0"), ("<", "~1"), ("[", "~2")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    for plain, mark in (("\n", "~3"), ("[", "~2"), ("<", "~1"), ("~", "~0")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def token_count(text: Column) -> Column:
    """Words and single marks: the measure that needs no tokenizer. Any other column expression may take its place."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")).cast("long")


def _turns(talks: DataFrame, conv: str, turn: str, role: str, text: str, budget: int) -> DataFrame:
    """Turns with position, tokens and window, per conversation key ``k``."""
    stride = budget * 3 // 8
    rows = talks.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("null")).alias("k"),
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select("*", (token_count(F.col("text")) + MARKS).alias("tokens"), F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 60))).alias("block"))
    short = F.when(F.col("tokens") <= stride, F.col("tokens")).otherwise(0)
    rows = staged(rows.select("*", short.alias("short"), (F.col("tokens") > stride).cast("long").alias("long")))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inside = Window.partitionBy("k", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", F.count(F.lit(1)).over(inside).alias("n_in"), F.sum("short").over(inside).alias("s_in"), F.sum("long").over(inside).alias("l_in"))
    blocks = rows.groupBy("k", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("short").alias("s"), F.sum("long").alias("l"))
    before = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("k", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_b") for c in ("n", "s", "l")])
    at = local.join(carried, ["k", "block"]).select(
        "k", "conv_id", "role", "text", "tokens", (F.col("n_in") + F.col("n_b")).alias("pos"), (F.col("s_in") + F.col("s_b")).alias("upto"), (F.col("l_in") + F.col("l_b")).alias("longs"), "long"
    )
    slot = F.when(F.col("long") == 1, F.lit(-1)).otherwise(F.floor((F.col("upto") - 1) / stride))
    return at.select("k", "conv_id", "role", "text", "tokens", "pos", F.struct(F.col("longs").alias("a"), F.col("long").alias("b"), slot.alias("c")).alias("w"))


def windows(talks: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: ``conv_id``, ``window`` (position of its first new turn), ``n_context`` repeated turns
    in front, ``n_new``, ``formatted`` and ``loss_spans`` ([start, end) in code points)."""
    turns = staged(_turns(talks, conv, turn, role, text, budget))
    new = turns.groupBy("k", "w").agg(
        F.min("conv_id").alias("conv_id"), F.min("pos").alias("window"), F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("new")
    )  # a window's turns fit its budget, with MARKS tokens at least each
    system = turns.where("role = 'system'").groupBy("k").agg(F.min("pos").alias("sys_pos"))
    system = turns.join(system, "k").where("pos = sys_pos").select("k", "sys_pos", F.col("text").alias("sys_text"))
    starts = new.select("k", F.col("window").alias("at"))
    ahead = turns.select("k", "pos", "role", "text", "tokens", F.explode(F.sequence(F.lit(1), F.lit(history))).alias("d")) if history else turns.where("false").withColumn("d", F.lit(1))
    past = ahead.join(starts, (ahead["k"] == starts["k"]) & (ahead["pos"] + ahead["d"] == starts["at"])).select(ahead["k"], F.col("at").alias("window"), F.struct("d", "tokens", "pos", "role", "text").alias("p"))
    past = past.groupBy("k", "window").agg(F.sort_array(F.collect_list("p")).alias("past"))
    room = budget // 8

    def fitting(p: Column) -> Column:
        within = F.filter(p, lambda x: F.aggregate(F.filter(p, lambda y: y.d <= x.d), F.lit(0).cast("long"), lambda a, y: a + y.tokens) <= room)
        return F.reverse(F.transform(within, lambda x: F.struct(x.pos.alias("pos"), x.role.alias("role"), x.text.alias("text"))))

    none = F.array().cast("array<struct<pos:long,role:string,text:string>>")
    both = new.join(past, ["k", "window"], "left").join(system, "k", "left")
    shown = F.coalesce(let(F.col("past"), fitting), none)
    head = F.when(F.col("sys_pos") < F.col("window"), F.array(F.struct(F.col("sys_pos").alias("pos"), F.lit("system").alias("role"), F.col("sys_text").alias("text")))).otherwise(none)
    both = both.select("conv_id", "window", "new", F.concat(head, F.filter(shown, lambda t: ~t.pos.eqNullSafe(F.col("sys_pos")))).alias("context"))

    def step(acc: Column, t: Column) -> Column:
        front = F.concat(F.lit(OPEN), F.replace(escaped(t.role), F.lit("\n"), F.lit("~3")), F.lit("\n"))
        body = escaped(t.text)
        start = acc.at + F.length(front)
        end = start + F.length(body)
        masked = (t.role == "assistant") & (t.pos >= F.col("window"))
        return F.struct(
            (end + len(END)).alias("at"),
            F.array_append(acc.parts, F.concat(front, body, F.lit(END))).alias("parts"),
            F.when(masked, F.array_append(acc.spans, F.struct(start.alias("start"), end.alias("end")))).otherwise(acc.spans).alias("spans"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    built = both.select("*", F.aggregate(F.concat("context", "new"), start, step).alias("f"))
    return built.select(
        "conv_id", "window", F.size("context").alias("n_context"), F.size("new").alias("n_new"), F.array_join("f.parts", "").alias("formatted"), F.col("f.spans").alias("loss_spans")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From the formatted windows alone: the new ``turns`` (role, text) and the texts under the ``loss`` mask, unescaped."""

    def parsed(t: Column) -> Column:
        rest = F.substring(t, F.lit(len(OPEN) + 1), F.length(t))
        cut = F.instr(rest, F.lit("\n"))
        return F.struct(unescaped(F.substring(rest, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(rest, cut + 1, F.length(rest))).alias("text"))

    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    own = F.slice(pieces, F.col("n_context") + 1, F.greatest(F.size(pieces) - F.col("n_context"), F.lit(0)))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
    return formatted.select("conv_id", "window", F.transform(own, parsed).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what the windows say when read back. A digest needs a conversation's whole text in one value."""
    parts = F.struct("window", "turns", "loss")
    whole = read_back(formatted).groupBy("conv_id").agg(F.sort_array(F.collect_list(parts)).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("w", lambda x: x.turns))
    loss = F.array_join(F.flatten(F.transform("w", lambda x: x.loss)), "")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return whole.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(windows(talks))


REGISTERED = {"op3_chat_windows": (op3_chat_windows, None)}
