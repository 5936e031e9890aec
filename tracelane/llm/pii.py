"""Operator 1: personal data by patterns and by bootstrapped contexts (DataFrame functions only).

Base spans (e-mail, ip, card, phone) come from regular expressions. Java's engine recurses on repeated
groups, so each pattern here is an equal form without one: single-character classes, look-arounds and
possessive runs, which neither overflow nor retry inside a run.

The contextual part starts from the base spans as seeds. Candidates are the other tokens that carry three
digits or an ``@``. A lexical pattern is the two words before a span (digits folded to 0).
Patterns and instances (distinct values) form a graph that Spark scores in turns: the confidence of a
pattern is the summed score of its instances over their number, plus the times the pattern
stands before an ordinary word in any document, plus ``DOUBT``; an instance that is no seed has the best confidence among its
patterns. Values that reach ``ACCEPT`` are spans of kind ``context`` wherever they stand as candidates.
The edges are aggregated by pattern and value before each join, so a phrase that a third of all
documents share costs one row.

Defined cases: a null or empty text has no spans; repeated rows get equal results, one each; null ids are kept;
an empty table gives an empty result; other columns are ignored (``find``) or kept (``mask``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm.common import let, table, words
from tracelane.session import staged

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9.-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-]){_HOST}+?(?=\.?(?!{_HOST})|\.\.)",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?[0-9](?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth trying.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D@]*+@|(?:[^\x20\x09-\x0D0-9]*+[0-9]){3})[^\x20\x09-\x0D]++"

#: A text without this has neither spans nor candidates.
WORTH = "[0-9@]"

TURNS = 4
MIN_SUPPORT = 3
DOUBT = 1.0
ACCEPT = 0.6
CONTEXT_CHARS = 80
#: Patterns that may be listed in a plan.
LISTED = 4096


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    terms = F.transform(
        F.sequence(F.lit(1), F.length(back)),
        lambda i: let(F.substring(back, i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))),
    )
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda s: (F.length(s) < 3) | ((F.length(s) == 3) & (s <= "255"))))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _found(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value), from the texts between them and the matches themselves.

    The last piece runs to the end of the text, so that the engine never starts over behind the last match.
    """
    pieces = F.lit(f"(?s)(.*?)(?:({pattern})|\\z)")
    gaps, hits = F.regexp_extract_all(text, pieces, F.lit(1)), F.regexp_extract_all(text, pieces, F.lit(2))
    none = F.array().cast("array<struct<start:long,end:long,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + F.length(x.gap)
        end = start + F.length(x.hit)
        span = F.struct(start.alias("start"), end.alias("end"), x.hit.alias("value"))
        return F.struct(end.alias("at"), F.when(x.hit == "", acc.spans).otherwise(F.array_append(acc.spans, span)).alias("spans"))

    both = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    return F.aggregate(both, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda a: a.spans)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) by kind and start; offsets in code points, end exclusive."""
    none = F.array().cast("array<struct<kind:string,start:long,end:long,value:string>>")
    parts = []
    for kind in KINDS:
        parts.append(F.when(text.rlike(NEEDS[kind]), _of_kind(text, kind)).otherwise(none))
    return F.concat(*parts)


def _of_kind(text: Column, kind: str) -> Column:
    good = F.filter(_found(text, PATTERNS[kind]), lambda s: _holds(kind, s.value))
    return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value")))


def _left_words(text: Column, start: Column) -> Column:
    """The two words before a position, lower-cased, digits folded; null if there are none.

    They are looked for in ``CONTEXT_CHARS`` characters first, and in the whole text before the position where those
    do not hold two words from their first letter on.
    """
    near = F.substring(text, F.greatest(start - CONTEXT_CHARS + 1, F.lit(1)).cast("int"), F.least(start, F.lit(CONTEXT_CHARS)).cast("int"))
    last = lambda w: F.array_join(F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), w), -2, 2), " ")
    whole = last(words(F.substring(text, F.lit(1), start.cast("int"))))
    found = let(words(near), lambda w: F.when((F.size(w) > 2) | (start <= CONTEXT_CHARS), last(w)).otherwise(whole))
    return F.nullif(F.regexp_replace(F.lower(found), "[0-9]", "0"), F.lit("^ ^"))


def scan(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per input row: ``spans`` (base) and ``others``, the remaining candidates, with their left words."""
    body = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).select("id", body.alias("text"))
    worth = F.col("text").rlike(WORTH)
    empty = F.array().cast("array<struct<kind:string,start:long,end:long,value:string>>")
    based = plain.withColumn("base", F.when(worth, base_spans(F.col("text"))).otherwise(empty))
    with_left = F.transform("base", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value"), _left_words(F.col("text"), s.start).alias("left")))

    def trimmed(t: Column) -> Column:
        head = F.length(F.regexp_extract(t.value, r"^[^A-Za-z0-9]*", 0))
        core = F.regexp_replace(F.regexp_replace(t.value, r"^[^A-Za-z0-9]+", ""), r"[^A-Za-z0-9]+$", "")
        return F.struct((t.start + head).alias("start"), (t.start + head + F.length(core)).alias("end"), core.alias("value"))

    tokens = F.transform(_found(F.col("text"), CANDIDATE), trimmed)
    free = F.filter(tokens, lambda t: (t.end > t.start) & ~F.exists("base", lambda s: (s.start < t.end) & (t.start < s.end)))
    others = F.transform(free, lambda t: F.struct(F.lit("context").alias("kind"), t.start.alias("start"), t.end.alias("end"), t.value.alias("value"), _left_words(F.col("text"), t.start).alias("left")))
    none = F.array().cast("array<struct<kind:string,start:long,end:long,value:string,left:string>>")
    return based.select("id", F.xxhash64("text").alias("h"), F.when(worth, with_left).otherwise(none).alias("spans"), F.when(worth, others).otherwise(none).alias("others"))


def spoken_pairs(docs: DataFrame, text: str, shared: DataFrame, listed: int = LISTED) -> DataFrame:
    """How often each pattern of ``shared`` stands in the words of all of the documents.

    Up to ``listed`` patterns are a list that the scan itself tests, so each task counts these alone. With more, all
    word pairs are counted before the join. Either way what is shuffled is counts, one per (task, pair) at most.
    """
    low = F.regexp_replace(F.lower("text"), "[0-9]", "0")
    pairs = let(words(low), lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))))
    spoken = docs.select(F.col(text).cast("string").alias("text")).select(F.explode(pairs).alias("pattern"))
    names = [r["pattern"] for r in shared.select("pattern").limit(listed + 1).collect()]
    counts = (spoken.where(F.col("pattern").isin(names)) if len(names) <= listed else spoken).groupBy("pattern").agg(F.count(F.lit(1)).alias("spoken"))
    return counts if len(names) <= listed else counts.join(shared.select("pattern"), "pattern", "left_semi")


def discovered(scanned: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Values of candidates that high-confidence patterns find, with their score."""
    named = lambda c, seed: scanned.select(F.explode(c).alias("s")).where("s.left is not null").select(F.col("s.left").alias("pattern"), F.col("s.value").alias("value"), F.lit(seed).alias("seed"))
    seen = named("spans", 1.0).unionByName(named("others", 0.0)).groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("times"))
    edges = staged(seen)
    # Only patterns with several values, and one candidate at least to decide on, can matter.
    shared = staged(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("times").alias("times"), F.min("seed").alias("least")).where((F.col("values") >= MIN_SUPPORT) & (F.col("least") == 0)))
    spoken = spoken_pairs(docs, text, shared)
    plain = shared.join(spoken, "pattern", "left").select("pattern", F.greatest(F.coalesce("spoken", F.lit(0)) - F.col("times"), F.lit(0)).alias("elsewhere"))
    graph = staged(edges.join(plain, "pattern").select("pattern", "value", "seed", "elsewhere"))
    score = graph.groupBy("value").agg(F.max("seed").alias("score"))
    for _ in range(TURNS):
        rated = graph.join(score, "value").groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + F.max("elsewhere") + DOUBT)).alias("confidence"))
        score = staged(graph.join(rated, "pattern").groupBy("value").agg(F.greatest(F.max("seed"), F.max("confidence")).alias("score"), F.max("seed").alias("seed")))
    return score.where((F.col("seed") < 1) & (F.col("score") >= ACCEPT)).select("value", "score")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id``, the text's hash ``h`` and ``spans`` (kind, start, end), base kinds first."""
    scanned = staged(scan(docs, id_col, text))
    short = lambda c: F.transform(c, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    found = scanned.where(F.size("others") > 0).select("id", "h", F.explode("others").alias("s")).join(discovered(scanned, docs, text).select(F.col("value").alias("v")), F.col("s.value") == F.col("v"))
    extra = found.groupBy(F.col("id").alias("i"), F.col("h").alias("k")).agg(F.sort_array(F.collect_set(F.struct("s.kind", "s.start", "s.end"))).alias("extra"))
    whole = scanned.select("id", "h", short("spans").alias("base")).join(extra, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")), "left")
    return whole.select("id", "h", "base", F.concat("base", F.coalesce("extra", F.array().cast("array<struct<kind:string,start:long,end:long>>"))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    of = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return find(docs, id_col, text).select(F.col("id").alias(id_col), *[of(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span as ``[KIND]``; overlapping spans become one, named after the first."""
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int")), F.lit("["), F.upper(s.kind), F.lit("]"))
        return F.struct(
            F.greatest(acc.at, s.end).alias("at"),
            F.when(s.start >= acc.at, F.array_append(acc.parts, piece)).otherwise(acc.parts).alias("parts"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    end = lambda a: F.concat(F.array_join(a.parts, ""), F.substring(text, (a.at + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(by_start, start, step, end)).otherwise(text)


def mask(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with personal data masked in ``text``; same rows and columns."""
    spans = find(docs, id_col, text).where(F.size("spans") > 0).select(F.col("id").alias("_i"), F.col("h").alias("_h"), F.col("spans").alias("_spans")).dropDuplicates(["_i", "_h"])
    worth = F.coalesce(F.col(text).cast("string").rlike(WORTH), F.lit(False))
    tried = docs.where(worth)  # all others can have no span and are not shuffled
    both = tried.join(spans, tried[id_col].eqNullSafe(spans["_i"]) & (F.xxhash64(tried[text].cast("string")) == spans["_h"]), "left")
    new = F.when(spans["_spans"].isNotNull(), masked(tried[text].cast("string"), spans["_spans"])).otherwise(tried[text].cast("string"))
    return docs.where(~worth).unionByName(both.select(*[new.alias(c) if c == text else tried[c] for c in docs.columns]))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


REGISTERED = {"op1_personal_data": (op1_personal_data, None)}
