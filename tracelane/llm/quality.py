"""Operator 10: quality rules and robust multivariate outliers (DataFrame functions only).

``text_statistics`` counts what the fixed rules need. ``outliers`` gives every document the
squared Mahalanobis distance of its transformed statistics under a minimum-covariance-determinant
estimate of its language and source:

* Start: median and quartile spread per language, from histograms of the statistics.
* Concentration step: distances under the current estimate are put into a histogram per group
  that also carries the first and second moments of each bin; the bins up to the one that
  completes the share ``CORE`` of the group form the subset, whose moments are the next estimate.
  So a step is one pass with partial aggregation, and no group is ever sorted or gathered.
* The language comes first; the groups (language, source) start from it, and keep it as a prior
  that weighs as much as ``PRIOR`` documents. A small group so leans on its language without
  any switch at a size.

Statistics are whole numbers (1/256 units), so their sums are exact and every run gives the same
verdicts. Variances have a floor, as most clean documents agree fully in several statistics.

Defined cases: a null or empty text has no words and fails the base rules; null language or source
is a group of its own; repeated rows are judged alike; an empty table gives an empty result; extra
columns are ignored (``judge``) or kept (``filter_documents``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelane.llm.common import let, table, words
from tracelane.session import staged

MIN_WORDS = 50
UNIT = 256
#: Share of a group that the estimate rests on, and the factor that makes the covariance of the
#: innermost 75 % of a six-dimensional normal sample consistent.
CORE, CONSISTENT = 0.75, 1.36
PRIOR = 50
STEPS = {"language": 4, "group": 3}
#: Squared distance above which a document goes. Six dimensions: a normal sample exceeds it about
#: four times in 10^6, which leaves room for the heavier tails of real statistics.
CUTOFF = 35.0
#: Least standard deviation of each statistic, in its own (logarithmic) unit.
FLOORS = {"x_words": 0.3, "x_length": 0.08, "x_symbols": 0.35, "x_lines": 1.0, "x_repeats": 1.0, "x_upper": 0.35}
NAMES = tuple(FLOORS)
PAIRS = tuple((i, j) for i in range(len(NAMES)) for j in range(i + 1))


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Window hashes are sorted with their positions; equal neighbours mark repeated windows. No
    word leaves its row.
    """

    def of_hashes(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def at(o: Column) -> Column:
            same = F.transform(o, lambda e, k: F.when((e.h == F.get(o, k - 1).h) | (e.h == F.get(o, k + 1).h), e.i))
            return F.filter(same, lambda i: i.isNotNull())

        covered = F.flatten(F.transform(let(by_hash, at), lambda i: F.array(i, i + 1, i + 2)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(F.size(F.array_distinct(covered)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, 0).otherwise(let(hashes, of_hashes))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the base rules and those that only the outlier verdict uses, in a struct ``q``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))
    upper = F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}", ""))
    return docs.select("*", let(words(body), counts).alias("_w"), by_line.alias("_l"), symbols.cast("long").alias("_s"), upper.cast("long").alias("_u")).select(
        *docs.columns,
        F.struct("_w.*", "_l.*", F.col("_s").alias("n_symbols"), F.col("_u").alias("n_upper")).alias("q"),
    )


def base_failed(q: str = "q") -> Column:
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def _vector() -> list[Column]:
    """The transformed statistics, as whole 1/256 units."""
    q = lambda n: F.col(f"q.{n}").cast("double")
    rate = lambda n, of: F.log1p(100 * q(n) / F.greatest(q(of), F.lit(1.0)))
    values = {
        "x_words": F.log1p(q("n_words")),
        "x_length": F.log1p(q("word_chars") / F.greatest(q("n_words"), F.lit(1.0))),
        "x_symbols": rate("n_symbols", "word_chars"),
        "x_lines": rate("n_dup_lines", "n_lines"),
        "x_repeats": rate("n_repeat_words", "n_words"),
        "x_upper": rate("n_upper", "word_chars"),
    }
    return [F.round(values[n] * UNIT).cast("long").alias(n) for n in NAMES]


def _start(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Medians and quartile spreads per group, as moments: what ``_estimate`` reads."""
    long = rows.select(*keys, F.posexplode(F.array(*NAMES)).alias("v", "x"))
    bins = long.groupBy(*keys, "v", "x").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*keys, "v").orderBy("x")
    whole = Window.partitionBy(*keys, "v")
    ranked = bins.select("*", (F.sum("n").over(run) / F.sum("n").over(whole)).alias("share"))
    at = lambda p: F.min(F.when(F.col("share") >= p, F.col("x")))
    spread = ranked.groupBy(*keys, "v").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    pick = lambda v, c: F.max(F.when(F.col("v") == v, c))
    wide = spread.groupBy(*keys).agg(
        *[pick(i, F.col("mid")).cast("double").alias(f"m{i}") for i in range(len(NAMES))],
        *[pick(i, (F.col("hi") - F.col("lo")) / 1.349).alias(f"sd{i}") for i in range(len(NAMES))],
    )
    moments = [(F.col(f"m{i}") * F.col(f"m{j}") + (F.col(f"sd{i}") * F.col(f"sd{i}") if i == j else F.lit(0.0))).alias(f"c{i}_{j}") for i, j in PAIRS]
    return wide.select(*keys, *[f"m{i}" for i in range(len(NAMES))], *moments)


def _estimate(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and inverse Cholesky factor of the covariance, one row per group, in column algebra."""
    out = moments
    for i, j in PAIRS:
        floor = (FLOORS[NAMES[i]] * UNIT) ** 2
        value = (F.col(f"c{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENT
        out = out.withColumn(f"s{i}_{j}", F.greatest(value, F.lit(0.0)) + floor if i == j else value)
    for i, j in PAIRS:
        rest = reduce(lambda a, b: a - b, [F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)], F.col(f"s{i}_{j}"))
        least = (FLOORS[NAMES[i]] * UNIT) ** 2 / 2
        out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(least))) if i == j else rest / F.col(f"l{j}_{j}"))
    for j in range(len(NAMES)):
        for i in range(j, len(NAMES)):
            if i == j:
                value = 1 / F.col(f"l{i}_{i}")
            else:
                value = -reduce(lambda a, b: a + b, [F.col(f"l{i}_{k}") * F.col(f"v{k}_{j}") for k in range(j, i)]) / F.col(f"l{i}_{i}")
            out = out.withColumn(f"v{i}_{j}", value)
    return out.select(*keys, *[f"m{i}" for i in range(len(NAMES))], *[f"v{i}_{j}" for i, j in PAIRS])


def _distances(rows: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``d2``. The estimate has one narrow row per group; Spark broadcasts it where its measured size allows."""
    terms = []
    for i in range(len(NAMES)):
        z = reduce(lambda a, b: a + b, [F.col(f"v{i}_{j}") * (F.col(NAMES[j]) - F.col(f"m{j}")) for j in range(i + 1)])
        terms.append(z * z)
    return rows.join(estimate, keys).select(*rows.columns, reduce(lambda a, b: a + b, terms).alias("d2"))


def _concentrate(rows: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """One step: moments (sums) of the share ``CORE`` of each group that lies nearest."""
    near = _distances(rows, estimate, keys).withColumn("bin", F.floor(F.log1p("d2") * 64))
    sums = [F.sum(n).alias(f"t{i}") for i, n in enumerate(NAMES)]
    sums += [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"t{i}_{j}") for i, j in PAIRS]
    bins = near.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
    run = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    ranked = bins.select("*", (F.sum("n").over(run) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("all"))
    core = ranked.where(F.col("before") < CORE * F.col("all"))
    names = ["n", *[f"t{i}" for i in range(len(NAMES))], *[f"t{i}_{j}" for i, j in PAIRS]]
    return core.groupBy(*keys).agg(*[F.sum(n).cast("double").alias(n) for n in names])


def _moments(sums: DataFrame, keys: list[str], prior: DataFrame | None) -> DataFrame:
    """Sums into means; ``prior`` (means per language) counts as ``PRIOR`` documents."""
    means = [(f"m{i}", f"t{i}") for i in range(len(NAMES))] + [(f"c{i}_{j}", f"t{i}_{j}") for i, j in PAIRS]
    if prior is None:
        return sums.select(*keys, *[(F.col(t) / F.col("n")).alias(m) for m, t in means])
    both = sums.join(prior.select("_lang", *[F.col(m).alias(f"p_{m}") for m, _ in means]), "_lang")
    return both.select(*keys, *[((F.col(t) + PRIOR * F.col(f"p_{m}")) / (F.col("n") + PRIOR)).alias(m) for m, t in means])


def outliers(rows: DataFrame) -> DataFrame:
    """``rows`` (``_lang``, ``_source``, the statistics) with ``d2``; read many times, so pass a staged table."""
    lang, group = ["_lang"], ["_lang", "_source"]
    sound = rows.where(~F.col("base_failed"))
    moments = staged(_start(sound, lang))
    for _ in range(STEPS["language"]):
        moments = staged(_moments(_concentrate(sound, _estimate(moments, lang), lang), lang, None))
    start = sound.select(*group).distinct().join(moments, lang)
    current = start
    for _ in range(STEPS["group"]):
        current = staged(_moments(_concentrate(sound, _estimate(current, group), group), group, moments))
    return _distances(sound, staged(_estimate(current, group)), group)


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per input row: the counts, ``base_failed``, ``distance2`` (null if that failed) and ``kept``."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    counted = text_statistics(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), key(lang).alias("_lang"), key(source).alias("_source")), "_text")
    rows = staged(counted.select("_id", "_lang", "_source", "q", *_vector(), base_failed().alias("base_failed")))
    columns = [F.col("_id").alias(id_col), "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed"]
    good = outliers(rows).select(*columns, F.col("d2").alias("distance2"), (F.col("d2") <= CUTOFF).alias("kept"))
    failed = rows.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    return good.unionByName(failed)


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns.

    A verdict depends on text, language and source alone. So rows are told apart by these, whatever their ids:
    null or shared ids never take a good document with a bad one.
    """
    parts = [docs[c].cast("string") for c in (text, lang, source)]
    same = F.xxhash64(*parts, *[p.isNull() for p in parts])
    named = docs.select(same.alias("_gone"), docs[text].alias("text"), docs[lang].alias("lang"), docs[source].alias("source"))
    gone = judge(named, "_gone", "text", "lang", "source").where(~F.col("kept")).select("_gone").distinct()
    return docs.join(gone, same == gone["_gone"], "left_anti")


def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


REGISTERED = {"op10_quality_outliers": (op10_quality_outliers, None)}
