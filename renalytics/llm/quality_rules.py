"""Quality rules with risk-controlled thresholds (operator 13), in DataFrame functions only.

A base rule rejects texts of under ``MIN_WORDS`` words or with over half of their words in repeated windows.
What passes it is judged by cut-offs on the statistics of ``RULES``, learned from labelled documents:

1. The *learning* part of the good documents gives a path of ever stricter cut-offs.  Level j of the path cuts each
   tail where it loses at most the share ``PATH[j]`` of them; a tail takes part only where it rejects bad documents at
   ``LEAST_LIFT`` times that share at least.  A document's level is the first one that rejects it.
2. The *holdout* part counts the good documents that each level rejects, per stratum.  A level is certified when the
   exact binomial tail P(Bin(n, ``MAX_FALSE_REJECTION``) <= rejected) is at most ``ERROR / strata``: a Clopper-Pearson
   bound on the false rejection rate below the limit, with a Bonferroni correction over strata.  Levels are tested from
   lenient to strict and testing stops at the first failure, so the levels need no further correction.
3. Each stratum uses its strictest certified level, or none.

So with probability 1 - ``ERROR`` over the draw of the holdout no stratum loses more than ``MAX_FALSE_REJECTION`` of
the good documents that pass the base rule, whatever the path.  All labelled rows take part in the counts.  What comes
to the driver is bounded: histogram bins per tail (``GRID``) and levels per stratum (``MAX_STRATA``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from renalytics.llm.common import free_name
from renalytics.session import shared_path

BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"

GRID = 2000                      # values of a statistic from here on share the last bin
PATH = (0.0, 0.001, 0.002, 0.004, 0.006, 0.008, 0.01, 0.013, 0.016, 0.02, 0.025, 0.03)
LEAST_LIFT = 2.0
LEARNING = "4"                   # learning part: md5 of the id below this text (a quarter), else holdout
MAX_FALSE_REJECTION = 0.05
ERROR = 0.1
MAX_STRATA = 1000
LENGTH_CLASSES = (200, 600)      # words from which the second and third stratum begin

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The runs of non-blank characters of a text, in order."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


def repeated_words(w: Column) -> Column:
    """How many words of an array lie in a window of three that occurs twice or more (the first included).

    Windows are sorted with their places; equal ones are then neighbours.
    """
    def covered(s: Column) -> Column:
        hit = F.filter(F.transform(s, lambda x, i: F.when(
            (x["key"] == F.get(s, i - 1)["key"]) | (x["key"] == F.get(s, i + 1)["key"]), x["at"])),
            lambda at: at.isNotNull())
        places = F.flatten(F.transform(hit, lambda at: F.array(*[at + j for j in range(WINDOW)])))
        return F.size(F.array_distinct(places))

    starts = F.slice(w, F.lit(1), F.size(w) - (WINDOW - 1))
    windows = F.transform(starts, lambda x, i: F.struct(
        F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, WINDOW)]).alias("key"), i.alias("at")))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(_let(F.sort_array(windows), covered))


def statistics(text: Column) -> Column:
    """Struct of the ``BASE`` counts and ``n_lines`` (lines with a word) of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        return F.struct(n.cast("long").alias("n_lines"),
                        (n - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    worded = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    n_symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.struct(_let(words(text), of_words).alias("w"), _let(worded, of_lines).alias("l"),
                    n_symbols.cast("long").alias("n_symbols"))


def _per(n: str, scale: int, of: str) -> str:
    return f"least({scale} * {n} div greatest({of}, 1), {GRID - 1})"


#: Statistic -> (whole number from 0 to GRID - 1, the tail that is rejected)
RULES = {
    "symbols_high": (_per("n_symbols", 1000, "n_words"), "high"),
    "repeats_high": (_per("n_repeat_words", 1000, "n_words"), "high"),
    "dup_lines_high": (_per("n_dup_lines", 1000, "n_lines"), "high"),
    "word_length_high": (_per("word_chars", 100, "n_words"), "high"),
    "word_length_low": (_per("word_chars", 100, "n_words"), "low"),
}


def length_class() -> Column:
    """The default stratum: class of the number of words."""
    out = F.lit(0)
    for i, start in enumerate(LENGTH_CLASSES):
        out = F.when(F.col("n_words") >= start, i + 1).otherwise(out)
    return out


def _badness(rule: str) -> Column:
    """The rule's statistic turned so that larger is worse: the document is rejected from a cut-off upwards."""
    value, tail = RULES[rule]
    return F.expr(value) if tail == "high" else F.lit(GRID - 1) - F.expr(value)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics of every whole text instead of the text, and ``base_failed``.

    An input column with the name of an added one is replaced.
    """
    added = {*BASE, "n_lines", "base_failed"}
    keep = [c for c in docs.columns if c != text_col and c.lower() not in added]
    made = free_name(docs, "made")
    found = docs.select(*keep, statistics(docs[text_col]).alias(made))
    out = found.select(*keep, f"{made}.w.n_words", f"{made}.w.word_chars", f"{made}.n_symbols", f"{made}.l.n_dup_lines",
                       f"{made}.w.n_repeat_words", f"{made}.l.n_lines")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def path_of_cutoffs(learning: DataFrame) -> DataFrame:
    """(rule, level, cutoff): a level rejects badness >= cutoff; ``learning`` has ``good`` and the statistics.

    One histogram per rule over all learning rows; its bins are at most ``GRID``.
    """
    bins = (learning.select("good", F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), _badness(r).alias("bin")) for r in RULES])))
        .groupBy("rule", "bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    down = Window.partitionBy("rule").orderBy(F.desc("bin"))
    whole = Window.partitionBy("rule")
    shares = bins.select("rule", "bin", (F.sum("good").over(down) / F.sum("good").over(whole)).alias("good_share"),
                         (F.sum("bad").over(down) / F.sum("bad").over(whole)).alias("bad_share"))
    usable = shares.where(F.col("bad_share") >= LEAST_LIFT * F.col("good_share")).where("bad_share > 0")
    levels = F.array(*[F.struct(F.lit(j).alias("level"), F.lit(q).alias("most")) for j, q in enumerate(PATH)])
    return (usable.select("rule", "bin", "good_share", F.inline(levels)).where("good_share <= most")
            .groupBy("rule", "level").agg(F.min("bin").alias("cutoff")))


def level_of(cutoffs: list) -> Column:
    """The first level that rejects a row, by (rule, level, cutoff) rows; null if none does."""
    firsts = []
    for rule in RULES:
        own = sorted((c["level"], c["cutoff"]) for c in cutoffs if c["rule"] == rule)
        first = F.lit(None).cast("int")
        for level, cutoff in reversed(own):
            first = F.when(_badness(rule) >= cutoff, level).otherwise(first)
        firsts.append(first)
    return F.array_min(F.filter(F.array(*firsts), lambda x: x.isNotNull()))


def _log_factorial(n: Column) -> Column:
    """ln n! from Stirling's series at n + 11, stepped down; relative error below 1e-12."""
    z = n + 11.0
    series = ((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
              + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5)))
              - 1 / (1680 * F.pow(z, F.lit(7))))
    steps = F.log(n + 1.0)
    for i in range(2, 11):
        steps = steps + F.log(n + float(i))
    return series - steps


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= x), summed from the largest term down; 1 where x is not below the mean.

    There the true value is over a half in any case.  Below the mean the term j places down is at most
    exp(-j^2 / 2np) of the first, so the terms beyond 9 sqrt(np) change nothing in double precision.
    """
    x, n = x.cast("double"), n.cast("double")
    first = F.exp(_log_factorial(n) - _log_factorial(x) - _log_factorial(n - x)
                  + x * math.log(p) + (n - x) * math.log1p(-p))
    terms = F.least(x, F.ceil(9 * F.sqrt(n * p)) + 1).cast("int")
    down = F.aggregate(
        F.sequence(F.lit(0), terms), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, j: F.struct((acc["term"] * (x - j) * (1 - p) / ((n - x + j + 1) * p)).alias("term"),
                                (acc["total"] + acc["term"]).alias("total")),
        lambda acc: acc["total"])
    return F.when(x >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), first * down))


def certified_levels(holdout: DataFrame, stratum: str, limit: float = MAX_FALSE_REJECTION,
                     error: float = ERROR) -> DataFrame:
    """(stratum, certified): the strictest level of each stratum whose test and all before it pass; -1 for none.

    ``holdout`` holds the good holdout rows with ``level`` (null: never rejected).
    """
    per_level = holdout.groupBy(stratum, "level").agg(F.count(F.lit(1)).alias("rows"))
    strata = per_level.groupBy(stratum).agg(F.sum("rows").alias("n"), F.collect_list(
        F.when(F.col("level").isNotNull(), F.struct("level", "rows"))).alias("found"))
    strata = strata.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    levels = strata.select(stratum, "n", "strata", "found", F.explode(F.array(*map(F.lit, range(len(PATH))))).alias("j"))
    rejected = F.aggregate("found", F.lit(0).cast("long"), lambda t, f: t + F.when(f["level"] <= F.col("j"), f["rows"]).otherwise(0))
    tested = levels.withColumn("p", binomial_tail(rejected, F.col("n"), limit))
    return tested.groupBy(stratum).agg(F.coalesce(
        F.min(F.when(F.col("p") > F.lit(error) / F.col("strata"), F.col("j"))), F.lit(len(PATH))).alias("failed")
    ).select(stratum, (F.col("failed") - 1).alias("certified"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", stratum: Column | None = None,
          limit: float = MAX_FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """Every row of ``docs`` without its text, with the ``BASE`` counts, ``base_failed`` and ``kept``.

    ``labels`` (id_col, label_col 0/1) marks good documents by 1; an id with several labels takes the largest, null
    ids and labels teach nothing.  ``stratum`` is a column over ``docs`` and the statistics (default: the class of
    length); null is a stratum of its own, and over ``MAX_STRATA`` of them are refused.  A text that is null or
    has no word fails the base rule.  Without labels, or in a stratum with too few of them to certify a level, all
    that passes the base rule is kept.  Repeated rows stay; an empty table gives an empty one; an input
    column with the name of an added one is replaced.
    """
    spark = docs.sparkSession
    added = {*BASE, "n_lines", "base_failed", "kept"}
    keep = [c for c in docs.columns if c != text_col and c.lower() not in added]
    place, group, mark, level, certified = (free_name(docs, c) for c in ("place", "stratum", "good", "level", "certified"))
    path = shared_path(spark, "quality-rules")
    found = measured(docs.select(*keep, text_col), text_col)
    found.withColumn(group, (length_class() if stratum is None else stratum).cast("string")).write.parquet(path)
    table = spark.read.parquet(path)

    marks = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias(place)).agg((F.max(label_col) >= 1).alias("good")))
    labelled = (table.where(~F.col("base_failed")).select(F.col(id_col).alias(place), F.col(group).alias("stratum"), *BASE, "n_lines")
                .join(marks, place).withColumn("learning", F.md5(F.col(place).cast("string").cast("binary")) < LEARNING))
    labelled_path = shared_path(spark, "quality-labelled")
    labelled.write.parquet(labelled_path)
    labelled = spark.read.parquet(labelled_path)

    cutoffs = path_of_cutoffs(labelled.where("learning")).collect()
    holdout = labelled.where("good AND NOT learning").select("stratum", level_of(cutoffs).alias("level"))
    verdicts = certified_levels(holdout, "stratum", limit, error).limit(MAX_STRATA + 1).collect()
    if len(verdicts) > MAX_STRATA:
        raise ValueError(f"over {MAX_STRATA} strata")
    # Bounded by MAX_STRATA rows.
    allowed = spark.createDataFrame([(r["stratum"], r["certified"]) for r in verdicts], f"{group}_ string, {certified} int")
    judged = table.join(F.broadcast(allowed), F.col(group).eqNullSafe(F.col(f"{group}_")), "left").withColumn(level, level_of(cutoffs))
    rejected = F.coalesce(F.col(level) <= F.coalesce(F.col(certified), F.lit(-1)), F.lit(False))
    return judged.select(*keep, *BASE, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
