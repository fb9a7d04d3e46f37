"""Exact, interpolated quantiles without collecting a column into one task.

``percentile``/``median`` are exact but merge every distinct value of a group in one task; ``percentile_approx`` scales
but is not exact (median of 1,2,3,4 is 2.0, not 2.5).  Here each target, a quantile of a (group, column), has a *bracket*
of values that holds its two ranks ``floor((n-1)q)`` and ``ceil((n-1)q)``:

1. one aggregate gives ``n``, min, max and the approximate quantiles just beside the target;
2. a round cuts every open bracket into ``BINS`` bins and takes count, least and greatest value of each.  The running
   count over the bins (never over the data) tells which bins hold the two ranks.  If they differ, the values are the
   greatest of the one and the least of the other; if the bin holds one value, that is it; else the bin is the next
   bracket.  A bracket that missed its ranks falls back to [min, max].

The least and the greatest value of a bracket always come into different bins, so every round gets closer; brackets are cut
by sign, by logarithm or evenly, so a few rounds do for values of all magnitudes.  After the first round only the values inside open brackets are read again.  Linear
interpolation as in pandas / DuckDB ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BINS = 4096
FEW_TARGETS = 50_000  # targets (group, column, quantile) up to which they are broadcast to the values


def _long(df: DataFrame, cols: list[str], group_cols: list[str]) -> DataFrame:
    structs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
               for c in cols]
    return (df.select(*group_cols, F.explode(F.array(*structs)).alias("kv"))
            .select(*group_cols, "kv.column", "kv.value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where a NULL group equals a NULL group."""
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"__{k}" for k in keys])


def _beside(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the brackets of their targets.

    Few targets are broadcast: columns and groups are hot keys, and a shuffle by them would give one task a whole column
    (with few keys most partitions are empty, so AQE keeps such a join sorted).  Many targets mean many keys.
    """
    brackets = targets.select(*dict.fromkeys([*keys, "q", "lo", "hi"]))
    return _same(values, F.broadcast(brackets) if targets.count() <= FEW_TARGETS else brackets, keys)


def _targets(long: DataFrame, qs: list[float], keys: list[str], accuracy: int) -> DataFrame:
    """(keys, q, pos, r_lo, r_hi, vmin, vmax, lo, hi): ranks and first bracket of each target."""
    margin = 3.0 / accuracy
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"),
        F.percentile_approx("value", F.array(*[F.lit(max(0.0, q - margin)) for q in qs]), accuracy).alias("alo"),
        F.percentile_approx("value", F.array(*[F.lit(min(1.0, q + margin)) for q in qs]), accuracy).alias("ahi"))
    each = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.get("alo", F.lit(i)).alias("lo"), F.get("ahi", F.lit(i)).alias("hi"))
                     for i, q in enumerate(qs)])
    pos = (F.col("n") - 1).cast("double") * F.col("q")
    return (stats.select(*keys, "n", "vmin", "vmax", F.inline(each)).withColumn("pos", pos)
            .select(*keys, "q", "pos", F.floor("pos").alias("r_lo"), F.ceil("pos").alias("r_hi"), "vmin", "vmax", "lo", "hi"))


def _round(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """``targets`` with ``a`` and ``b``, the bins of their two ranks: (bin, least, greatest, rows before).

    ``rows`` are (keys, q, lo, hi, value, weight), one per value and target.
    """
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    low, high = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
    # Brackets over zero are cut by sign, those over many magnitudes by logarithm, all others evenly.
    by_log = F.try_divide(F.log(F.abs(v)) - F.log(low), F.log(high) - F.log(low))
    evenly = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)
    share = (F.when((lo < 0) & (hi > 0), (F.signum(v) + 2) / 4).when((low > 0) & (high > 1e4 * low), F.when(lo > 0, by_log).otherwise(1 - by_log))
             .otherwise(evenly))
    share = F.nanvl(F.coalesce(share, F.lit(0.5)), F.lit(0.5))
    inner = F.least(F.greatest(F.floor(share * BINS), F.lit(0)), F.lit(BINS - 1))
    place = (F.when(v < lo, -1).when(v > hi, BINS).when(v == lo, 0).when(v == hi, BINS - 1).otherwise(inner)).cast("int")
    bins = (rows.select(*keys, place.alias("bin"), "value", "weight").groupBy(*keys, "bin")
            .agg(F.sum("weight").alias("rows"), F.min("value").alias("least"), F.max("value").alias("greatest")))
    along = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most BINS + 2 rows
    ends = _same(bins.withColumn("end", F.sum("rows").over(along)), targets.select(*keys, "r_lo", "r_hi", "below"), keys)
    ends = ends.withColumn("end", F.col("end") + F.col("below")).withColumn("start", F.col("end") - F.col("rows"))
    here = F.struct("bin", "least", "greatest", "start")
    found = ends.groupBy(*keys).agg(*[
        F.max(F.when((F.col("start") <= F.col(r)) & (F.col(r) < F.col("end")), here)).alias(side) for r, side in (("r_lo", "a"), ("r_hi", "b"))])
    return _same(targets, found, keys, "left")


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float],
                    group_cols: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """Long table ``(group..., column, q, value)`` of exact interpolated quantiles."""
    by = [*(group_cols or []), "column"]
    keys = [*by, "q"]
    values = _long(df, cols, by[:-1]).withColumn("weight", F.lit(1).cast("long"))
    targets = cut_lineage(_targets(values, qs, by, accuracy).withColumn("below", F.lit(0).cast("long")))
    rows = _beside(values, targets, by)
    out, whole = None, False
    while True:
        seen = cut_lineage(_round(rows, targets, keys))
        inside = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a.bin") >= 0) & (F.col("b.bin") < BINS)
        known = inside & ((F.col("a.bin") != F.col("b.bin")) | (F.col("a.least") == F.col("a.greatest")))
        v_lo, v_hi = F.col("a.greatest"), F.col("b.least")
        value = F.when(v_lo == v_hi, v_lo).otherwise(v_lo + (F.col("pos") - F.col("r_lo")) * (v_hi - v_lo))
        done = seen.where(known).select(*keys, value.alias("value"))
        out = done if out is None else out.unionByName(done)
        todo = seen.where(~known).withColumn("inside", inside)
        if todo.isEmpty():
            return out
        kept = [*keys, "pos", "r_lo", "r_hi", "vmin", "vmax"]
        missed = todo.where(~F.col("inside")).select(*kept, F.col("vmin").alias("lo"), F.col("vmax").alias("hi"), "below")
        if not whole and not missed.isEmpty():
            # A first bracket missed its ranks: the whole range is sure to hold them.
            rescued = _round(_beside(values, missed, by), missed, keys)
            todo = todo.where("inside").drop("inside").unionByName(rescued, allowMissingColumns=True)
        targets = cut_lineage(todo.select(*kept, F.col("a.least").alias("lo"), F.greatest("a.greatest", "b.greatest").alias("hi"),
                                          F.col("a.start").alias("below")))
        source = _beside(values, targets, by) if not whole else _beside(rows.drop("lo", "hi"), targets, keys)
        # From here on only values inside open brackets are read; a hot value is one row.
        rows = cut_lineage(source.where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
                           .groupBy(*keys, "lo", "hi", "value").agg(F.sum("weight").alias("weight")))
        whole = True


def medians_row(df: DataFrame, cols: list[str], accuracy: int = 10_000) -> DataFrame:
    """One row with one exact median per column (for scalar use)."""
    q = exact_quantiles(df, cols, [0.5], accuracy=accuracy)
    return q.agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in cols])
