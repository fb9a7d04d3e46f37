"""Profiling operators.

Each profile is a single aggregate pass (partial aggregation in every task, a
small final merge) whose one wide row is turned long with ``inline``; grouped
counts are zero-filled against fixed spines.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions import exprs as X
from ..functions import fixed
from ..functions.spec import COHORT_SPEC, ColumnSpec
from .quantiles import exact_quantiles
from .spine import value_range, int_spine, literal_spine


def _long(wide: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row wide aggregate into ``(column, field...)`` rows."""
    arr = F.array(*[F.struct(F.lit(n).alias("column"),
                             *[F.col(fmt.format(n)).alias(f) for f, fmt in fields.items()])
                    for n in names])
    return wide.select(F.inline(arr))


# B1 -------------------------------------------------------------------------
def null_counts(df: DataFrame, only_with_nulls: bool = True) -> DataFrame:
    """``(column, n_null)`` in one pass; by default only columns with NULLs."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__n") for c in df.columns])
    out = _long(wide, df.columns, {"n_null": "{}__n"}).select(
        "column", F.col("n_null").cast("bigint").alias("n_null"))
    return out.where(F.col("n_null") > 0) if only_with_nulls else out


# B2 -------------------------------------------------------------------------
def table_info(df: DataFrame) -> DataFrame:
    """Per column: ordinal, type, non-NULL count and the table's row count."""
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count(F.col(c)).alias(f"{c}__nn") for c in df.columns])
    arr = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
                             F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                             F.col(f"{c}__nn").alias("non_null"))
                    for i, c in enumerate(df.columns)])
    return wide.select(F.col("__rows").alias("n_rows"), F.inline(arr)).select(
        "ordinal", "column", "dtype", F.col("non_null").cast("bigint").alias("non_null"),
        F.col("n_rows").cast("bigint").alias("n_rows"))


def head(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    """First ``n`` rows by key (top-k: the limit is the feature)."""
    return df.orderBy(order_by).limit(n)


# B3 -------------------------------------------------------------------------
def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def describe(df: DataFrame, cols: list[str] | None = None, decimals: int = 6) -> DataFrame:
    """count, mean, sample std, min, exact interpolated quartiles, max."""
    cols = cols or numeric_columns(df)
    wide = df.agg(*[a for c in cols for a in (
        F.count(c).alias(f"{c}__count"), F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
        F.stddev_samp(F.col(c).cast("double")).alias(f"{c}__std"),
        F.min(F.col(c).cast("double")).alias(f"{c}__min"),
        F.max(F.col(c).cast("double")).alias(f"{c}__max"))])
    moments = _long(wide, cols, {k: "{}__" + k for k in ("count", "mean", "std", "min", "max")})
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("column").agg(*[F.max(F.when(F.col("q") == v, F.col("value"))).alias(n)
                                   for v, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    r = lambda c: X.round_half_up(c, decimals)
    return moments.join(qw, "column", "left").select(
        "column", F.col("count").cast("bigint").alias("count"), r("mean").alias("mean"),
        r("std").alias("std"), r("min").alias("min"), r("q25").alias("q25"),
        r("q50").alias("q50"), r("q75").alias("q75"), r("max").alias("max"))


# B4 -------------------------------------------------------------------------
def dataset_summary(df: DataFrame, spec: ColumnSpec = COHORT_SPEC) -> DataFrame:
    """One-row summary; ``avg_egfr`` is NULL when the column is absent."""
    y = F.col(spec.target)
    null_total = X.add_all([F.count_if(F.col(c).isNull()) for c in df.columns])
    avg_egfr = (X.round_half_up(F.avg(spec.egfr), 1) if spec.egfr in df.columns
                else F.lit(None).cast("double"))
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_patients"),
        F.lit(len(df.columns) - 1).cast("bigint").alias("total_features"),
        F.count_if(y == 1).cast("bigint").alias("ckd_positive"),
        F.count_if(y == 0).cast("bigint").alias("ckd_negative"),
        X.round_half_up(F.avg((y == 1).cast("double")) * 100.0, 1).alias("ckd_percentage"),
        X.round_half_up(F.avg(spec.age), 1).alias("avg_age"),
        X.round_half_up(F.avg(spec.creatinine), 2).alias("avg_serum_creatinine"),
        avg_egfr.alias("avg_egfr"),
        X.round_half_up(F.avg(spec.hemoglobin), 1).alias("avg_hemoglobin"),
        null_total.cast("bigint").alias("null_count"))


# B5 / B15 -------------------------------------------------------------------
def value_counts(df: DataFrame, c: str, with_share: bool = False, decimals: int = 6) -> DataFrame:
    """Counts per non-NULL value (order: count desc, value)."""
    counts = (df.where(F.col(c).isNotNull()).groupBy(c)
              .agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    if with_share:
        # one value, read as a scalar: no window that would gather all values in one task
        total = counts.agg(F.sum("n").alias("total")).scalar()
        counts = counts.withColumn("share", X.round_half_up(X.safe_ratio("n", total), decimals))
    return counts


# B8 -------------------------------------------------------------------------
def filter_diagnosis(df: DataFrame, which: str = "all", spec: ColumnSpec = COHORT_SPEC) -> DataFrame:
    """'all', 'positive' (1) or 'negative' (0)."""
    if which == "all":
        return df
    return df.where(F.col(spec.target) == (1 if which == "positive" else 0))


# B9 -------------------------------------------------------------------------
def class_histogram(df: DataFrame, value_col: str, n_bins: int = 30,
                    spec: ColumnSpec = COHORT_SPEC, decimals: int = 6) -> DataFrame:
    """Equal-width histogram of one column split by class, zero-filled."""
    vals = df.select(F.col(value_col).cast("double").alias("x"), F.col(spec.target).alias("cls")) \
             .where(F.col("x").isNotNull())
    lo, hi = value_range(vals, "x")
    counts = (vals.select(X.hist_bin("x", lo, hi, n_bins).alias("bin"), "cls")
              .groupBy("bin", "cls").agg(F.count(F.lit(1)).alias("n")))
    spine = _with_classes(int_spine(df.sparkSession, n_bins, "bin"), counts)
    width = (hi - lo) / F.lit(float(n_bins))
    return (spine.join(counts, ["bin", "cls"], "left")
            .select("bin", F.col("cls").alias(spec.target),
                    X.round_half_up(lo + F.col("bin") * width, decimals).alias("bin_lo"),
                    X.round_half_up(lo + (F.col("bin") + 1) * width, decimals).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def _with_classes(spine: DataFrame, counts: DataFrame) -> DataFrame:
    """Spine x observed classes.  The class list is read from the already grouped
    counts (at most spine-size x classes rows) in one small job, not by a join."""
    classes = counts.agg(F.sort_array(F.collect_set("cls")).alias("c")).first()["c"] or []
    return spine.select("*", F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls"))


# B10 / B11 ------------------------------------------------------------------
def category_by_class(df: DataFrame, cols: list[str], spec: ColumnSpec = COHORT_SPEC) -> DataFrame:
    """``(column, value, class, n)`` for every listed column in one pass."""
    structs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
               for c in cols]
    return (df.select(F.col(spec.target), F.explode(F.array(*structs)).alias("kv"))
            .where(F.col("kv.value").isNotNull())
            .groupBy(F.col("kv.column").alias("column"), F.col("kv.value").alias("value"),
                     spec.target)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


# B12 ------------------------------------------------------------------------
def age_group_by_class(df: DataFrame, spec: ColumnSpec = COHORT_SPEC) -> DataFrame:
    """Age bins x observed classes, zero-filled; ages outside every bin dropped."""
    g = X.age_group(spec.age)
    counts = (df.select(g.alias("age_group"), F.col(spec.target).alias("cls"))
              .where(F.col("age_group").isNotNull())
              .groupBy("age_group", "cls").agg(F.count(F.lit(1)).alias("n")))
    bins = literal_spine(df.sparkSession, list(enumerate(fixed.AGE_LABELS, start=1)),
                         "age_ordinal INT, age_group STRING")
    return (_with_classes(bins, counts).join(counts, ["age_group", "cls"], "left")
            .select("age_ordinal", "age_group", F.col("cls").alias(spec.target),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


# B13 / B14 ------------------------------------------------------------------
def pair_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(i, j, n, a, b, aa, bb, ab)``: sums over the rows where both columns are present, for j <= i, in one scan.

    A batch of rows is a matrix with its mask of present values; a few matrix products add up all pairs at once, so
    each task hands on one row per pair, whatever its number of rows.  Values are taken from one row of the
    table onwards (``centre``), which keeps the sums of squares small; correlations do not depend on it.
    """
    import numpy as np
    import pyarrow as pa

    p = len(cols)
    narrow = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    first = narrow.head()
    centre = np.array([0.0 if first is None or x is None or not np.isfinite(x) else x for x in first or [0.0] * p])
    low = np.tril_indices(p)

    def run(batches):
        total = np.zeros((6, p, p))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            here = np.stack([np.asarray(c.is_valid()) for c in batch.columns], axis=1).astype(float)
            x = np.where(here > 0, x - centre, 0.0)
            total += np.stack([here.T @ here, x.T @ here, here.T @ x, (x * x).T @ here, here.T @ (x * x), x.T @ x])
        yield pa.RecordBatch.from_arrays(
            [pa.array(low[0], pa.int32()), pa.array(low[1], pa.int32()), pa.array(total[0][low].astype(np.int64)),
             *[pa.array(t[low]) for t in total[1:]]], names=["i", "j", "n", "a", "b", "aa", "bb", "ab"])

    parts = narrow.mapInArrow(run, "i int, j int, n long, a double, b double, aa double, bb double, ab double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])


def correlation_long(df: DataFrame, cols: list[str], decimals: int = 6,
                     lower_only: bool = False) -> DataFrame:
    """Pearson r for every pair, pairwise-complete rows, in one scan.

    A column that is constant over a pair's rows gives NULL.  Output ``(i, j, x, y, x_name, y_name, r)``;
    ``lower_only`` keeps i > j.
    """
    m = pair_moments(df, cols)

    def spread(s: str, ss: str):
        """Sum of squared deviations; what is left of rounding alone counts as none."""
        dev = F.col(ss) - F.col(s) * F.col(s) / F.col("n")
        return F.when(dev > 1e-13 * F.col(ss), dev).otherwise(0.0)

    some = m.where("n > 0").withColumn("sa", spread("a", "aa")).withColumn("sb", spread("b", "bb"))
    r = (F.when(F.col("i") == F.col("j"), F.when(F.col("sa") > 0, F.lit(1.0)))
         .otherwise(F.try_divide(F.col("ab") - F.col("a") * F.col("b") / F.col("n"), F.sqrt("sa") * F.sqrt("sb"))))
    every = literal_spine(df.sparkSession, [(i, j) for i in range(len(cols)) for j in range(i + 1)], "i INT, j INT")
    low = every.join(some.select("i", "j", r.alias("r")), ["i", "j"], "left")
    both = low if lower_only else low.unionByName(
        low.where(F.col("i") != F.col("j")).select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    if lower_only:
        both = both.where(F.col("i") > F.col("j"))
    names = F.array(*[F.lit(c) for c in cols])
    x = F.element_at(names, F.col("i") + 1)
    y = F.element_at(names, F.col("j") + 1)
    return both.select("i", "j", x.alias("x"), y.alias("y"), X.display_name_expr(x).alias("x_name"),
                       X.display_name_expr(y).alias("y_name"), X.round_half_up("r", decimals).alias("r"))


def correlation_wide(long: DataFrame, cols: list[str]) -> DataFrame:
    """Matrix form: one row per ``x``, one column per ``y``."""
    return long.groupBy("i", "x").pivot("y", cols).agg(F.first("r"))
