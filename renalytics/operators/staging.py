"""Kidney staging operators (eGFR, stage, distribution, histogram).

All operators are narrow projections or a two-level aggregate: partial counts
per task, a tiny final merge, then a join with a fixed spine (6 stages or
``n_bins`` bins) so that empty groups appear with count 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import exprs as X
from ..functions import fixed
from ..functions.spec import COHORT_SPEC, ColumnSpec
from .spine import value_range, int_spine, literal_spine


def with_egfr(df: DataFrame, spec: ColumnSpec = COHORT_SPEC, female_factor: float = 1.0,
              out: str = "egfr_estimated") -> DataFrame:
    """Add the equation eGFR computed from creatinine, age and sex."""
    numeric = isinstance(df.schema[spec.gender].dataType, NumericType)
    female = X.is_female(spec.gender, numeric=numeric)
    return df.withColumn(out, X.egfr_ckd_epi(spec.creatinine, spec.age, female, female_factor))


def stage_table(df: DataFrame, spec: ColumnSpec = COHORT_SPEC, fill_missing: bool = False,
                strict: bool = False, female_factor: float = 1.0) -> DataFrame:
    """Staging table (S4): ``patient_id, egfr, ckd_stage, stage_description``.

    Uses the stored eGFR when the column exists (it is not exactly the equation
    value), otherwise the equation.  ``fill_missing`` fills only missing stored
    values from the equation; by default a missing eGFR stays missing and lands
    in the last stage, as in the original (``strict`` gives NULL instead).
    """
    if spec.egfr in df.columns:
        egfr = F.col(spec.egfr)
        if fill_missing:
            numeric = isinstance(df.schema[spec.gender].dataType, NumericType)
            egfr = F.coalesce(egfr, X.egfr_ckd_epi(spec.creatinine, spec.age,
                                                    X.is_female(spec.gender, numeric), female_factor))
    else:
        numeric = isinstance(df.schema[spec.gender].dataType, NumericType)
        egfr = X.egfr_ckd_epi(spec.creatinine, spec.age, X.is_female(spec.gender, numeric),
                              female_factor)
    staged = df.select(F.col(spec.id), X.nan_to_null(egfr).alias("egfr"))
    stage = X.egfr_stage("egfr", strict=strict)
    return staged.select(spec.id, "egfr", stage.alias("ckd_stage"),
                         X.stage_description(stage).alias("stage_description"))


def stage_distribution(staged: DataFrame, stage_col: str = "ckd_stage") -> DataFrame:
    """Patients per stage in fixed order, zero-filled."""
    counts = staged.groupBy(F.col(stage_col).alias("ckd_stage")).agg(
        F.count(F.lit(1)).alias("n_patients"))
    spine = literal_spine(staged.sparkSession,
                          [(i + 1, s[0]) for i, s in enumerate(fixed.STAGES)],
                          "stage_ordinal INT, ckd_stage STRING")
    total = F.sum("n_patients").over(_all())
    return (spine.join(F.broadcast(counts), "ckd_stage", "left")
            .select("stage_ordinal", "ckd_stage",
                    F.coalesce("n_patients", F.lit(0)).cast("bigint").alias("n_patients"),
                    X.stage_colour("ckd_stage").alias("colour"))
            .withColumn("share", X.round_half_up(X.safe_ratio("n_patients", total), 6)))


def _all():
    from pyspark.sql import Window
    return Window.partitionBy()


def egfr_histogram(staged: DataFrame, n_bins: int = 30, value_col: str = "egfr") -> DataFrame:
    """eGFR histogram with ``n_bins`` equal bins and stage boundaries per bin.

    Two passes over the column: the fitted min/max (one small job) and a
    partial-aggregated bin count joined to a bin spine.
    """
    vals = staged.select(F.col(value_col).alias("x")).where(F.col("x").isNotNull())
    lo, hi = value_range(vals, "x")
    binned = vals.select(X.hist_bin("x", lo, hi, n_bins).alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_patients"))
    spine = int_spine(staged.sparkSession, n_bins, "bin")
    width = (hi - lo) / F.lit(float(n_bins))
    lo_edge = lo + F.col("bin") * width
    hi_edge = lo + (F.col("bin") + 1) * width
    labels = [F.when((F.lit(v) >= lo_edge) & (F.lit(v) < hi_edge), F.lit(name))
              for v, name in fixed.STAGE_BOUNDARIES]
    return (spine.join(F.broadcast(counts), "bin", "left")
            .select("bin",
                    X.round_half_up(lo_edge, 6).alias("bin_lo"),
                    X.round_half_up(hi_edge, 6).alias("bin_hi"),
                    F.coalesce("n_patients", F.lit(0)).cast("bigint").alias("n_patients"),
                    F.concat_ws(";", *labels).alias("boundaries")))
