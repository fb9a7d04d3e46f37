"""Cleaning and feature engineering.

All per-row work is one projection.  Fitted statistics (median, mean, std)
come from one small aggregate job each, like any estimator's ``fit``, and are
applied as literals (or lazily as a scalar subquery), never by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..functions.spec import COHORT_SPEC, ColumnSpec
from .quantiles import medians_row


# ---------------------------------------------------------------------------
# F1 imputation
# ---------------------------------------------------------------------------
def fit_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Fit step of F1: exact medians, one small job, returned as fitted values."""
    row = medians_row(df, cols).first()
    return {c: (None if row is None else row[c]) for c in cols}


def fill_median(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None,
                medians: dict[str, float | None] | None = None) -> DataFrame:
    """Replace NULLs by the exact (interpolated) median of each column (F1).

    ``fit_on`` defaults to ``df`` itself (the original fits before the split).
    The medians are fitted once (like any estimator's ``fit``) and applied as
    literals, so later plans do not re-run the quantile jobs.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    if medians is None:
        medians = fit_medians(fit_on if fit_on is not None else df, cols)
    return df.select(*[
        F.coalesce(F.col(c), F.lit(medians[c]).cast(df.schema[c].dataType)).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def prepare_patients(df: DataFrame, spec: ColumnSpec = COHORT_SPEC) -> DataFrame:
    """Loader semantics: hemoglobin NULLs filled with the median."""
    return fill_median(df, [spec.hemoglobin])


# ---------------------------------------------------------------------------
# F2-F4 encodings and the unmapped-value audit
# ---------------------------------------------------------------------------
def _encoders(df: DataFrame, spec: ColumnSpec) -> dict[str, dict[str, int]]:
    enc = {c: fixed.YES_NO_MAP for c in spec.yes_no if c in df.columns}
    if spec.gender in df.columns:
        enc[spec.gender] = fixed.GENDER_MAP
    if spec.living_area in df.columns:
        enc[spec.living_area] = fixed.LIVING_AREA_MAP
    return enc


def encode_features(df: DataFrame, spec: ColumnSpec = COHORT_SPEC) -> DataFrame:
    """Yes/No, Male/Female, Urban/Rural -> 1/0; anything else -> 0."""
    enc = _encoders(df, spec)
    return df.select(*[X.encode_map(c, enc[c]).alias(c) if c in enc else F.col(c)
                       for c in df.columns])


def unmapped_audit(df: DataFrame, spec: ColumnSpec = COHORT_SPEC) -> DataFrame:
    """Rows per encoded column whose value is not in the mapping."""
    enc = _encoders(df, spec)
    wide = df.agg(*[F.count_if(X.is_unmapped(c, m)).alias(c) for c, m in enc.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_unmapped"))
                      for c in enc])
    return wide.select(F.inline(pairs)).select(
        "column", F.col("n_unmapped").cast("bigint").alias("n_unmapped"))


# ---------------------------------------------------------------------------
# F5 feature selection
# ---------------------------------------------------------------------------
def feature_columns(df: DataFrame, spec: ColumnSpec = COHORT_SPEC) -> list[str]:
    return spec.feature_columns(df.columns)


def select_features(df: DataFrame, spec: ColumnSpec = COHORT_SPEC,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """id, features in table order, target (plus ``keep`` columns)."""
    feats = feature_columns(df, spec)
    return df.select(spec.id, *feats, *[k for k in keep if k in df.columns], spec.target)


# ---------------------------------------------------------------------------
# F9 / F10 standard scaling
# ---------------------------------------------------------------------------
def fit_scaler(train: DataFrame, cols: list[str]) -> DataFrame:
    """One-row table of population mean and std per column.

    Population std as in the original's scaler; a constant column gets scale 1.
    """
    aggs = []
    for c in cols:
        std = F.stddev_pop(F.col(c).cast("double"))
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
                 F.when(std == 0, F.lit(1.0)).otherwise(std).alias(f"{c}__scale")]
    return train.agg(*aggs)


def scaler_long(stats: DataFrame, cols: list[str]) -> DataFrame:
    """The scaler row as ``(column, mean, scale)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"),
                               F.col(f"{c}__scale").alias("scale")) for c in cols])
    return stats.select(F.inline(pairs))


def collect_stats(stats: DataFrame) -> dict[str, float]:
    """Fitted one-row statistics as a dict (the model of a fit step)."""
    return stats.first().asDict()


def apply_scaler(df: DataFrame, stats: DataFrame | dict, cols: list[str]) -> DataFrame:
    """(x - mean) / scale.

    ``stats`` is the fitted dict (applied as literals) or the one-row stats
    DataFrame (applied lazily as a scalar subquery).
    """
    if isinstance(stats, dict):
        mean = {c: F.lit(stats[f"{c}__mean"]) for c in cols}
        scale = {c: F.lit(stats[f"{c}__scale"]) for c in cols}
    else:
        s = stats.select(F.struct(*stats.columns).alias("s")).scalar()
        mean = {c: s.getField(f"{c}__mean") for c in cols}
        scale = {c: s.getField(f"{c}__scale") for c in cols}
    return df.select(*[
        ((F.col(c).cast("double") - mean[c]) / scale[c]).alias(c) if c in cols else F.col(c)
        for c in df.columns])
