"""Attribution plans (X3-X9) for the fixture logistic model (exact linear attribution)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import display_name
from ..operators import attribution as AT
from .base import rhu, with_ctes
from .fixture_models import BASELINE_SQL, LINEAR_CTES, LINEAR_WEIGHTS, scaled_split
from .registry import register

_DISPLAY = ("CASE feature " + " ".join(f"WHEN '{c}' THEN '{display_name(c)}'" for c in LINEAR_WEIGHTS)
            + " END")


def linear_rows(spark, sf_dir):
    """``(patient_id, cells)`` of the validation patients, and the baseline."""
    from .base import cached_fit
    sc = scaled_split(spark, sf_dir)
    val = sc.where(F.col("split") == "validation")
    means = cached_fit(spark, sf_dir, "background_means", lambda: AT.background_means(
        sc.where(F.col("split") == "train"), list(LINEAR_WEIGHTS)))
    return AT.linear_cells(val, LINEAR_WEIGHTS, means=means)


def linear_attr(spark, sf_dir):
    rows, baseline = linear_rows(spark, sf_dir)
    return rows.select("patient_id", F.inline("cells")), baseline


@register("x3_linear_attribution", with_ctes(
    f"SELECT patient_id, feature, feature_ordinal, {rhu('feature_value', 6)} AS feature_value, "
    f"{rhu('shap_value', 6)} AS shap_value FROM attr", "enc_split", extra=LINEAR_CTES))
def x3_linear_attribution(spark, sf_dir):
    from ..functions import exprs as X
    long, _ = linear_attr(spark, sf_dir)
    return long.select("patient_id", "feature", "feature_ordinal",
                       X.round_half_up("feature_value", 6).alias("feature_value"),
                       X.round_half_up("shap_value", 6).alias("shap_value"))


def _top_sql(n: int) -> str:
    return f"""
, t AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY abs(shap_value) DESC, feature_ordinal ASC) AS rank
        FROM attr)
SELECT patient_id, rank, feature, {rhu('shap_value', 4)} AS shap_value,
       CASE WHEN shap_value > 0 THEN 'increases' ELSE 'decreases' END AS direction,
       printf('%s %s CKD risk (SHAP = %+.4f)', feature, CASE WHEN shap_value > 0 THEN 'increases' ELSE 'decreases' END,
              {rhu('shap_value', 4)}) AS description
FROM t WHERE rank <= {n}
"""


@register("x4_top_factors", with_ctes(_top_sql(3), "enc_split", extra=LINEAR_CTES))
def x4_top_factors(spark, sf_dir):
    return AT.top_factors(linear_rows(spark, sf_dir)[0], 3)


@register("x4_top_factors_all", with_ctes(_top_sql(10), "enc_split", extra=LINEAR_CTES))
def x4_top_factors_all(spark, sf_dir):
    """Up to ten factors, as the patient page lists them."""
    return AT.top_factors(linear_rows(spark, sf_dir)[0], 10)


@register("x5_global_importance", with_ctes(
    f"SELECT feature, {_DISPLAY} AS display_name, {rhu('m', 6)} AS mean_abs_shap, "
    "row_number() OVER (ORDER BY m DESC, feature_ordinal ASC) AS importance_rank "
    "FROM (SELECT feature, feature_ordinal, avg(abs(shap_value)) AS m FROM attr GROUP BY 1, 2) g",
    "enc_split", extra=LINEAR_CTES))
def x5_global_importance(spark, sf_dir):
    long, _ = linear_attr(spark, sf_dir)
    return AT.global_importance(long)


_X6 = f"""
, t AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY abs(shap_value) DESC, feature_ordinal ASC) AS rank
        FROM attr)
SELECT patient_id,
  coalesce(string_agg(CASE WHEN shap_value > 0 THEN {_DISPLAY} END, ', ' ORDER BY rank), '') AS increasing,
  coalesce(string_agg(CASE WHEN shap_value < 0 THEN {_DISPLAY} END, ', ' ORDER BY rank), '') AS decreasing
FROM t WHERE rank <= 5 GROUP BY patient_id
"""


@register("x6_factor_lists", with_ctes(_X6, "enc_split", extra=LINEAR_CTES))
def x6_factor_lists(spark, sf_dir):
    return AT.factor_lists(linear_rows(spark, sf_dir)[0], 5)


_X7 = f"""
, mm AS (SELECT feature, min(feature_value) AS lo, max(feature_value) AS hi FROM attr GROUP BY feature)
SELECT a.patient_id, a.feature, {rhu('a.feature_value', 6)} AS feature_value,
  {rhu('CASE WHEN mm.hi > mm.lo THEN (a.feature_value - mm.lo) / (mm.hi - mm.lo) ELSE 0.5e0 END', 6)} AS normalised_value,
  {rhu('a.shap_value', 6)} AS shap_value
FROM attr a JOIN mm ON a.feature = mm.feature
"""


@register("x7_beeswarm", with_ctes(_X7, "enc_split", extra=LINEAR_CTES))
def x7_beeswarm(spark, sf_dir):
    long, _ = linear_attr(spark, sf_dir)
    return AT.beeswarm(long)


_X8 = f"""
, w AS (SELECT patient_id, feature, shap_value,
    row_number() OVER (PARTITION BY patient_id ORDER BY abs(shap_value), feature_ordinal) AS step,
    ({BASELINE_SQL}) + sum(shap_value) OVER (PARTITION BY patient_id ORDER BY abs(shap_value), feature_ordinal
                                   ROWS UNBOUNDED PRECEDING) AS "end"
  FROM attr CROSS JOIN bg)
SELECT patient_id, step, feature, {rhu('shap_value', 6)} AS shap_value, {rhu('"end" - shap_value', 6)} AS start,
       {rhu('"end"', 6)} AS "end" FROM w
"""


@register("x8_waterfall", with_ctes(_X8, "enc_split", extra=LINEAR_CTES))
def x8_waterfall(spark, sf_dir):
    return AT.waterfall(*linear_rows(spark, sf_dir))


_X9 = f"""
SELECT patient_id,
  {rhu('sum(CASE WHEN shap_value > 0 THEN shap_value ELSE 0e0 END)', 6)} AS positive_total,
  {rhu('sum(CASE WHEN shap_value < 0 THEN shap_value ELSE 0e0 END)', 6)} AS negative_total,
  {rhu(f'({BASELINE_SQL}) + sum(shap_value)', 6)} AS output
FROM attr CROSS JOIN bg GROUP BY patient_id, {', '.join('bg.' + c for c in LINEAR_WEIGHTS)}
"""


@register("x9_force_totals", with_ctes(_X9, "enc_split", extra=LINEAR_CTES))
def x9_force_totals(spark, sf_dir):
    return AT.force_totals(*linear_rows(spark, sf_dir))
