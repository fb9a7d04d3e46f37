"""Risk plans (K1-K7, R6) and linear scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..operators import attribution as AT
from ..operators import risk as RK
from .base import rhu, split_patients, with_ctes
from .fixture_models import LINEAR_CTES, LINEAR_INTERCEPT, LINEAR_WEIGHTS, scaled_split
from .registry import register

_BAND_R = ("CASE WHEN probability > -0.01e0 AND probability <= 0.3e0 THEN 'Low' "
           "WHEN probability > 0.3e0 AND probability <= 0.7e0 THEN 'Medium' "
           "WHEN probability > 0.7e0 AND probability <= 1.01e0 THEN 'High' END")
_BAND_L = ("CASE WHEN probability IS NULL THEN NULL WHEN probability < 0.3e0 THEN 'Low' "
           "WHEN probability < 0.7e0 THEN 'Medium' ELSE 'High' END")
_BAND_ORD = " UNION ALL ".join(f"SELECT {i} AS band_ordinal, '{b}' AS risk_category, '{fixed.BAND_COLOURS[b]}' AS colour"
                               for i, b in enumerate(fixed.BAND_ORDER, start=1))
_COLOUR = ("CASE risk_category " + " ".join(f"WHEN '{b}' THEN '{c}'" for b, c in fixed.BAND_COLOURS.items())
           + f" ELSE '{fixed.DEFAULT_COLOUR}' END")

_RISK = {"risk": f"""
SELECT patient_id, {rhu('probability', 4)} AS ckd_probability, {_BAND_R} AS risk_category,
       CAST(ckd_diagnosis AS INTEGER) AS actual_label
FROM split WHERE split = 'validation'
"""}


def _validation(spark, sf_dir):
    return (split_patients(spark, sf_dir).where(F.col("split") == "validation")
            .select("patient_id", "probability", F.col("ckd_diagnosis").alias("label")))


def _risk(spark, sf_dir):
    return RK.risk_table(_validation(spark, sf_dir))


@register("k1_k3_risk_table", with_ctes("SELECT * FROM risk", "split", extra=_RISK))
def k1_k3_risk_table(spark, sf_dir):
    return _risk(spark, sf_dir)


@register("k2_left_closed_bands", with_ctes(
    f"SELECT patient_id, probability, {_BAND_L} AS risk_category FROM patients", "patients"))
def k2_left_closed_bands(spark, sf_dir):
    from .base import patients
    p = patients(spark, sf_dir)
    return p.select("patient_id", "probability", X.risk_band("probability", "left").alias("risk_category"))


@register("k4_band_distribution", with_ctes(
    f", c AS (SELECT risk_category, count(*) AS n FROM risk WHERE risk_category IS NOT NULL GROUP BY 1)\n"
    f"SELECT s.band_ordinal, s.risk_category, CAST(coalesce(c.n, 0) AS BIGINT) AS n, s.colour, "
    f"{rhu('coalesce(CAST(coalesce(c.n, 0) AS DOUBLE) / CAST(NULLIF(sum(coalesce(c.n, 0)) OVER (), 0) AS DOUBLE), 0e0)', 6)} AS share "
    f"FROM ({_BAND_ORD}) s LEFT JOIN c ON s.risk_category = c.risk_category", "split", extra=_RISK))
def k4_band_distribution(spark, sf_dir):
    return RK.band_distribution(_risk(spark, sf_dir))


_K5 = f"""
, r AS (SELECT min(ckd_probability) AS lo, max(ckd_probability) AS hi FROM risk)
, c AS (SELECT CASE WHEN r.hi = r.lo THEN 0 ELSE CAST(least(floor((ckd_probability - r.lo) / ((r.hi - r.lo) / 20e0)), 19) AS INTEGER) END AS bin,
               count(*) AS n FROM risk, r GROUP BY 1)
SELECT CAST(b.range AS INTEGER) AS bin, {rhu('r.lo + b.range * (r.hi - r.lo) / 20e0', 6)} AS bin_lo,
       {rhu('r.lo + (b.range + 1) * (r.hi - r.lo) / 20e0', 6)} AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       concat_ws(';', CASE WHEN 0.3e0 >= r.lo + b.range * (r.hi - r.lo) / 20e0 AND 0.3e0 < r.lo + (b.range + 1) * (r.hi - r.lo) / 20e0 THEN 'Low/Medium' END,
                      CASE WHEN 0.7e0 >= r.lo + b.range * (r.hi - r.lo) / 20e0 AND 0.7e0 < r.lo + (b.range + 1) * (r.hi - r.lo) / 20e0 THEN 'Medium/High' END) AS boundaries
FROM range(20) b CROSS JOIN r LEFT JOIN c ON b.range = c.bin
"""


@register("k5_probability_histogram", with_ctes(_K5, "split", extra=_RISK))
def k5_probability_histogram(spark, sf_dir):
    return RK.probability_histogram(_risk(spark, sf_dir), 20)


_K5_25 = _K5.replace("20e0", "25e0").replace(", 19)", ", 24)").replace("range(20)", "range(25)")


@register("k5_probability_histogram_25", with_ctes(_K5_25, "split", extra=_RISK))
def k5_probability_histogram_25(spark, sf_dir):
    return RK.probability_histogram(_risk(spark, sf_dir), 25)


@register("k6_band_colours", with_ctes(f"SELECT *, {_COLOUR} AS colour FROM risk", "split", extra=_RISK))
def k6_band_colours(spark, sf_dir):
    return RK.with_colours(_risk(spark, sf_dir))


@register("k7_band_by_label", with_ctes(
    ", c AS (SELECT risk_category, count(*) FILTER (WHERE actual_label = 0) AS l0, "
    "count(*) FILTER (WHERE actual_label = 1) AS l1 FROM risk WHERE risk_category IS NOT NULL GROUP BY 1)\n"
    f"SELECT s.band_ordinal, s.risk_category, CAST(coalesce(c.l0, 0) AS BIGINT) AS label_0, "
    f"CAST(coalesce(c.l1, 0) AS BIGINT) AS label_1 FROM ({_BAND_ORD}) s LEFT JOIN c ON s.risk_category = c.risk_category",
    "split", extra=_RISK))
def k7_band_by_label(spark, sf_dir):
    return RK.band_by_label(_risk(spark, sf_dir))


_ZONE = ("CASE WHEN p >= 0e0 AND p < 30e0 THEN '0-30' WHEN p >= 30e0 AND p < 70e0 THEN '30-70' "
         "WHEN p >= 70e0 AND p <= 100e0 THEN '70-100' END")
_ZONE_C = (f"CASE WHEN p >= 0e0 AND p < 30e0 THEN '{fixed.GAUGE_ZONES[0][2]}' "
           f"WHEN p >= 30e0 AND p < 70e0 THEN '{fixed.GAUGE_ZONES[1][2]}' "
           f"WHEN p >= 70e0 AND p <= 100e0 THEN '{fixed.GAUGE_ZONES[2][2]}' END")


@register("r6_gauge", with_ctes(
    f"SELECT patient_id, {rhu('p', 2)} AS gauge_value, {_ZONE} AS gauge_zone, {_ZONE_C} AS zone_colour, "
    f"risk_category, {_COLOUR} AS bar_colour FROM (SELECT patient_id, probability * 100e0 AS p, "
    f"{_BAND_L} AS risk_category FROM split WHERE split = 'validation') t", "split"))
def r6_gauge(spark, sf_dir):
    return RK.gauge(_validation(spark, sf_dir))


@register("m10_linear_scoring", with_ctes(
    f"SELECT patient_id, split, {rhu('margin', 6)} AS margin, {rhu('probability', 6)} AS probability FROM lin",
    "enc_split", extra=LINEAR_CTES))
def m10_linear_scoring(spark, sf_dir):
    lin = AT.linear_scores(scaled_split(spark, sf_dir), LINEAR_WEIGHTS, LINEAR_INTERCEPT,
                           keep=["patient_id", "split"])
    return lin.select("patient_id", "split", X.round_half_up("margin", 6).alias("margin"),
                      X.round_half_up("probability", 6).alias("probability"))
