"""Encoding, feature selection and scaling plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.spec import COHORT_SPEC
from ..operators import features as FE
from ..operators import observed as OB
from ..session import shared_path
from .base import FEATURES, encoded_split, patients, rhu, with_ctes
from .registry import register

_ENC_COLS = ("patient_id, age, gender, diabetes, hypertension, foamy_urine, extra_salt, "
             "living_area, serum_creatinine, hemoglobin, egfr, probability, ckd_diagnosis")


@register("f2_f4_encode_features", with_ctes(f"SELECT {_ENC_COLS} FROM encoded", "encoded"))
def f2_f4_encode_features(spark, sf_dir):
    return FE.encode_features(patients(spark, sf_dir), COHORT_SPEC)


_AUDIT = {"diabetes": ("Yes", "No"), "hypertension": ("Yes", "No"), "foamy_urine": ("Yes", "No"),
          "extra_salt": ("Yes", "No"), "gender": ("Male", "Female"), "living_area": ("Urban", "Rural")}
_F4B = " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ('{a}', '{b}')) AS BIGINT) "
    f"AS n_unmapped FROM patients" for c, (a, b) in _AUDIT.items())


@register("f4b_unmapped_audit", with_ctes(_F4B, "patients"))
def f4b_unmapped_audit(spark, sf_dir):
    return FE.unmapped_audit(patients(spark, sf_dir), COHORT_SPEC)


@register("f4b_unmapped_audit_on_write", with_ctes(_F4B, "patients"))
def f4b_unmapped_audit_on_write(spark, sf_dir):
    """The same counts, observed while the table is written."""
    raw = patients(spark, sf_dir)
    audit = OB.unmapped_counts(raw, COHORT_SPEC)
    seen = OB.write_counted(raw, shared_path(spark, "patients"), audit)
    return spark.createDataFrame([(c, seen[c]) for c in audit], "column string, n_unmapped long")


@register("f5_select_features", with_ctes(
    f"SELECT patient_id, {', '.join(FEATURES)}, ckd_diagnosis FROM encoded", "encoded"))
def f5_select_features(spark, sf_dir):
    return FE.select_features(FE.encode_features(patients(spark, sf_dir)), COHORT_SPEC)


_NUM = ["age", "hemoglobin"]
_F9 = " UNION ALL ".join(
    f"SELECT '{c}' AS column, {rhu(f'avg(CAST({c} AS DOUBLE))', 6)} AS mean, "
    f"{rhu(f'CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1e0 ELSE stddev_pop(CAST({c} AS DOUBLE)) END', 6)} AS scale "
    f"FROM enc_split WHERE split = 'train'" for c in _NUM)


@register("f9_fit_scaler", with_ctes(_F9, "enc_split"))
def f9_fit_scaler(spark, sf_dir):
    train = encoded_split(spark, sf_dir).where(F.col("split") == "train")
    stats = FE.scaler_long(FE.fit_scaler(train, _NUM), _NUM)
    return stats.select("column", X.round_half_up("mean", 6).alias("mean"),
                        X.round_half_up("scale", 6).alias("scale"))


_F10_STATS = ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS {c}_m, CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1e0 "
    f"ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS {c}_s" for c in _NUM)
_F10 = (f", st AS (SELECT {_F10_STATS} FROM enc_split WHERE split = 'train')\n"
        "SELECT e.patient_id, e.split, " + ", ".join(
            rhu(f"(CAST(e.{c} AS DOUBLE) - st.{c}_m) / st.{c}_s", 6) + f" AS {c}" if c in _NUM
            else f"e.{c}" for c in FEATURES) + ", e.ckd_diagnosis FROM enc_split e CROSS JOIN st")


@register("f10_apply_scaler", with_ctes(_F10, "enc_split"))
def f10_apply_scaler(spark, sf_dir):
    es = encoded_split(spark, sf_dir)
    stats = FE.collect_stats(FE.fit_scaler(es.where(F.col("split") == "train"), _NUM))
    scaled = FE.apply_scaler(es, stats, _NUM)
    return scaled.select("patient_id", "split",
                         *[X.round_half_up(c, 6).alias(c) if c in _NUM else F.col(c) for c in FEATURES],
                         "ckd_diagnosis")
