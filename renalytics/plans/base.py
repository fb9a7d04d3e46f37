"""Shared inputs of the registered plans and the SQL-oracle building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed
from ..operators import features as FE
from ..sources.cohort import COHORT_SQL, cohort
from ..sources.io import clean_patients
from ..sources.tables import tables_version


def patients_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned cohort before imputation (A1-A4)."""
    return clean_patients(cohort(spark, sf_dir))


_FITS: dict = {}


def forget_fits() -> None:
    """Drop every cached fit (the bench times each plan with its own fits)."""
    _FITS.clear()


def cached_fit(spark: SparkSession, sf_dir: str, name: str, fit):
    """Fitted statistics are computed once per Spark application and version of the tables."""
    key = (spark.sparkContext.applicationId, tables_version(spark, sf_dir), name)
    if key not in _FITS:
        _FITS[key] = fit()
    return _FITS[key]


def hemoglobin_median(spark: SparkSession, sf_dir: str) -> dict:
    return cached_fit(spark, sf_dir, "hemoglobin_median",
                      lambda: FE.fit_medians(patients_raw(spark, sf_dir), ["hemoglobin"]))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned cohort with hemoglobin imputed by its median (loader semantics)."""
    return FE.fill_median(patients_raw(spark, sf_dir), ["hemoglobin"],
                          medians=hemoglobin_median(spark, sf_dir))


def split_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with their stratified ``split`` label."""
    from ..operators.split import stratified_split
    return stratified_split(patients(spark, sf_dir))


def encoded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded patients with ``split`` (the modelling table)."""
    return FE.encode_features(split_patients(spark, sf_dir))


# ---------------------------------------------------------------------------
# SQL twins (DuckDB and Spark SQL), written independently of the DataFrame code
# ---------------------------------------------------------------------------
def rhu(expr: str, d: int) -> str:
    """Half-away-from-zero rounding, same formula as ``exprs.round_half_up``."""
    s = f"{float(10 ** d)!r}"
    r = f"(sign({expr}) * floor(abs({expr}) * {s} + 0.5) / {s})"
    big = f"{2.0 ** 53 / 10 ** d!r}"
    return f"(CASE WHEN abs({expr}) >= {big} THEN CAST({expr} AS DOUBLE) WHEN {r} = 0 THEN 0e0 ELSE {r} END)"


STAGE_CASE = ("CASE " + " ".join(
    f"WHEN egfr >= {lo!r} THEN '{st}'" for st, lo, _d, _c in fixed.STAGES[:-1])
    + f" ELSE '{fixed.STAGES[-1][0]}' END")

STAGE_DESC_CASE = ("CASE ckd_stage " + " ".join(
    f"WHEN '{st}' THEN '{d}'" for st, _lo, d, _c in fixed.STAGES)
    + f" ELSE '{fixed.UNKNOWN_STAGE_DESCRIPTION}' END")

PATIENTS_SQL = """
SELECT patient_id, age, gender, diabetes, hypertension, foamy_urine, extra_salt, living_area,
       serum_creatinine, coalesce(hemoglobin, (SELECT median(hemoglobin) FROM cohort)) AS hemoglobin,
       egfr, probability, ckd_diagnosis
FROM cohort
"""

STAGING_SQL = f"""
SELECT patient_id, egfr, ckd_stage, {STAGE_DESC_CASE} AS stage_description
FROM (SELECT patient_id, egfr, {STAGE_CASE} AS ckd_stage FROM patients) s
"""

ENCODED_SQL = """
SELECT patient_id, age,
  CASE WHEN gender = 'Male' THEN 1 WHEN gender = 'Female' THEN 0 ELSE 0 END AS gender,
  CASE WHEN diabetes = 'Yes' THEN 1 WHEN diabetes = 'No' THEN 0 ELSE 0 END AS diabetes,
  CASE WHEN hypertension = 'Yes' THEN 1 WHEN hypertension = 'No' THEN 0 ELSE 0 END AS hypertension,
  CASE WHEN foamy_urine = 'Yes' THEN 1 WHEN foamy_urine = 'No' THEN 0 ELSE 0 END AS foamy_urine,
  CASE WHEN extra_salt = 'Yes' THEN 1 WHEN extra_salt = 'No' THEN 0 ELSE 0 END AS extra_salt,
  CASE WHEN living_area = 'Urban' THEN 1 WHEN living_area = 'Rural' THEN 0 ELSE 0 END AS living_area,
  serum_creatinine, hemoglobin, egfr, probability, ckd_diagnosis
FROM patients
"""

SPLIT_SQL = """
SELECT * EXCLUDE (h, rk, n, nt), CASE WHEN rk < nt THEN 'test'
       WHEN rk < nt + floor((n - nt) * 0.2222e0 + 0.5e0) THEN 'validation' ELSE 'train' END AS split
FROM (
  SELECT *, floor(n * 0.1e0 + 0.5e0) AS nt FROM (
    SELECT *, row_number() OVER (PARTITION BY ckd_diagnosis ORDER BY h, patient_id) - 1 AS rk,
           count(*) OVER (PARTITION BY ckd_diagnosis) AS n
    FROM (SELECT *, ('0x' || substr(md5('42|' || CAST(patient_id AS VARCHAR)), 1, 15))::BIGINT AS h
          FROM patients) a) b) c
"""

ENC_SPLIT_SQL = """
SELECT e.*, s.split FROM encoded e JOIN split s ON e.patient_id = s.patient_id
"""

FEATURES = ["age", "gender", "diabetes", "hypertension", "foamy_urine", "extra_salt",
            "living_area", "hemoglobin"]

BASE_CTES = {
    "cohort": COHORT_SQL,
    "patients": PATIENTS_SQL,
    "staging": STAGING_SQL,
    "encoded": ENCODED_SQL,
    "split": SPLIT_SQL,
    "enc_split": ENC_SPLIT_SQL,
}
BASE_ORDER = ["cohort", "patients", "staging", "encoded", "split", "enc_split"]
DEPENDS = {"patients": ["cohort"], "staging": ["patients"], "encoded": ["patients"],
           "split": ["patients"], "enc_split": ["encoded", "split"]}


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named CTEs (cohort first, in dependency order)."""
    ctes = dict(BASE_CTES)
    ctes.update(extra or {})
    order = BASE_ORDER + [n for n in (extra or {})]
    wanted: set[str] = set()
    stack = list(names) + list(extra or {}) + ["cohort"]
    while stack:
        n = stack.pop()
        if n not in wanted:
            wanted.add(n)
            stack.extend(DEPENDS.get(n, []))
    parts = [f"{n} AS ({ctes[n]})" for n in order if n in wanted]
    return "WITH " + ",\n".join(parts) + "\n" + body
