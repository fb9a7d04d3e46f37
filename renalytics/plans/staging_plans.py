"""Staging plans (S1-S6) and the loader plan (A1-A4)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed
from ..operators import staging as ST
from ..session import shared_path
from ..sources import io as IO
from ..sources.cohort import cohort
from .base import patients, patients_raw, rhu, with_ctes
from .registry import register

_COLS = ("patient_id, age, gender, diabetes, hypertension, foamy_urine, extra_salt, "
         "living_area, serum_creatinine, hemoglobin, egfr, probability, ckd_diagnosis")


@register("a1_load_patients", with_ctes(f"SELECT {_COLS} FROM cohort"))
def a1_load_patients(spark, sf_dir):
    return patients_raw(spark, sf_dir)


def _survey_file(spark, sf_dir, bad=None):
    """The cohort as a survey export: padded upper-case column names, a column of the drop list, text lines (CSV)."""
    raw = cohort(spark, sf_dir)
    cells = [F.when(F.col("patient_id") % bad == 0, F.lit("n/a")).otherwise(F.col(c).cast("string")) if bad and c == "age"
             else F.col(c).cast("string") for c in raw.columns]
    export = raw.select(*[x.alias(f" {c.upper()} ") for x, c in zip(cells, raw.columns, strict=True)], F.lit("2024").alias(" Timestamp"))
    path = shared_path(spark, "survey")
    export.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    schema = StructType([StructField(f" {f.name.upper()} ", f.dataType) for f in raw.schema.fields]
                        + [StructField(" Timestamp", StringType())])
    return path, schema


@register("a1_a4_load_survey_csv", with_ctes(f"SELECT {_COLS} FROM cohort"))
def a1_a4_load_survey_csv(spark, sf_dir):
    """Names are normalised, the listed column goes, the target is there (A2-A4)."""
    path, schema = _survey_file(spark, sf_dir)
    return IO.load_patients(spark, path, "csv", schema)


@register("a1_a4_load_survey_parquet", with_ctes(f"SELECT {_COLS} FROM cohort"))
def a1_a4_load_survey_parquet(spark, sf_dir):
    raw = cohort(spark, sf_dir)
    path = shared_path(spark, "survey")
    raw.select(*[F.col(c).alias(f" {c.upper()} ") for c in raw.columns], F.lit("2024").alias(" Timestamp")).write.parquet(path)
    return IO.load_patients(spark, path)


@register("a1_bad_records", with_ctes(
    "SELECT patient_id, patient_id % 97 <> 0 AS accepted, (SELECT count(*) FROM cohort WHERE patient_id % 97 = 0) AS n_rejected FROM cohort"))
def a1_bad_records(spark, sf_dir):
    """Lines whose age is no number are set aside and counted; all others load."""
    path, schema = _survey_file(spark, sf_dir, bad=97)
    loaded, rejects, files = IO.load_tolerant(spark, path, "csv", schema)
    rejected = rejects.select(F.split("line", ",")[0].cast("long").alias("patient_id"), F.lit(False).alias("accepted"))
    both = loaded.select("patient_id", F.lit(True).alias("accepted")).unionByName(rejected)
    total = files.agg(F.sum("n_rejected").alias("n_rejected"))  # one row
    return both.join(F.broadcast(total), F.lit(True))


@register("f1_median_fill", with_ctes(f"SELECT {_COLS} FROM patients", "patients"))
def f1_median_fill(spark, sf_dir):
    return patients(spark, sf_dir)


_EGFR_SQL = f"""
SELECT patient_id, CASE WHEN serum_creatinine > 0 THEN {rhu(
    "142e0 * power(serum_creatinine / (CASE WHEN gender = 'Female' THEN 0.7e0 ELSE 0.9e0 END), "
    "CASE WHEN serum_creatinine <= (CASE WHEN gender = 'Female' THEN 0.7e0 ELSE 0.9e0 END) "
    "THEN (CASE WHEN gender = 'Female' THEN -0.241e0 ELSE -0.302e0 END) ELSE -1.2e0 END) "
    "* power(0.9938e0, CAST(age AS DOUBLE))", 2)} END AS egfr_estimated
FROM patients
"""


@register("s1_egfr_equation", with_ctes(_EGFR_SQL, "patients"))
def s1_egfr_equation(spark, sf_dir):
    return ST.with_egfr(patients(spark, sf_dir)).select("patient_id", "egfr_estimated")


@register("s2_s4_staging_table", with_ctes("SELECT * FROM staging", "patients", "staging"))
def s4_staging_table(spark, sf_dir):
    return ST.stage_table(patients(spark, sf_dir))


_STAGE_SPINE = " UNION ALL ".join(
    f"SELECT {i + 1} AS stage_ordinal, '{s}' AS ckd_stage, '{c}' AS colour"
    for i, (s, _lo, _d, c) in enumerate(fixed.STAGES))

_S5_SQL = f"""
SELECT sp.stage_ordinal, sp.ckd_stage, CAST(coalesce(c.n, 0) AS BIGINT) AS n_patients, sp.colour,
       {rhu("coalesce(CAST(coalesce(c.n, 0) AS DOUBLE) / CAST(NULLIF((SELECT count(*) FROM staging), 0) AS DOUBLE), 0e0)", 6)} AS share
FROM ({_STAGE_SPINE}) sp
LEFT JOIN (SELECT ckd_stage, count(*) AS n FROM staging GROUP BY ckd_stage) c ON sp.ckd_stage = c.ckd_stage
"""


@register("s5_stage_distribution", with_ctes(_S5_SQL, "patients", "staging"))
def s5_stage_distribution(spark, sf_dir):
    return ST.stage_distribution(ST.stage_table(patients(spark, sf_dir)))


def _hist_sql(table: str, col: str, n: int, count_name: str, boundaries) -> str:
    lo_e = "(r.lo + b.bin * (r.hi - r.lo) / {n}e0)".format(n=n)
    hi_e = "(r.lo + (b.bin + 1) * (r.hi - r.lo) / {n}e0)".format(n=n)
    labels = ", ".join(
        f"CASE WHEN {v!r} >= {lo_e} AND {v!r} < {hi_e} THEN '{name}' END" for v, name in boundaries)
    lab = f"concat_ws(';', {labels})" if boundaries else "''"
    return f"""
, r AS (SELECT min({col}) AS lo, max({col}) AS hi FROM {table} WHERE {col} IS NOT NULL)
, b AS (SELECT CAST(range AS INTEGER) AS bin FROM range({n}))
, c AS (
  SELECT CASE WHEN r.hi = r.lo THEN 0 ELSE CAST(least(floor(({col} - r.lo) / ((r.hi - r.lo) / {n}e0)), {n - 1}) AS INTEGER) END AS bin,
         count(*) AS n
  FROM {table}, r WHERE {col} IS NOT NULL GROUP BY 1)
SELECT b.bin, {rhu(lo_e, 6)} AS bin_lo, {rhu(hi_e, 6)} AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS {count_name}, {lab} AS boundaries
FROM b CROSS JOIN r LEFT JOIN c ON b.bin = c.bin
"""


def _ctes_then(body_with_leading_comma: str, *names) -> str:
    # with_ctes builds "WITH a AS (..), b AS (..)\n<body>"; extra CTEs follow on.
    return with_ctes(body_with_leading_comma, *names)


@register("s6_egfr_histogram",
          _ctes_then(_hist_sql("staging", "egfr", 30, "n_patients", fixed.STAGE_BOUNDARIES),
                     "patients", "staging"))
def s6_egfr_histogram(spark, sf_dir):
    return ST.egfr_histogram(ST.stage_table(patients(spark, sf_dir)), n_bins=30)
