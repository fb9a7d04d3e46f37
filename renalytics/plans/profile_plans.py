"""Profiling plans (B1-B15) and their SQL twins."""

from __future__ import annotations

from itertools import combinations

from ..functions import fixed
from ..functions.exprs import display_name
from ..functions.spec import COHORT_SPEC
from ..operators import features as FE
from ..operators import observed as OB
from ..operators import profile as P
from ..session import shared_path
from .base import patients, patients_raw, rhu, with_ctes
from ..sources.tables import read_table
from .registry import register

RAW_TYPES = [("patient_id", "bigint"), ("age", "int"), ("gender", "string"),
             ("diabetes", "string"), ("hypertension", "string"), ("foamy_urine", "string"),
             ("extra_salt", "string"), ("living_area", "string"), ("serum_creatinine", "double"),
             ("hemoglobin", "double"), ("egfr", "double"), ("probability", "double"),
             ("ckd_diagnosis", "int")]
RAW_COLS = [c for c, _ in RAW_TYPES]
NUMERIC_DESCRIBE = ["age", "serum_creatinine", "hemoglobin", "egfr", "probability", "ckd_diagnosis"]
CORR_COLS = ["age", "gender", "diabetes", "hypertension", "foamy_urine", "extra_salt",
             "living_area", "serum_creatinine", "hemoglobin", "egfr", "probability",
             "ckd_diagnosis"]
CORR_COLS_NO_LEAK = [c for c in CORR_COLS if c not in fixed.EXCLUDE_FROM_PREDICTION]
CATEGORICAL = ["gender", "diabetes", "hypertension", "foamy_urine", "extra_salt", "living_area"]


# B1 -------------------------------------------------------------------------
_B1 = ('SELECT "column", n_null FROM (' + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null FROM cohort"
    for c in RAW_COLS) + ") t WHERE n_null > 0")


@register("b1_null_counts", with_ctes(_B1))
def b1_null_counts(spark, sf_dir):
    return P.null_counts(patients_raw(spark, sf_dir))


@register("b1_null_counts_on_write", with_ctes(_B1))
def b1_null_counts_on_write(spark, sf_dir):
    """The same counts, observed while the table is written."""
    raw = patients_raw(spark, sf_dir)
    seen = OB.write_counted(raw, shared_path(spark, "patients"), OB.null_counts(raw))
    return spark.createDataFrame([(c, seen[c]) for c in raw.columns if seen[c] > 0], "column string, n_null long")


# B2 -------------------------------------------------------------------------
_B2 = " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS column, '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null, "
    f"CAST(count(*) AS BIGINT) AS n_rows FROM patients" for i, (c, t) in enumerate(RAW_TYPES))


@register("b2_table_info", with_ctes(_B2, "patients"))
def b2_table_info(spark, sf_dir):
    return P.table_info(patients(spark, sf_dir))


@register("b2_head", with_ctes("SELECT * FROM cohort ORDER BY patient_id LIMIT 5"))
def b2_head(spark, sf_dir):
    return P.head(patients_raw(spark, sf_dir), "patient_id", 5)


# B3 -------------------------------------------------------------------------
def _describe_sql(cols, table):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS count, {rhu(f'avg({x})', 6)} AS mean, "
            f"{rhu(f'stddev_samp({x})', 6)} AS std, {rhu(f'min({x})', 6)} AS min, "
            f"{rhu(f'quantile_cont({x}, 0.25)', 6)} AS q25, {rhu(f'quantile_cont({x}, 0.5)', 6)} AS q50, "
            f"{rhu(f'quantile_cont({x}, 0.75)', 6)} AS q75, {rhu(f'max({x})', 6)} AS max FROM {table}")
    return " UNION ALL ".join(parts)


@register("b3_describe", with_ctes(_describe_sql(NUMERIC_DESCRIBE, "patients"), "patients"))
def b3_describe(spark, sf_dir):
    return P.describe(patients(spark, sf_dir), NUMERIC_DESCRIBE)


# B4 -------------------------------------------------------------------------
_NULLS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in RAW_COLS)
_B4 = f"""
SELECT CAST(count(*) AS BIGINT) AS total_patients, CAST({len(RAW_COLS) - 1} AS BIGINT) AS total_features,
  CAST(count(*) FILTER (WHERE ckd_diagnosis = 1) AS BIGINT) AS ckd_positive,
  CAST(count(*) FILTER (WHERE ckd_diagnosis = 0) AS BIGINT) AS ckd_negative,
  {rhu("avg(CASE WHEN ckd_diagnosis = 1 THEN 1e0 ELSE 0e0 END) * 100e0", 1)} AS ckd_percentage,
  {rhu("avg(age)", 1)} AS avg_age, {rhu("avg(serum_creatinine)", 2)} AS avg_serum_creatinine,
  {rhu("avg(egfr)", 1)} AS avg_egfr, {rhu("avg(hemoglobin)", 1)} AS avg_hemoglobin,
  CAST({_NULLS} AS BIGINT) AS null_count
FROM patients
"""


@register("b4_dataset_summary", with_ctes(_B4, "patients"))
def b4_dataset_summary(spark, sf_dir):
    return P.dataset_summary(patients(spark, sf_dir))


# B5 / B15 -------------------------------------------------------------------
@register("b5_target_value_counts", with_ctes(
    "SELECT ckd_diagnosis, CAST(count(*) AS BIGINT) AS n FROM patients "
    "WHERE ckd_diagnosis IS NOT NULL GROUP BY ckd_diagnosis", "patients"))
def b5_target_value_counts(spark, sf_dir):
    return P.value_counts(patients(spark, sf_dir), "ckd_diagnosis")


@register("b15_target_share", with_ctes(
    f"SELECT ckd_diagnosis, n, {rhu('CAST(n AS DOUBLE) / sum(n) OVER ()', 6)} AS share FROM ("
    "SELECT ckd_diagnosis, CAST(count(*) AS BIGINT) AS n FROM patients "
    "WHERE ckd_diagnosis IS NOT NULL GROUP BY ckd_diagnosis) t", "patients"))
def b15_target_share(spark, sf_dir):
    return P.value_counts(patients(spark, sf_dir), "ckd_diagnosis", with_share=True)


# B6 / B8 --------------------------------------------------------------------
_NUMERIC_ALL = [c for c, t in RAW_TYPES if t in ("bigint", "int", "double")]


@register("b6_numeric_projection", with_ctes(f"SELECT {', '.join(_NUMERIC_ALL)} FROM patients",
                                             "patients"))
def b6_numeric_projection(spark, sf_dir):
    df = patients(spark, sf_dir)
    return df.select(*P.numeric_columns(df))


@register("b8_filter_positive", with_ctes("SELECT * FROM patients WHERE ckd_diagnosis = 1",
                                          "patients"))
def b8_filter_positive(spark, sf_dir):
    return P.filter_diagnosis(patients(spark, sf_dir), "positive")


# B9 -------------------------------------------------------------------------
_B9 = f"""
, r AS (SELECT min(serum_creatinine) AS lo, max(serum_creatinine) AS hi FROM patients WHERE serum_creatinine IS NOT NULL)
, c AS (
  SELECT CASE WHEN r.hi = r.lo THEN 0 ELSE CAST(least(floor((serum_creatinine - r.lo) / ((r.hi - r.lo) / 30e0)), 29) AS INTEGER) END AS bin,
         ckd_diagnosis, count(*) AS n
  FROM patients, r WHERE serum_creatinine IS NOT NULL GROUP BY 1, 2)
, sp AS (SELECT CAST(b.range AS INTEGER) AS bin, k.ckd_diagnosis FROM range(30) b, (SELECT DISTINCT ckd_diagnosis FROM c) k)
SELECT sp.bin, sp.ckd_diagnosis, {rhu("r.lo + sp.bin * (r.hi - r.lo) / 30e0", 6)} AS bin_lo,
       {rhu("r.lo + (sp.bin + 1) * (r.hi - r.lo) / 30e0", 6)} AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM sp CROSS JOIN r LEFT JOIN c ON sp.bin = c.bin AND sp.ckd_diagnosis = c.ckd_diagnosis
"""


@register("b9_class_histogram", with_ctes(_B9, "patients"))
def b9_class_histogram(spark, sf_dir):
    return P.class_histogram(patients(spark, sf_dir), "serum_creatinine", 30)


# B10 / B11 ------------------------------------------------------------------
_B10 = " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, ckd_diagnosis, CAST(count(*) AS BIGINT) AS n "
    f"FROM patients WHERE {c} IS NOT NULL GROUP BY {c}, ckd_diagnosis" for c in CATEGORICAL)


@register("b10_category_by_class", with_ctes(_B10, "patients"))
def b10_category_by_class(spark, sf_dir):
    return P.category_by_class(patients(spark, sf_dir), CATEGORICAL)


@register("b11_gender_by_class", with_ctes(
    "SELECT 'gender' AS column, gender AS value, ckd_diagnosis, CAST(count(*) AS BIGINT) AS n "
    "FROM patients WHERE gender IS NOT NULL GROUP BY gender, ckd_diagnosis", "patients"))
def b11_gender_by_class(spark, sf_dir):
    return P.category_by_class(patients(spark, sf_dir), ["gender"])


# B12 ------------------------------------------------------------------------
_AGE_CASE = "CASE " + " ".join(
    f"WHEN age > {lo} AND age <= {hi} THEN '{lab}'"
    for lo, hi, lab in zip(fixed.AGE_EDGES[:-1], fixed.AGE_EDGES[1:], fixed.AGE_LABELS)) + " END"
_AGE_SPINE = " UNION ALL ".join(f"SELECT {i} AS age_ordinal, '{lab}' AS age_group"
                                for i, lab in enumerate(fixed.AGE_LABELS, start=1))
_B12 = f"""
, c AS (SELECT {_AGE_CASE} AS age_group, ckd_diagnosis, count(*) AS n FROM patients GROUP BY 1, 2)
SELECT s.age_ordinal, s.age_group, k.ckd_diagnosis, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM ({_AGE_SPINE}) s CROSS JOIN (SELECT DISTINCT ckd_diagnosis FROM c WHERE age_group IS NOT NULL) k
LEFT JOIN c ON c.age_group = s.age_group AND c.ckd_diagnosis = k.ckd_diagnosis
"""


@register("b12_age_group_by_class", with_ctes(_B12, "patients"))
def b12_age_group_by_class(spark, sf_dir):
    return P.age_group_by_class(patients(spark, sf_dir))


# B13 / B14 ------------------------------------------------------------------
def _corr_sql(cols, table, lower_only):
    aggs = []
    for i, j in combinations(range(len(cols)), 2):
        a, b = f"CAST({cols[i]} AS DOUBLE)", f"CAST({cols[j]} AS DOUBLE)"
        aggs.append(f"covar_pop({a}, {b}) / NULLIF(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
                    f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0) AS r_{i}_{j}")
    for i, c in enumerate(cols):
        aggs.append(f"CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) > 0 THEN 1e0 END AS r_{i}_{i}")
    rows = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            if lower_only and not i > j:
                continue
            rows.append(f"SELECT {i} AS i, {j} AS j, '{cols[i]}' AS x, '{cols[j]}' AS y, "
                        f"'{display_name(cols[i])}' AS x_name, '{display_name(cols[j])}' AS y_name, "
                        f"{rhu(f'r_{min(i, j)}_{max(i, j)}', 6)} AS r FROM w")
    return f", w AS (SELECT {', '.join(aggs)} FROM {table})\n" + " UNION ALL ".join(rows)


@register("b13_correlation_matrix", with_ctes(_corr_sql(CORR_COLS, "encoded", False),
                                              "patients", "encoded"))
def b13_correlation_matrix(spark, sf_dir):
    enc = FE.encode_features(patients(spark, sf_dir), COHORT_SPEC)
    return P.correlation_long(enc, CORR_COLS)


@register("b14_correlation_lower_no_leakage",
          with_ctes(_corr_sql(CORR_COLS_NO_LEAK, "encoded", True), "patients", "encoded"))
def b14_correlation_lower(spark, sf_dir):
    enc = FE.encode_features(patients(spark, sf_dir), COHORT_SPEC)
    return P.correlation_long(enc, CORR_COLS_NO_LEAK, lower_only=True)


_LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register("b13_correlation_lineitem", "WITH base AS (SELECT 1)" + _corr_sql(_LINE_COLS, "lineitem", False))
def b13_correlation_lineitem(spark, sf_dir):
    """The correlation matrix of another, larger table."""
    return P.correlation_long(read_table(spark, sf_dir, "lineitem", _LINE_COLS), _LINE_COLS)


@register("b3_describe_lineitem", "WITH base AS (SELECT 1)" + _describe_sql(_LINE_COLS, "lineitem"))
def b3_describe_lineitem(spark, sf_dir):
    """Quartiles of columns with many distinct values."""
    return P.describe(read_table(spark, sf_dir, "lineitem", _LINE_COLS), _LINE_COLS)
