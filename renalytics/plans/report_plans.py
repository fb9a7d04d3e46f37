"""Report plans (R1-R5, R7, R8) for the fixture linear pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import display_name
from ..operators import evaluate as EV
from ..operators import profile as P
from ..operators import report as RP
from ..operators import risk as RK
from ..operators import scoring as SC
from ..operators import staging as ST
from .base import STAGE_CASE, patients, patients_raw, rhu, split_patients, with_ctes
from .evaluation_plans import _AUC, _CM, _COMP
from .fixture_models import (ATTR_ALL_SQL, LINEAR_CTES, LINEAR_WEIGHTS, MODEL_ORDER, PREDS_SQL,
                             eval_predictions, fixture_artefacts)
from .registry import register
from .risk_plans import _BAND_L, _BAND_ORD, _K5, _RISK

_STAGE_OF = lambda e: STAGE_CASE.replace("egfr", e)
_DESC_OF = lambda s: ("CASE " + s + " " + " ".join(
    f"WHEN '{st}' THEN '{d}'" for st, _lo, d, _c in fixed.STAGES) + " ELSE 'Unknown' END")
_DISPLAY = ("CASE feature " + " ".join(f"WHEN '{c}' THEN '{display_name(c)}'" for c in LINEAR_WEIGHTS)
            + " END")


def _scored_validation(spark, sf_dir):
    art = fixture_artefacts(spark, sf_dir)
    val = split_patients(spark, sf_dir).where(F.col("split") == "validation")
    return SC.score_patients(val, art), art


# R1 -------------------------------------------------------------------------
def _tops_sql(n: int) -> str:
    parts = []
    for i in range(1, n + 1):
        parts += [f"max(CASE WHEN rank = {i} THEN feature END) AS top{i}_feature",
                  f"max(CASE WHEN rank = {i} THEN {rhu('shap_value', 4)} END) AS top{i}_shap",
                  f"max(CASE WHEN rank = {i} THEN CASE WHEN shap_value > 0 THEN 'increases' ELSE 'decreases' END END) "
                  f"AS top{i}_direction"]
    return ", ".join(parts)


_R1_CTE = f"""
SELECT p.patient_id, p.age, coalesce(p.gender, 'Unknown') AS gender, p.serum_creatinine, p.egfr, p.hemoglobin,
  CASE WHEN l.probability > 0.5e0 THEN 'CKD' ELSE 'Not CKD' END AS prediction,
  {rhu('l.probability * 100e0', 2)} AS ckd_probability_pct,
  CASE WHEN l.probability < 0.3e0 THEN 'Low' WHEN l.probability < 0.7e0 THEN 'Medium' ELSE 'High' END AS risk_category,
  CASE WHEN l.probability > 0.5e0 THEN {_STAGE_OF('p.egfr')} ELSE 'N/A' END AS ckd_stage,
  CASE WHEN l.probability > 0.5e0 THEN {_DESC_OF(_STAGE_OF('p.egfr'))} ELSE 'No CKD detected' END AS stage_description,
  CASE WHEN p.ckd_diagnosis = 1 THEN 'CKD' ELSE 'Not CKD' END AS actual_label,
  tp.* EXCLUDE (patient_id)
FROM lin l JOIN patients p ON l.patient_id = p.patient_id
JOIN (SELECT patient_id, {_tops_sql(3)} FROM (
        SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY abs(shap_value) DESC, feature_ordinal) AS rank
        FROM attr) t WHERE rank <= 3 GROUP BY patient_id) tp ON tp.patient_id = l.patient_id
WHERE l.split = 'validation'
"""
_R1_EXTRA = dict(LINEAR_CTES, r1=_R1_CTE)


@register("r1_patient_report_rows", with_ctes("SELECT * FROM r1", "enc_split", extra=_R1_EXTRA))
def r1_patient_report_rows(spark, sf_dir):
    scored, art = _scored_validation(spark, sf_dir)
    return RP.report_rows(scored, art)


def _report_rows_all(spark, sf_dir):
    art = fixture_artefacts(spark, sf_dir)
    scored = SC.score_patients(split_patients(spark, sf_dir), art)
    return RP.report_rows(scored, art, split_col="split")


_R1_ALL = _R1_CTE.replace("SELECT p.patient_id,", "SELECT p.patient_id, l.split,", 1).replace("WHERE l.split = 'validation'", "")
_R1_ALL_EXTRA = dict(LINEAR_CTES, attr=ATTR_ALL_SQL, r1=_R1_ALL)


@register("r1_patient_report_rows_all", with_ctes("SELECT * FROM r1", "enc_split", extra=_R1_ALL_EXTRA))
def r1_patient_report_rows_all(spark, sf_dir):
    """Every patient, of every split."""
    return _report_rows_all(spark, sf_dir)


# R2 -------------------------------------------------------------------------
def _s(e: str) -> str:
    return f"coalesce(CAST({e} AS VARCHAR), 'nan')"


_R2_LINES = [
    f"'{fixed.REPORT_RULE}'", f"'{fixed.REPORT_TITLE}'", f"'{fixed.REPORT_RULE}'", "''",
    "'  Patient ID (Validation Set): ' || CAST(patient_id AS VARCHAR)", "''", "'--- DEMOGRAPHICS ---'",
    "'  Age:         ' || CAST(age AS VARCHAR)", "'  Gender:      ' || gender", "''",
    "'--- CLINICAL VALUES ---'",
    f"'  Serum Creatinine: ' || {_s('serum_creatinine')} || ' mg/dL'",
    f"'  eGFR:             ' || {_s('egfr')} || ' mL/min/1.73m²'",
    f"'  Hemoglobin:       ' || {_s('hemoglobin')} || ' g/dL'", "''", "'--- ML PREDICTION ---'",
    "'  Prediction:   ' || prediction", f"'  CKD Probability: ' || {_s('ckd_probability_pct')} || '%'",
    "'  Risk Category:   ' || risk_category", "''", "'--- CKD STAGING ---'",
    f"'  eGFR:        ' || {_s('egfr')} || ' mL/min/1.73m²'", "'  CKD Stage:   ' || ckd_stage",
    "'  Description: ' || stage_description", "''", "'--- TOP EXPLANATIONS (SHAP) ---'",
    *[f"printf('  %d. %s %s CKD risk (SHAP = %+.4f)', {i}, top{i}_feature, top{i}_direction, top{i}_shap)"
      for i in (1, 2, 3)],
    "''", "'  Actual Label: ' || actual_label", "''", f"'{fixed.REPORT_RULE}'",
    *[f"'{t}'" for t in fixed.REPORT_DISCLAIMER], f"'{fixed.REPORT_RULE}'",
]
_R2 = f"SELECT patient_id, concat_ws(chr(10), {', '.join(_R2_LINES)}) AS report_text FROM r1"


@register("r2_report_text", with_ctes(_R2, "enc_split", extra=_R1_EXTRA))
def r2_report_text(spark, sf_dir):
    scored, art = _scored_validation(spark, sf_dir)
    return RP.report_text(RP.report_rows(scored, art))


_R2_ALL = _R2.replace("'  Patient ID (Validation Set): '",
                      "'  Patient ID (' || upper(substr(split, 1, 1)) || substr(split, 2) || ' Set): '")


@register("r2_report_text_all", with_ctes(_R2_ALL, "enc_split", extra=_R1_ALL_EXTRA))
def r2_report_text_all(spark, sf_dir):
    return RP.report_text(_report_rows_all(spark, sf_dir))


# R3 -------------------------------------------------------------------------
_R3_STAGES = f"""SELECT sp.ckd_stage AS key, CAST(coalesce(c.n, 0) AS DOUBLE) AS value FROM (
  {' UNION ALL '.join(f"SELECT '{s}' AS ckd_stage" for s in fixed.STAGE_ORDER)}) sp
  LEFT JOIN (SELECT ckd_stage, count(*) AS n FROM staging GROUP BY 1) c ON sp.ckd_stage = c.ckd_stage"""
_R3_BANDS = ("SELECT s.risk_category AS key, CAST(coalesce(c.n, 0) AS DOUBLE) AS value "
             f"FROM ({_BAND_ORD}) s LEFT JOIN (SELECT risk_category, count(*) AS n FROM risk "
             "WHERE risk_category IS NOT NULL GROUP BY 1) c ON s.risk_category = c.risk_category")
_R3_METRICS = " UNION ALL ".join(
    f"SELECT model AS key, '{m}' AS series, CAST({m} AS DOUBLE) AS value FROM comp WHERE split = 'validation'"
    for m in EV.METRICS)
_R3 = (_COMP + _K5.replace("SELECT CAST(b.range", ", hist AS (SELECT CAST(b.range", 1).rstrip()
       + ")\n" +
       f"SELECT 'metrics' AS panel, key, series, value FROM ({_R3_METRICS}) m "
       f"UNION ALL SELECT 'risk_bands', key, 'n', value FROM ({_R3_BANDS}) b "
       f"UNION ALL SELECT 'stages', key, 'n', value FROM ({_R3_STAGES}) s "
       "UNION ALL SELECT 'probability_histogram', CAST(bin AS VARCHAR), 'n', CAST(n AS DOUBLE) FROM hist")


@register("r3_dashboard_bundle", with_ctes(_R3, "split", "staging", extra=dict(_RISK, preds=PREDS_SQL)))
def r3_dashboard_bundle(spark, sf_dir):
    comp = EV.comparison(eval_predictions(spark, sf_dir), model_order=MODEL_ORDER)
    metrics_long = EV.comparison_long(comp.where(F.col("split") == "validation"))
    val = (split_patients(spark, sf_dir).where(F.col("split") == "validation")
           .select("patient_id", "probability", F.col("ckd_diagnosis").alias("label")))
    risk = RK.risk_table(val)
    stages = ST.stage_distribution(ST.stage_table(patients(spark, sf_dir)))
    return RP.dashboard_bundle(metrics_long, RK.band_distribution(risk), stages,
                               RK.probability_histogram(risk, 20))


# R4 / R5 --------------------------------------------------------------------
_EGFR_EQ = rhu(
    "142e0 * power(p.serum_creatinine / (CASE WHEN p.gender = 'Female' THEN 0.7e0 ELSE 0.9e0 END), "
    "CASE WHEN p.serum_creatinine <= (CASE WHEN p.gender = 'Female' THEN 0.7e0 ELSE 0.9e0 END) "
    "THEN (CASE WHEN p.gender = 'Female' THEN -0.241e0 ELSE -0.302e0 END) ELSE -1.2e0 END) "
    "* power(0.9938e0, CAST(p.age AS DOUBLE))", 2)
_R4_CTE = f"""
SELECT p.patient_id, p.serum_creatinine, l.probability, CASE WHEN l.probability > 0.5e0 THEN 1 ELSE 0 END AS prediction,
  CASE WHEN l.probability < 0.3e0 THEN 'Low' WHEN l.probability < 0.7e0 THEN 'Medium' ELSE 'High' END AS risk_category,
  CASE WHEN p.serum_creatinine > 0 THEN {_EGFR_EQ} END AS egfr_estimated
FROM lin l JOIN patients p ON l.patient_id = p.patient_id
"""
_R4_STAGED = f"""
SELECT *, CASE WHEN prediction = 1 THEN {_STAGE_OF('egfr_estimated')} ELSE 'N/A' END AS ckd_stage,
  CASE WHEN prediction = 1 THEN {_DESC_OF(_STAGE_OF('egfr_estimated'))} ELSE 'No CKD detected' END AS stage_description
FROM r4a
"""
_R4_EXTRA = dict(LINEAR_CTES, attr_all=ATTR_ALL_SQL, r4a=_R4_CTE, r4=_R4_STAGED)


@register("r4_score_new_patients", with_ctes(
    f"SELECT patient_id, {rhu('probability', 6)} AS probability, prediction, risk_category, egfr_estimated, "
    "ckd_stage, stage_description FROM r4", "enc_split", extra=_R4_EXTRA))
def r4_score_new_patients(spark, sf_dir):
    art = fixture_artefacts(spark, sf_dir)
    from ..functions import exprs as X
    s = SC.score_patients(patients_raw(spark, sf_dir), art)
    return s.select("patient_id", X.round_half_up("probability", 6).alias("probability"),
                    "prediction", "risk_category", "egfr_estimated", "ckd_stage", "stage_description")


_R5 = f"""
, t AS (SELECT *, {_DISPLAY} AS name,
          row_number() OVER (PARTITION BY patient_id ORDER BY abs(shap_value) DESC, feature_ordinal) AS rank
        FROM attr_all)
, f AS (SELECT patient_id,
          coalesce(string_agg(CASE WHEN shap_value > 0 THEN name END, ', ' ORDER BY rank), '') AS inc,
          coalesce(string_agg(CASE WHEN shap_value < 0 THEN name END, ', ' ORDER BY rank), '') AS dec
        FROM t WHERE rank <= 5 GROUP BY patient_id)
SELECT r.patient_id, r.prediction, CASE WHEN r.prediction = 1 THEN concat_ws(chr(10),
    'CKD Detected — ' || r.ckd_stage || ' (' || r.stage_description || ')',
    CASE WHEN f.inc <> '' THEN 'Key risk factors: ' || f.inc END,
    CASE WHEN f.dec <> '' THEN 'Protective factors: ' || f.dec END,
    'eGFR = ' || CAST(r.egfr_estimated AS VARCHAR) || ' mL/min/1.73m² (S.Cr = ' || CAST(r.serum_creatinine AS VARCHAR) || ' mg/dL)',
    {', '.join(f"'{t}'" for t in fixed.GUIDANCE_POSITIVE)})
  ELSE concat_ws(chr(10), 'No CKD Detected',
    CASE WHEN f.dec <> '' THEN 'Protective factors: ' || f.dec END,
    CASE WHEN f.inc <> '' THEN 'Watch factors: ' || f.inc || ' — these slightly increase risk. Monitor over time.' END,
    'eGFR = ' || CAST(r.egfr_estimated AS VARCHAR) || ' mL/min/1.73m² (S.Cr = ' || CAST(r.serum_creatinine AS VARCHAR) || ' mg/dL)',
    printf('CKD Probability: %.1f%% — %s risk category.', {rhu('r.probability * 100e0', 1)}, r.risk_category),
    {', '.join(f"'{t}'" for t in fixed.GUIDANCE_NEGATIVE)}) END AS guidance
FROM r4 r JOIN f ON r.patient_id = f.patient_id
"""


@register("r5_clinical_guidance", with_ctes(_R5, "enc_split", extra=_R4_EXTRA))
def r5_clinical_guidance(spark, sf_dir):
    art = fixture_artefacts(spark, sf_dir)
    return SC.guidance(SC.score_patients(patients_raw(spark, sf_dir), art), art)


# R7 -------------------------------------------------------------------------
_R7 = " UNION ALL ".join([
    "SELECT patient_id, 'age' AS feature, coalesce(CAST(age AS VARCHAR) || ' years', 'Unknown') AS readable FROM patients",
    "SELECT patient_id, 'gender', coalesce(gender, 'Unknown') FROM patients",
    "SELECT patient_id, 'hemoglobin', coalesce(CAST(hemoglobin AS VARCHAR) || ' g/dL', 'Unknown') FROM patients",
    *[f"SELECT patient_id, '{c}', coalesce({c}, 'Unknown') FROM patients"
      for c in ("diabetes", "hypertension", "foamy_urine", "extra_salt")]])


@register("r7_readable_values", with_ctes(_R7, "patients"))
def r7_readable_values(spark, sf_dir):
    return SC.readable_values(patients(spark, sf_dir))


# R8 -------------------------------------------------------------------------
_R8 = (_COMP + """
, best AS (SELECT model FROM comp WHERE split = 'validation'
           ORDER BY recall DESC, f1_score DESC, model_ordinal ASC LIMIT 1)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM patients) AS total_patients, c.model AS best_model,
""" + ", ".join(f"max(CASE WHEN c.split = '{s}' THEN c.{m} END) AS {p}_{m}"
                for s, p in (("validation", "val"), ("test", "test"))
                for m in ("accuracy", "recall", "f1_score", "roc_auc"))
       + " FROM comp c JOIN best ON c.model = best.model GROUP BY c.model")


@register("r8_run_summary", with_ctes(_R8, "split", extra={"preds": PREDS_SQL}))
def r8_run_summary(spark, sf_dir):
    comp = EV.comparison(eval_predictions(spark, sf_dir), model_order=MODEL_ORDER)
    best = EV.best_model(comp)
    return RP.run_summary(comp, best, P.dataset_summary(patients(spark, sf_dir)))
