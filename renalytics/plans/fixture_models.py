"""Deterministic "models" for SQL-checkable evaluation.

The cohort carries a fixed score ``probability``; three more scorers are
derived from it so that evaluation, risk and report operators can be checked
value by value without a fitted model.  ``Stacking`` averages the three base
scores, mirroring the ensemble's place in the model list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import split as SP
from .base import split_patients

# FIXED VALUES — fixture scorer names in model order
MODEL_ORDER = ["linear_p", "squared_p", "centered_p", "Stacking"]


def score_exprs(p):
    sq = p * p
    ce = F.lit(1.0) - F.abs(F.lit(0.5) - p)
    return {"linear_p": p, "squared_p": sq, "centered_p": ce, "Stacking": (p + sq + ce) / 3.0}


def long_scores(df: DataFrame, prob: str = "probability") -> DataFrame:
    """One row per (row, model) with that model's probability."""
    arr = F.array(*[F.struct(F.lit(n).alias("model"), e.alias("m_probability"))
                    for n, e in score_exprs(F.col(prob)).items()])
    return df.select("*", F.inline(arr)).drop(prob).withColumnRenamed("m_probability", prob)


def eval_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and test predictions of every fixture model."""
    sp = split_patients(spark, sf_dir).where(F.col("split").isin("validation", "test"))
    base = sp.select("split", "patient_id", F.col("ckd_diagnosis").alias("label"), "probability")
    return EV.predictions(long_scores(base))


def fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with their fold, scored by every fixture model."""
    train = split_patients(spark, sf_dir).where(F.col("split") == "train")
    folds = SP.kfold_assign(train.select("patient_id", "ckd_diagnosis", "probability"))
    base = folds.select("fold", "patient_id", F.col("ckd_diagnosis").alias("label"), "probability")
    return EV.predictions(long_scores(base))


SQL_SCORES = {
    "linear_p": "probability",
    "squared_p": "probability * probability",
    "centered_p": "1e0 - abs(0.5e0 - probability)",
    "Stacking": "(probability + probability * probability + (1e0 - abs(0.5e0 - probability))) / 3e0",
}

PREDS_SQL = " UNION ALL ".join(
    f"SELECT split, '{m}' AS model, patient_id, ckd_diagnosis AS label, {e} AS probability, "
    f"CASE WHEN {e} > 0.5e0 THEN 1 ELSE 0 END AS prediction FROM split "
    f"WHERE split IN ('validation', 'test')" for m, e in SQL_SCORES.items())

FOLD_PREDS_SQL = " UNION ALL ".join(
    f"SELECT fold, '{m}' AS model, patient_id, label, {e} AS probability, "
    f"CASE WHEN {e} > 0.5e0 THEN 1 ELSE 0 END AS prediction FROM folds" for m, e in SQL_SCORES.items())

FOLDS_SQL = """
SELECT patient_id, ckd_diagnosis AS label, probability,
       CAST((row_number() OVER (PARTITION BY ckd_diagnosis ORDER BY h, patient_id) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT patient_id, ckd_diagnosis, probability,
             ('0x' || substr(md5('42|kfold|' || CAST(patient_id AS VARCHAR)), 1, 15))::BIGINT AS h
      FROM split WHERE split = 'train') t
"""


# FIXED VALUES — coefficients of the fixture logistic model on scaled features
LINEAR_WEIGHTS = {"age": 0.8, "gender": -0.3, "diabetes": 0.6, "hypertension": 0.5,
                  "foamy_urine": 0.4, "extra_salt": 0.2, "living_area": -0.1, "hemoglobin": -0.7}
LINEAR_INTERCEPT = 1.5
SCALED_NUM = ["age", "hemoglobin"]


def scaled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded patients with split, numeric features scaled by training statistics."""
    from ..operators import features as FE
    from .base import cached_fit, encoded_split
    es = encoded_split(spark, sf_dir)
    stats = cached_fit(spark, sf_dir, "scaler", lambda: FE.collect_stats(
        FE.fit_scaler(es.where(F.col("split") == "train"), SCALED_NUM)))
    return FE.apply_scaler(es, stats, SCALED_NUM)


def _lin_sql() -> str:
    terms = " + ".join([repr(float(LINEAR_INTERCEPT))]
                       + [f"({float(w)!r}) * CAST({c} AS DOUBLE)" for c, w in LINEAR_WEIGHTS.items()])
    return terms


SCALED_SQL = (
    "SELECT e.patient_id, e.split, "
    + ", ".join(f"(CAST(e.{c} AS DOUBLE) - st.{c}_m) / st.{c}_s AS {c}" if c in SCALED_NUM
                else f"e.{c}" for c in LINEAR_WEIGHTS)
    + ", e.ckd_diagnosis, e.age AS age_years, e.hemoglobin AS hemoglobin_raw FROM enc_split e CROSS JOIN ("
    + "SELECT " + ", ".join(
        f"avg(CAST({c} AS DOUBLE)) AS {c}_m, CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1e0 "
        f"ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS {c}_s" for c in SCALED_NUM)
    + " FROM enc_split WHERE split = 'train') st")

LIN_SQL = (f"SELECT patient_id, split, ckd_diagnosis, {_lin_sql()} AS margin FROM scaled")
LIN_PROB_SQL = "SELECT *, 1e0 / (1e0 + exp(-margin)) AS probability FROM lin0"
BG_SQL = ("SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in LINEAR_WEIGHTS)
          + " FROM scaled WHERE split = 'train'")
ATTR_SQL = " UNION ALL ".join(
    f"SELECT s.patient_id, '{c}' AS feature, {i} AS feature_ordinal, CAST(s.{c} AS DOUBLE) AS feature_value, "
    f"({float(w)!r}) * (CAST(s.{c} AS DOUBLE) - bg.{c}) AS shap_value FROM scaled s CROSS JOIN bg "
    f"WHERE s.split = 'validation'" for i, (c, w) in enumerate(LINEAR_WEIGHTS.items()))
BASELINE_SQL = " + ".join(f"({float(w)!r}) * bg.{c}" for c, w in LINEAR_WEIGHTS.items())

LINEAR_CTES = {"scaled": SCALED_SQL, "lin0": LIN_SQL, "lin": LIN_PROB_SQL, "bg": BG_SQL,
               "attr": ATTR_SQL}


def fixture_artefacts(spark: SparkSession, sf_dir: str):
    """Fit the scoring artefacts of the fixture linear pipeline (small jobs, once)."""
    from ..operators import features as FE
    from ..operators.scoring import ScoringArtefacts
    from .base import FEATURES, cached_fit, encoded_split, hemoglobin_median

    def fit():
        es = encoded_split(spark, sf_dir)
        train = es.where(F.col("split") == "train")
        scaler = cached_fit(spark, sf_dir, "scaler",
                            lambda: FE.collect_stats(FE.fit_scaler(train, SCALED_NUM)))
        scaled_train = FE.apply_scaler(train, scaler, SCALED_NUM)
        means = scaled_train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in FEATURES]).first()
        return ScoringArtefacts(features=tuple(FEATURES), scaler=scaler, weights=dict(LINEAR_WEIGHTS),
                                intercept=LINEAR_INTERCEPT, means=means.asDict(),
                                scaled=tuple(SCALED_NUM), fill=hemoglobin_median(spark, sf_dir))
    return cached_fit(spark, sf_dir, "artefacts", fit)


ATTR_ALL_SQL = " UNION ALL ".join(
    f"SELECT s.patient_id, '{c}' AS feature, {i} AS feature_ordinal, "
    f"({float(w)!r}) * (CAST(s.{c} AS DOUBLE) - bg.{c}) AS shap_value FROM scaled s CROSS JOIN bg"
    for i, (c, w) in enumerate(LINEAR_WEIGHTS.items()))
