"""Scoring of patients with stored artefacts (R4, R5, R7): projections only.

``score_patients`` is a pure row-wise function of its input, so the same code
scores a whole table in batch and a stream of arriving patients (R4s): encode,
scale with the stored training statistics, apply the logistic coefficients,
band (left-closed, as for single patients), estimate eGFR from creatinine,
stage positives, attribute, and write the guidance text.  Top-k factors are
taken per row by sorting a fixed-size array — no explode, window or join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..functions.spec import COHORT_SPEC, ColumnSpec
from .attribution import linear_margin, sigmoid
from .cells import with_probabilities
from .features import _encoders


@dataclass(frozen=True)
class ScoringArtefacts:
    """Everything a fitted linear pipeline needs to score new rows."""
    features: tuple[str, ...]
    scaler: dict[str, float]               # "<col>__mean" / "<col>__scale"
    weights: dict[str, float]
    intercept: float
    means: dict[str, float]                # background means of the scaled features
    scaled: tuple[str, ...] = tuple(fixed.NUMERICAL_FEATURES)
    fill: dict[str, float] = field(default_factory=dict)   # fitted imputation values
    spec: ColumnSpec = field(default=COHORT_SPEC)


def _x(c: str) -> str:
    return f"x__{c}"


def _s(c: str) -> str:
    return f"shap__{c}"


def model_inputs(df: DataFrame, art: ScoringArtefacts) -> DataFrame:
    """Raw columns kept; encoded, imputed and scaled features added as ``x__<feature>``."""
    enc = _encoders(df, art.spec)

    def feature(c: str) -> Column:
        v = F.col(c)
        if c in art.fill:
            v = F.coalesce(v, F.lit(art.fill[c]).cast(df.schema[c].dataType))
        v = (X.encode_map(v, enc[c]) if c in enc else v).cast("double")
        if c in art.scaled:
            v = (v - F.lit(art.scaler[f"{c}__mean"])) / F.lit(art.scaler[f"{c}__scale"])
        return v

    return df.select("*", *[feature(c).alias(_x(c)) for c in art.features])


def top_k(art: ScoringArtefacts, k: int) -> Column:
    """Array of the k largest |attribution| structs, ties by feature order."""
    cells = F.array(*[F.struct((-F.abs(F.col(_s(c)))).alias("neg_abs"), F.lit(i).alias("ordinal"),
                               F.lit(c).alias("feature"), F.col(_s(c)).alias("shap"))
                      for i, c in enumerate(art.features)])
    return F.slice(F.sort_array(cells), 1, k)


def score_patients(df: DataFrame, art: ScoringArtefacts, threshold: float = fixed.DECISION_THRESHOLD
                   ) -> DataFrame:
    """Probability, class, band, eGFR, stage and attributions per row."""
    spec = art.spec
    produced = {"margin", "probability", "prediction", "risk_category", "egfr_estimated",
                "ckd_stage", "stage_description"}
    x = model_inputs(df.drop(*[c for c in df.columns if c in produced]), art)
    w = {_x(c): art.weights[c] for c in art.features}
    margin = linear_margin(w, art.intercept)
    shap = [(F.lit(float(art.weights[c])) * (F.col(_x(c)) - F.lit(art.means[c]))).alias(_s(c))
            for c in art.features]
    scored = x.select("*", margin.alias("margin"), *shap)
    return clinical_columns(scored, sigmoid(F.col("margin")), spec, threshold)


SCORED = ["probability", "prediction", "risk_category", "egfr_estimated", "ckd_stage", "stage_description"]


def clinical_columns(df: DataFrame, p: Column, spec: ColumnSpec, threshold: float) -> DataFrame:
    """Probability, class, band, eGFR and stage beside the raw columns."""
    egfr = X.egfr_ckd_epi(spec.creatinine, spec.age, X.is_female(spec.gender))
    scored = df.select("*", p.alias("probability"),
                       (p > F.lit(threshold)).cast("int").alias("prediction"),
                       X.risk_band(p, "left").alias("risk_category"),
                       egfr.alias("egfr_estimated"))
    stage = X.egfr_stage("egfr_estimated")
    positive = F.col("prediction") == 1
    return scored.select(
        "*",
        F.when(positive, stage).otherwise(F.lit(fixed.NO_CKD_STAGE)).alias("ckd_stage"),
        F.when(positive, X.stage_description(stage))
         .otherwise(F.lit(fixed.NO_CKD_DESCRIPTION)).alias("stage_description"))


def score_fitted(df: DataFrame, art: ScoringArtefacts, model: PipelineModel, threshold: float = fixed.DECISION_THRESHOLD) -> DataFrame:
    """The raw columns with what a fitted pipeline makes of them (R4), on batches (by cells, :mod:`.cells`) and streams (row by row).

    The features are encoded, imputed and scaled as in training.  A row with a NULL or NaN feature left is kept with NULL
    probability, class and band.  Input columns named like an added one are replaced.
    """
    raw = df.drop(*[c for c in df.columns if c in SCORED])
    x = model_inputs(raw, art)
    known = [F.col(_x(c)).isNotNull() & ~F.isnan(_x(c)) for c in art.features]
    packed = x.select(F.struct(*raw.columns).alias("raw"), reduce(lambda a, b: a & b, known).alias("known"),
                      *[F.coalesce(F.nanvl(_x(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in art.features])
    scored = with_probabilities(packed, {"__score": model})
    p = F.when(F.col("known"), F.col("__score"))
    return clinical_columns(scored.select("raw.*", p.alias("__p")), F.col("__p"), art.spec, threshold).drop("__p")


def _names(arr: Column, positive: bool) -> Column:
    kept = F.filter(arr, (lambda s: s["shap"] > 0) if positive else (lambda s: s["shap"] < 0))
    return F.array_join(F.transform(kept, lambda s: X.display_name_expr(s["feature"])), ", ")


def guidance_text(art: ScoringArtefacts, top_n: int = 5) -> Column:
    """Clinical guidance lines of a scored row, joined by newlines: a projection of that row."""
    spec = art.spec
    top = top_k(art, top_n)
    inc, dec = _names(top, True), _names(top, False)
    egfr_line = F.format_string("eGFR = %s mL/min/1.73m² (S.Cr = %s mg/dL)",
                                F.col("egfr_estimated").cast("string"),
                                F.col(spec.creatinine).cast("string"))
    pos = F.array(
        F.format_string("CKD Detected — %s (%s)", F.col("ckd_stage"), F.col("stage_description")),
        F.when(inc != "", F.concat(F.lit("Key risk factors: "), inc)),
        F.when(dec != "", F.concat(F.lit("Protective factors: "), dec)),
        egfr_line, *[F.lit(t) for t in fixed.GUIDANCE_POSITIVE])
    pct = X.round_half_up(F.col("probability") * 100.0, 1)
    neg = F.array(
        F.lit("No CKD Detected"),
        F.when(dec != "", F.concat(F.lit("Protective factors: "), dec)),
        F.when(inc != "", F.concat(F.lit("Watch factors: "), inc,
                                   F.lit(" — these slightly increase risk. Monitor over time."))),
        egfr_line,
        F.format_string("CKD Probability: %.1f%% — %s risk category.", pct, F.col("risk_category")),
        *[F.lit(t) for t in fixed.GUIDANCE_NEGATIVE])
    lines = F.when(F.col("prediction") == 1, pos).otherwise(neg)
    return F.concat_ws("\n", F.array_compact(lines))


def guidance(scored: DataFrame, art: ScoringArtefacts, top_n: int = 5) -> DataFrame:
    """Clinical guidance per scored row."""
    return scored.select(art.spec.id, F.col("prediction"), guidance_text(art, top_n).alias("guidance"))


def readable_values(df: DataFrame, spec: ColumnSpec = COHORT_SPEC) -> DataFrame:
    """Human-readable feature values, long layout."""
    items = [(spec.age, F.concat(F.col(spec.age).cast("string"), F.lit(" years"))),
             (spec.gender, F.col(spec.gender)),
             (spec.hemoglobin, F.concat(F.col(spec.hemoglobin).cast("string"), F.lit(" g/dL")))]
    items += [(c, F.col(c)) for c in spec.yes_no]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"),
                               F.coalesce(v, F.lit("Unknown")).alias("readable")) for c, v in items])
    return df.select(spec.id, F.inline(cells))
