"""Patient report rows, report cards, dashboard bundle and run summary.

A report row is a projection of the scored frame (raw columns, prediction and
per-feature attributions side by side), so reports for every patient cost one
pass and no join.  The card text is built from the same row with
``format_string`` / ``concat_ws`` and written as one text record per patient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from .scoring import ScoringArtefacts, top_k


def _num_str(c: Column) -> Column:
    """Python-like text of a float; NULL prints as 'nan' like the original."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def report_rows(scored: DataFrame, art: ScoringArtefacts, n_top: int = 3,
                split_col: str | None = None) -> DataFrame:
    """Flattened report row per patient (R1); ``split_col`` adds the patient's own split.

    Stage and description only for predicted positives ("N/A" otherwise), from
    the stored eGFR; band left-closed as for a single patient; top factors by
    |attribution| with their rounded value and direction.
    """
    spec = art.spec
    positive = F.col("prediction") == 1
    stored_egfr = F.col(spec.egfr)
    stage = X.egfr_stage(stored_egfr)
    top = top_k(art, n_top)
    tops = []
    for i in range(n_top):
        cell = F.element_at(top, i + 1)
        tops += [cell["feature"].alias(f"top{i + 1}_feature"),
                 X.round_half_up(cell["shap"], fixed.METRIC_DECIMALS).alias(f"top{i + 1}_shap"),
                 F.when(cell["shap"] > 0, F.lit("increases")).otherwise(F.lit("decreases"))
                 .alias(f"top{i + 1}_direction")]
    cols = [F.col(spec.id).alias("patient_id")]
    if split_col is not None:
        cols.append(F.col(split_col).alias("split"))
    return scored.select(
        *cols,
        F.col(spec.age).alias("age"),
        F.coalesce(F.col(spec.gender), F.lit("Unknown")).alias("gender"),
        F.col(spec.creatinine).alias("serum_creatinine"),
        stored_egfr.alias("egfr"),
        F.col(spec.hemoglobin).alias("hemoglobin"),
        F.when(positive, F.lit("CKD")).otherwise(F.lit("Not CKD")).alias("prediction"),
        X.round_half_up(F.col("probability") * 100.0, 2).alias("ckd_probability_pct"),
        X.risk_band("probability", "left").alias("risk_category"),
        F.when(positive, stage).otherwise(F.lit(fixed.NO_CKD_STAGE)).alias("ckd_stage"),
        F.when(positive, X.stage_description(stage))
         .otherwise(F.lit(fixed.NO_CKD_DESCRIPTION)).alias("stage_description"),
        F.when(F.col(spec.target) == 1, F.lit("CKD")).otherwise(F.lit("Not CKD")).alias("actual_label"),
        *tops)


def report_text(rows: DataFrame, n_top: int = 3, split_label: str = "Validation") -> DataFrame:
    """Report card text per patient (R2), labelled by the split it came from.

    Rows with a ``split`` column are labelled by it, others by ``split_label``.
    """
    label = F.initcap("split") if "split" in rows.columns else F.lit(split_label)
    def explanation(i: int) -> Column:
        return F.format_string("  %d. %s %s CKD risk (SHAP = %+.4f)", F.lit(i),
                               F.col(f"top{i}_feature"), F.col(f"top{i}_direction"),
                               F.col(f"top{i}_shap"))
    egfr = _num_str(F.col("egfr"))
    lines = [
        F.lit(fixed.REPORT_RULE), F.lit(fixed.REPORT_TITLE), F.lit(fixed.REPORT_RULE), F.lit(""),
        F.format_string("  Patient ID (%s Set): %s", label, F.col("patient_id").cast("string")),
        F.lit(""), F.lit("--- DEMOGRAPHICS ---"),
        F.format_string("  Age:         %s", F.col("age").cast("string")),
        F.format_string("  Gender:      %s", F.col("gender")),
        F.lit(""), F.lit("--- CLINICAL VALUES ---"),
        F.format_string("  Serum Creatinine: %s mg/dL", _num_str(F.col("serum_creatinine"))),
        F.format_string("  eGFR:             %s mL/min/1.73m²", egfr),
        F.format_string("  Hemoglobin:       %s g/dL", _num_str(F.col("hemoglobin"))),
        F.lit(""), F.lit("--- ML PREDICTION ---"),
        F.format_string("  Prediction:   %s", F.col("prediction")),
        F.format_string("  CKD Probability: %s%%", _num_str(F.col("ckd_probability_pct"))),
        F.format_string("  Risk Category:   %s", F.col("risk_category")),
        F.lit(""), F.lit("--- CKD STAGING ---"),
        F.format_string("  eGFR:        %s mL/min/1.73m²", egfr),
        F.format_string("  CKD Stage:   %s", F.col("ckd_stage")),
        F.format_string("  Description: %s", F.col("stage_description")),
        F.lit(""), F.lit("--- TOP EXPLANATIONS (SHAP) ---"),
        *[explanation(i) for i in range(1, n_top + 1)],
        F.lit(""), F.format_string("  Actual Label: %s", F.col("actual_label")), F.lit(""),
        F.lit(fixed.REPORT_RULE), *[F.lit(t) for t in fixed.REPORT_DISCLAIMER],
        F.lit(fixed.REPORT_RULE),
    ]
    return rows.select("patient_id", F.concat_ws("\n", *lines).alias("report_text"))


def dashboard_bundle(metrics_long: DataFrame, bands: DataFrame, stages: DataFrame,
                     histogram: DataFrame) -> DataFrame:
    """Data behind the four dashboard panels as ``(panel, key, series, value)``."""
    m = metrics_long.select(F.lit("metrics").alias("panel"), F.col("model").alias("key"),
                            F.col("metric").alias("series"), F.col("value").cast("double").alias("value"))
    b = bands.select(F.lit("risk_bands").alias("panel"), F.col("risk_category").alias("key"),
                     F.lit("n").alias("series"), F.col("n").cast("double").alias("value"))
    s = stages.select(F.lit("stages").alias("panel"), F.col("ckd_stage").alias("key"),
                      F.lit("n").alias("series"), F.col("n_patients").cast("double").alias("value"))
    h = histogram.select(F.lit("probability_histogram").alias("panel"),
                         F.col("bin").cast("string").alias("key"), F.lit("n").alias("series"),
                         F.col("n").cast("double").alias("value"))
    return m.unionByName(b).unionByName(s).unionByName(h)


def run_summary(comparison: DataFrame, best: DataFrame, total_patients: DataFrame) -> DataFrame:
    """n, best model, its validation and test metrics in one row."""
    keep = ["accuracy", "recall", "f1_score", "roc_auc"]
    # ``best`` is a one-row top-1 result: broadcasting it is bounded by construction
    c = comparison.join(F.broadcast(best.select("model")), "model")
    wide = c.groupBy("model").agg(*[
        F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{p}_{m}")
        for s, p in (("validation", "val"), ("test", "test")) for m in keep])
    total = F.lit(total_patients.select("total_patients").first()[0]).cast("bigint")
    return wide.select(total.alias("total_patients"), F.col("model").alias("best_model"),
                       *[f"{p}_{m}" for p in ("val", "test") for m in keep])
