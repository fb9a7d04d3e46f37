"""Fitted-model plans.

Models are trained with the original settings on the oversampled training table (real and synthetic rows, stratified
folds).  Fits live in a registry keyed by the versions of the tables, so every plan and session that needs one reuses it.
Fitted probabilities have no SQL form; the ``*_contract`` plans return what must hold of them for any fit, row by row, and
their twins say so.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..functions.spec import COHORT_SPEC
from ..operators import attribution as AT
from ..operators import evaluate as EV
from ..operators import models as MD
from ..operators import smote as SM
from ..operators import tree_shap as TS
from ..operators.model_registry import Registry
from ..operators.scoring import SCORED, score_fitted
from ..session import shared_path
from ..sources.tables import tables_version
from ..streaming import fitted_stream as FS
from .base import patients_raw, rhu, with_ctes
from .fixture_models import LINEAR_CTES, fixture_artefacts, scaled_split
from .io_plans import _round_trip
from .registry import register
from .smote_plans import BINARY, CONT, FEATS, folded_train

_RUNS: dict = {}
LABEL = "label"
REGISTRY_VERSION = 3  # raise when training changes


def _registry(spark, sf_dir, *more) -> Registry:
    return Registry(spark, REGISTRY_VERSION, tables_version(spark, sf_dir), *more, FEATS, MD.BOOSTED, MD.ROUNDS, MD.STEP, MD.DEPTH, MD.N_TREES, MD.SEED)


def _scaled_rows(spark, sf_dir, registry):
    """Scaled patients with ``split``; written once, as training, oversampling and scoring read them several times."""
    return registry.table("scaled", lambda: scaled_split(spark, sf_dir).select("patient_id", "split", *FEATS, "ckd_diagnosis"))


def _training_rows(spark, sf_dir, registry):
    """Oversampled training rows ``(row_id, features..., label, folds...)``."""
    train = _scaled_rows(spark, sf_dir, registry).where(F.col("split") == "train").drop("split")
    syn = SM.smote(train, CONT, BINARY, "ckd_diagnosis", "patient_id")
    real = train.select(F.col("patient_id").alias("row_id"), *FEATS, "ckd_diagnosis")
    synth = syn.select((-(F.col("synthetic_id") + 1)).alias("row_id"), *FEATS, "ckd_diagnosis")
    both = real.unionByName(synth).where(F.col("ckd_diagnosis").isNotNull())
    folded = MD.with_folds(both, COHORT_SPEC.with_(id="row_id"))
    inner = [c for c in folded.columns if c.startswith("inner_")]
    return folded.select("row_id", *FEATS, F.col("ckd_diagnosis").cast("double").alias(LABEL), "fold", *inner)


def training(spark, sf_dir) -> MD.Training:
    """The training run of these tables."""
    key = (spark.sparkContext.applicationId, tables_version(spark, sf_dir))
    if key not in _RUNS:
        registry = _registry(spark, sf_dir)
        table = registry.table("training", lambda: _training_rows(spark, sf_dir, registry))
        _RUNS[key] = MD.Training(table, FEATS, registry)
    return _RUNS[key]


def eval_rows(spark, sf_dir, splits=("validation", "test")):
    return (_scaled_rows(spark, sf_dir, _registry(spark, sf_dir)).where(F.col("split").isin(*splits))
            .select("patient_id", "split", *FEATS, F.col("ckd_diagnosis").alias(LABEL)))


def _predict(spark, sf_dir, name):
    return MD.predict(training(spark, sf_dir).model(name), eval_rows(spark, sf_dir, ("validation",)), ["patient_id", LABEL])


_F13 = "SELECT patient_id, [" + ", ".join(rhu(f"CAST({c} AS DOUBLE)", 6) for c in FEATS) + \
    "] AS features FROM scaled WHERE split = 'validation'"


@register("f13_assemble_features", with_ctes(_F13, "enc_split", extra={"scaled": LINEAR_CTES["scaled"]}))
def f13_assemble_features(spark, sf_dir):
    rows = MD.assembler(FEATS).transform(scaled_split(spark, sf_dir).where(F.col("split") == "validation"))
    return rows.select("patient_id", F.transform(vector_to_array("features"), lambda x: X.round_half_up(x, 6)).alias("features"))


@register("m1_gbt_leaf_wise")
def m1_gbt_leaf_wise(spark, sf_dir):
    return _predict(spark, sf_dir, "LightGBM")


@register("m2_gbt_symmetric")
def m2_gbt_symmetric(spark, sf_dir):
    return _predict(spark, sf_dir, "CatBoost")


@register("m3_gbt_level_wise")
def m3_gbt_level_wise(spark, sf_dir):
    return _predict(spark, sf_dir, "XGBoost")


@register("m4_random_forest")
def m4_random_forest(spark, sf_dir):
    return _predict(spark, sf_dir, "RandomForest")


@register("m5_stacking")
def m5_stacking(spark, sf_dir):
    return _predict(spark, sf_dir, "Stacking")


def _all_predictions(spark, sf_dir):
    return MD.predictions_long(training(spark, sf_dir).models(), eval_rows(spark, sf_dir), ["split", "patient_id", LABEL])


_MODELS_SQL = "(SELECT unnest([" + ", ".join(f"'{m}'" for m in fixed.MODEL_ORDER) + "]) AS model)"


@register("m6_train_all_models", with_ctes(f"""
SELECT model, split, count(*) AS n_rows, count(*) FILTER (WHERE ckd_diagnosis = 1) AS n_positive, TRUE AS recorded
FROM split CROSS JOIN {_MODELS_SQL} m GROUP BY model, split
""", "split"))
def m6_train_all_models(spark, sf_dir):
    """Every recorded model with the rows that it has scored in each split."""
    run = training(spark, sf_dir)
    models = run.models()
    scored = MD.predictions_long(models, eval_rows(spark, sf_dir, ("train", "validation", "test")), ["split", "patient_id", LABEL])
    recorded = run.registry.manifest().where("kind = 'model'").select("member").distinct()
    counts = scored.where("probability IS NOT NULL").groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(LABEL) == 1).alias("n_positive"))
    return counts.join(recorded, counts["model"] == recorded["member"], "left").select(
        "model", "split", "n_rows", "n_positive", F.col("member").isNotNull().alias("recorded"))


@register("m9_predict_all_models")
def m9_predict_all_models(spark, sf_dir):
    return _all_predictions(spark, sf_dir)


@register("m1_m9_prediction_contract", with_ctes(f"""
SELECT model, split, patient_id, ckd_diagnosis AS label, TRUE AS in_range, TRUE AS class_follows
FROM split CROSS JOIN {_MODELS_SQL} m WHERE split IN ('validation', 'test')
""", "split"))
def m1_m9_prediction_contract(spark, sf_dir):
    """Every model scores every row once, between 0 and 1, and its class is probability > 0.5."""
    return _all_predictions(spark, sf_dir).select(
        "model", "split", "patient_id", LABEL, ((F.col("probability") >= 0) & (F.col("probability") <= 1)).alias("in_range"),
        (F.col("prediction") == F.when(F.col("probability") > 0.5, 1).otherwise(0)).alias("class_follows"))


def _fitted_comparison(spark, sf_dir):
    """All metrics of the fitted models; predictions are recorded, as counts and scores are read from them and by other plans."""
    preds = training(spark, sf_dir).registry.table("predictions", lambda: _all_predictions(spark, sf_dir))
    return EV.comparison(preds, model_order=fixed.MODEL_ORDER)


@register("e5_fitted_model_comparison")
def e5_fitted_model_comparison(spark, sf_dir):
    return _fitted_comparison(spark, sf_dir)


def _cv_recall(spark, sf_dir, names):
    """Recall over the folds of models refitted on each of them (M8)."""
    return EV.cv_recall(training(spark, sf_dir).fold_predictions(names))


@register("m8_cv_recall_fitted_leaf_wise")
def m8_cv_recall_fitted_leaf_wise(spark, sf_dir):
    return _cv_recall(spark, sf_dir, ("LightGBM",))


@register("m8_cv_recall_fitted_symmetric")
def m8_cv_recall_fitted_symmetric(spark, sf_dir):
    return _cv_recall(spark, sf_dir, ("CatBoost",))


@register("m8_cv_recall_fitted_level_wise")
def m8_cv_recall_fitted_level_wise(spark, sf_dir):
    return _cv_recall(spark, sf_dir, ("XGBoost",))


@register("m8_cv_recall_fitted_forest")
def m8_cv_recall_fitted_forest(spark, sf_dir):
    return _cv_recall(spark, sf_dir, ("RandomForest",))


@register("m8_cv_recall_fitted_stacking")
def m8_cv_recall_fitted_stacking(spark, sf_dir):
    return _cv_recall(spark, sf_dir, ("Stacking",))


@register("m8_fold_contract", with_ctes(f"""
SELECT model, count(*) AS n_real, count(*) FILTER (WHERE ckd_diagnosis = 1) AS n_positive, 5 AS n_folds, TRUE AS once
FROM split CROSS JOIN {_MODELS_SQL} m WHERE split = 'train' AND ckd_diagnosis IS NOT NULL GROUP BY model
""", "split"))
def m8_fold_contract(spark, sf_dir):
    """Every model holds out every real training row exactly once, over five folds."""
    rows = training(spark, sf_dir).fold_predictions().where("row_id >= 0 AND probability IS NOT NULL")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n_real"), F.count_if(F.col("label") == 1).alias("n_positive"),
                                     F.countDistinct("fold").cast("int").alias("n_folds"),
                                     (F.count(F.lit(1)) == F.countDistinct("row_id")).alias("once"))


def in_fold_training(spark, sf_dir) -> MD.InFoldTraining:
    """The cross-validation of these tables with oversampling inside each fold."""
    key = (spark.sparkContext.applicationId, tables_version(spark, sf_dir), "in-fold")
    if key not in _RUNS:
        registry = _registry(spark, sf_dir, key[2])

        def make():
            real = folded_train(spark, sf_dir)
            syn = SM.smote_in_folds(real, CONT, BINARY, "ckd_diagnosis", "patient_id")
            label = F.col("ckd_diagnosis").cast("double").alias(LABEL)
            return MD.in_fold_table(real.select(F.col("patient_id").alias("row_id"), *FEATS, label, "fold"),
                                    syn.select("for_fold", "synthetic_id", *FEATS, label), FEATS)
        _RUNS[key] = MD.InFoldTraining(registry.table("training", make), FEATS, registry)
    return _RUNS[key]


@register("m8_cv_recall_in_fold_oversampling")
def m8_cv_recall_in_fold_oversampling(spark, sf_dir):
    """CV recall of the single models where each fold is oversampled without the rows it validates on."""
    return EV.cv_recall(in_fold_training(spark, sf_dir).fold_predictions())


_SINGLE_SQL = "(SELECT unnest([" + ", ".join(f"'{m}'" for m in (*MD.BOOSTED, MD.FOREST)) + "]) AS model)"


@register("m8_in_fold_contract", with_ctes(f"""
SELECT model, count(*) AS n_held_out, count(*) FILTER (WHERE ckd_diagnosis = 1) AS n_positive, 5 AS n_folds, TRUE AS once
FROM split CROSS JOIN {_SINGLE_SQL} m WHERE split = 'train' AND ckd_diagnosis IS NOT NULL GROUP BY model
""", "split"))
def m8_in_fold_contract(spark, sf_dir):
    """Every single model holds out every real training row once, and no synthetic row."""
    rows = in_fold_training(spark, sf_dir).fold_predictions().where("probability IS NOT NULL")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n_held_out"), F.count_if(F.col("label") == 1).alias("n_positive"),
                                     F.countDistinct("fold").cast("int").alias("n_folds"),
                                     (F.count(F.lit(1)) == F.countDistinct("row_id")).alias("once"))


@register("e6_fitted_comparison_with_cv")
def e6_fitted_comparison_with_cv(spark, sf_dir):
    """Validation metrics of the fitted models joined with their CV recall, through the result-table sink."""
    comp = _fitted_comparison(spark, sf_dir).where(F.col("split") == "validation")
    return _round_trip(spark, EV.with_cv(comp, _cv_recall(spark, sf_dir, tuple(fixed.MODEL_ORDER))), "csv")


@register("a7_save_load_models", with_ctes(f"""
SELECT model, patient_id, TRUE AS same FROM split CROSS JOIN {_MODELS_SQL} m WHERE split = 'validation'
""", "split"))
def a7_save_load_models(spark, sf_dir):
    """All five models, saved and loaded again: each scores every validation row as before."""
    run = training(spark, sf_dir)
    base = shared_path(spark, "models")
    MD.save_models(run.models(), base)
    loaded, rows = MD.load_models(spark, base), eval_rows(spark, sf_dir, ("validation",))
    before = MD.predictions_long(run.models(), rows, ["patient_id"])
    after = MD.predictions_long(loaded, rows, ["patient_id"]).select("patient_id", "model", F.col("probability").alias("again"))
    return before.join(after, ["patient_id", "model"], "left").select(
        "model", "patient_id", F.coalesce(F.col("again") == F.col("probability"), F.lit(False)).alias("same"))


def _explained_model(spark, sf_dir):
    """The model that E7/E8 select on the validation rows; the ensemble has no tree attribution, so E8."""
    run = training(spark, sf_dir)

    def choose():
        return EV.best_model(_fitted_comparison(spark, sf_dir), exclude=[fixed.ENSEMBLE_NAME])
    name = run.registry.table("explained", choose).first()["model"]
    return name, run.model(name)


@register("r4s_fitted_stream_contract", with_ctes("SELECT patient_id, 1 AS n_rows, TRUE AS same FROM cohort"))
def r4s_fitted_stream_contract(spark, sf_dir):
    """Every raw patient, streamed through the selected model into the batch sink, is there once and scored as in batch."""
    _name, model = _explained_model(spark, sf_dir)
    art, raw, base = fixture_artefacts(spark, sf_dir), patients_raw(spark, sf_dir), shared_path(spark, "fitted-stream")
    raw.write.parquet(f"{base}/in")
    FS.start_fitted_scoring(spark, f"{base}/in", raw.schema, art, model, f"{base}/out", f"{base}/stream", files_per_batch=4).awaitTermination()
    batch = score_fitted(raw, art, model).select("patient_id", F.struct(*SCORED).alias("batch_row"))
    streamed = FS.scored_rows(spark, f"{base}/out").groupBy("patient_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_rows"), F.first(F.struct(*SCORED)).alias("stream_row"))
    return batch.join(streamed, "patient_id", "left").select("patient_id", "n_rows", F.col("batch_row").eqNullSafe(F.col("stream_row")).alias("same"))


@register("x10_feature_importance")
def x10_feature_importance(spark, sf_dir):
    name, model = _explained_model(spark, sf_dir)
    return MD.feature_importance(spark, model).withColumn("model", F.lit(name))


@register("x10_importance_contract", "SELECT unnest([" + ", ".join(f"'{c}'" for c in FEATS)
          + "]) AS feature, TRUE AS in_range, TRUE AS sums_to_one")
def x10_importance_contract(spark, sf_dir):
    """One importance per feature of the selected model, not negative, all together 1."""
    rows = MD.feature_importance(spark, _explained_model(spark, sf_dir)[1], 12)
    total = rows.agg(F.sum("importance").alias("total"))  # one row
    return rows.join(F.broadcast(total), F.lit(True)).select(
        "feature", F.col("importance").between(0, 1).alias("in_range"), (F.abs(F.col("total") - 1) < 1e-9).alias("sums_to_one"))


@register("x1_tree_attribution")
def x1_tree_attribution(spark, sf_dir):
    _name, model = _explained_model(spark, sf_dir)
    wide, _base = TS.tree_attributions(eval_rows(spark, sf_dir, ("validation",)), model)  # carries the feature values along
    return AT.wide_to_long(wide, FEATS, [f"shap__{c}" for c in FEATS])


@register("x1_additivity", with_ctes("SELECT patient_id, TRUE AS adds_up FROM split WHERE split = 'validation'", "split"))
def x1_additivity(spark, sf_dir):
    """Attributions of the selected model plus the baseline give its output for every validation row, to 1e-9."""
    name, model = _explained_model(spark, sf_dir)
    rows = eval_rows(spark, sf_dir, ("validation",))
    wide, base = TS.tree_attributions(rows, model)
    output = "probability" if name == MD.FOREST else "rawPrediction"
    out = model.transform(rows).select("patient_id", vector_to_array(output)[1].alias("output"))
    total = X.add_all([F.col(f"shap__{c}") for c in FEATS]) + F.lit(base)
    return wide.join(out, "patient_id").select("patient_id", (F.abs(total - F.col("output")) <= 1e-9).alias("adds_up"))


@register("x2_expected_value")
def x2_expected_value(spark, sf_dir):
    name, model = _explained_model(spark, sf_dir)
    return TS.expected_value(spark, model).withColumn("model", F.lit(name))


@register("x2_baseline_contract", "SELECT TRUE AS same_baseline")
def x2_baseline_contract(spark, sf_dir):
    """The aggregate over the node table is the baseline of the attributions."""
    _name, model = _explained_model(spark, sf_dir)
    leaves = TS.tree_attributions(eval_rows(spark, sf_dir, ("validation",)), model)[1]
    return TS.expected_value(spark, model).select((F.abs(F.col("expected_value") - leaves) <= 1e-9).alias("same_baseline"))
