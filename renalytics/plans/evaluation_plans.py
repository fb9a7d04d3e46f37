"""Evaluation plans (E1-E10, M8 aggregation half) over the fixture scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from .base import rhu, with_ctes
from .fixture_models import (FOLD_PREDS_SQL, FOLDS_SQL, MODEL_ORDER, PREDS_SQL, eval_predictions,
                             fold_predictions)
from .registry import register

_PRED = {"preds": PREDS_SQL}
_ORD = "CASE cm.model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODEL_ORDER)) + " END"

_CM = """
, cm AS (SELECT split, model,
    CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS BIGINT) AS tp,
    CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS BIGINT) AS fn,
    CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS BIGINT) AS tn
  FROM preds GROUP BY split, model)
"""


def _ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / CAST(NULLIF({b}, 0) AS DOUBLE), 0e0)"


_METRICS = (f"{rhu(_ratio('tp + tn', 'tp + fp + fn + tn'), 4)} AS accuracy, "
            f"{rhu(_ratio('tp', 'tp + fp'), 4)} AS precision, "
            f"{rhu(_ratio('tp', 'tp + fn'), 4)} AS recall, "
            f"{rhu(_ratio('2 * tp', '2 * tp + fp + fn'), 4)} AS f1_score, "
            f"{rhu(_ratio('tn', 'tn + fp'), 4)} AS specificity, "
            f"{rhu('(' + _ratio('tp', 'tp + fn') + ' + ' + _ratio('tn', 'tn + fp') + ') / 2e0', 4)} "
            "AS balanced_accuracy")

_AUC = """
, ar AS (SELECT split, model, label,
    rank() OVER (PARTITION BY split, model ORDER BY probability)
      + (count(*) OVER (PARTITION BY split, model, probability) - 1) / 2e0 AS avg_rank
  FROM preds)
, auc AS (SELECT split, model,
    (sum(CASE WHEN label = 1 THEN avg_rank ELSE 0e0 END)
      - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2e0)
    / CAST(NULLIF(count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0), 0) AS DOUBLE) AS roc_auc
  FROM ar GROUP BY split, model)
"""

_COMP = (_CM + _AUC + f", comp AS (SELECT cm.split, cm.model, tp, fp, fn, tn, {_METRICS}, "
         f"{rhu('auc.roc_auc', 4)} AS roc_auc, {_ORD} AS model_ordinal "
         "FROM cm JOIN auc ON cm.split = auc.split AND cm.model = auc.model)\n")


def _comparison(spark, sf_dir):
    return EV.comparison(eval_predictions(spark, sf_dir), model_order=MODEL_ORDER)


@register("e1_confusion_matrix", with_ctes(
    _CM + "SELECT * FROM cm", "split", extra=_PRED))
def e1_confusion_matrix(spark, sf_dir):
    return EV.confusion(eval_predictions(spark, sf_dir))


@register("e2_threshold_metrics", with_ctes(
    _CM + f"SELECT split, model, tp, fp, fn, tn, {_METRICS} FROM cm", "split", extra=_PRED))
def e2_threshold_metrics(spark, sf_dir):
    return EV.metrics(EV.confusion(eval_predictions(spark, sf_dir)))


@register("e3_roc_auc", with_ctes(
    _AUC + f"SELECT split, model, {rhu('roc_auc', 4)} AS roc_auc FROM auc", "split", extra=_PRED))
def e3_roc_auc(spark, sf_dir):
    return EV.roc_auc(eval_predictions(spark, sf_dir))


_ROC = f"""
, d AS (SELECT split, model, probability AS score,
    count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM preds GROUP BY split, model, probability)
, c AS (SELECT *,
    sum(pos) OVER (PARTITION BY split, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
    sum(neg) OVER (PARTITION BY split, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
    sum(pos) OVER (PARTITION BY split, model) AS n_pos, sum(neg) OVER (PARTITION BY split, model) AS n_neg,
    row_number() OVER (PARTITION BY split, model ORDER BY score DESC) - 1 AS k,
    count(*) OVER (PARTITION BY split, model) AS n_points
  FROM d)
, e AS (SELECT *,
    lag(tps) OVER (PARTITION BY split, model ORDER BY k) AS tps_prev,
    lead(tps) OVER (PARTITION BY split, model ORDER BY k) AS tps_next,
    lag(fps) OVER (PARTITION BY split, model ORDER BY k) AS fps_prev,
    lead(fps) OVER (PARTITION BY split, model ORDER BY k) AS fps_next
  FROM c)
, f AS (SELECT * FROM e WHERE k = 0 OR k = n_points - 1
    OR fps_prev - 2 * fps + fps_next <> 0 OR tps_prev - 2 * tps + tps_next <> 0)
SELECT split, model, CAST(row_number() OVER (PARTITION BY split, model ORDER BY score DESC) AS BIGINT) AS idx,
       {rhu(_ratio('fps', 'n_neg'), 6)} AS fpr, {rhu(_ratio('tps', 'n_pos'), 6)} AS tpr, score AS threshold
FROM f
UNION ALL
SELECT DISTINCT split, model, CAST(0 AS BIGINT) AS idx, 0e0 AS fpr, 0e0 AS tpr, CAST(NULL AS DOUBLE) AS threshold
FROM preds
"""


@register("e4_roc_curve", with_ctes(_ROC, "split", extra=_PRED))
def e4_roc_curve(spark, sf_dir):
    return EV.roc_curve(eval_predictions(spark, sf_dir))


@register("e5_model_comparison", with_ctes(_COMP + "SELECT * FROM comp", "split", extra=_PRED))
def e5_model_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir)


_CV = f"""
, fcm AS (SELECT model, fold,
    {_ratio("count(*) FILTER (WHERE label = 1 AND prediction = 1)", "count(*) FILTER (WHERE label = 1)")} AS r
  FROM fold_preds GROUP BY model, fold)
, cv AS (SELECT model, {rhu('avg(r)', 4)} AS cv_recall_mean, {rhu('stddev_pop(r)', 4)} AS cv_recall_std
  FROM fcm GROUP BY model)
"""
_CV_EXTRA = {"preds": PREDS_SQL, "folds": FOLDS_SQL, "fold_preds": FOLD_PREDS_SQL}


@register("m8_cv_recall", with_ctes(_CV + "SELECT * FROM cv", "split", extra=_CV_EXTRA))
def m8_cv_recall(spark, sf_dir):
    return EV.cv_recall(fold_predictions(spark, sf_dir))


@register("e6_comparison_with_cv", with_ctes(
    _COMP + _CV + "SELECT comp.*, cv.cv_recall_mean, cv.cv_recall_std FROM comp "
    "LEFT JOIN cv ON comp.model = cv.model WHERE comp.split = 'validation'", "split", extra=_CV_EXTRA))
def e6_comparison_with_cv(spark, sf_dir):
    comp = _comparison(spark, sf_dir).where(F.col("split") == "validation")
    return EV.with_cv(comp, EV.cv_recall(fold_predictions(spark, sf_dir)))


@register("e7_best_model", with_ctes(
    _COMP + "SELECT * FROM comp WHERE split = 'validation' "
    "ORDER BY recall DESC, f1_score DESC, model_ordinal ASC LIMIT 1", "split", extra=_PRED))
def e7_best_model(spark, sf_dir):
    return EV.best_model(_comparison(spark, sf_dir))


@register("e8_best_base_model", with_ctes(
    _COMP + "SELECT * FROM comp WHERE split = 'validation' AND model <> 'Stacking' "
    "ORDER BY recall DESC, f1_score DESC, model_ordinal ASC LIMIT 1", "split", extra=_PRED))
def e8_best_base_model(spark, sf_dir):
    return EV.best_model(_comparison(spark, sf_dir), exclude=["Stacking"])


_FLAGS = ", ".join(f"{m} = max({m}) OVER (PARTITION BY split) AS is_best_{m}" for m in EV.METRICS)


@register("e9_flag_best", with_ctes(_COMP + f"SELECT *, {_FLAGS} FROM comp", "split", extra=_PRED))
def e9_flag_best(spark, sf_dir):
    return EV.flag_best(_comparison(spark, sf_dir))


_LONG = " UNION ALL ".join(f"SELECT split, model, '{m}' AS metric, {m} AS value FROM comp"
                           for m in EV.METRICS)


@register("e10_comparison_long", with_ctes(_COMP + _LONG, "split", extra=_PRED))
def e10_comparison_long(spark, sf_dir):
    return EV.comparison_long(_comparison(spark, sf_dir))
