"""Model evaluation over a long prediction table.

Input: ``(split, model, id, label, probability, prediction)`` for every model
and split at once, so one ``groupBy(split, model)`` evaluates everything in a
single job.  AUC and the ROC curve are exact (ties averaged) and never put a
whole model's scores in one task: scores are collapsed to distinct values once and
dealt into equal ranges for two-level running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..session import cut_lineage
from .rank import cumulative_within

GROUP = ["split", "model"]
METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]


def predictions(scores: DataFrame, threshold: float = fixed.DECISION_THRESHOLD,
                prob_col: str = "probability") -> DataFrame:
    """Class 1 when the probability is above the threshold (argmax of two classes)."""
    return scores.withColumn("prediction", (F.col(prob_col) > F.lit(threshold)).cast("int"))


# E1 -------------------------------------------------------------------------
def confusion(preds: DataFrame, group: list[str] = GROUP, label: str = "label",
              pred: str = "prediction") -> DataFrame:
    """TP, FP, FN, TN per group; every cell present (zero when empty)."""
    y, p = F.col(label), F.col(pred)
    return preds.groupBy(*group).agg(
        F.count_if((y == 1) & (p == 1)).cast("bigint").alias("tp"),
        F.count_if((y == 0) & (p == 1)).cast("bigint").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("bigint").alias("fn"),
        F.count_if((y == 0) & (p == 0)).cast("bigint").alias("tn"))


def confusion_long(cm: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """2x2 cells as rows ``(actual, predicted, n)``."""
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                               F.col(c).alias("n"))
                      for a, p, c in ((1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn"))])
    return cm.select(*group, F.inline(cells))


# E2 -------------------------------------------------------------------------
def metric_columns(decimals: int = fixed.METRIC_DECIMALS) -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    r = lambda c: X.round_half_up(c, decimals)
    return {
        "accuracy": r(X.safe_ratio(tp + tn, tp + fp + fn + tn)),
        "precision": r(X.safe_ratio(tp, tp + fp)),
        "recall": r(X.safe_ratio(tp, tp + fn)),
        "f1_score": r(X.safe_ratio(2 * tp, 2 * tp + fp + fn)),
        # extra columns beside the faithful ones (class imbalance check)
        "specificity": r(X.safe_ratio(tn, tn + fp)),
        "balanced_accuracy": r((X.safe_ratio(tp, tp + fn) + X.safe_ratio(tn, tn + fp)) / 2.0),
    }


def metrics(cm: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero-division 0), 4 dp, from counts."""
    return cm.select(*group, "tp", "fp", "fn", "tn",
                     *[c.alias(n) for n, c in metric_columns().items()])


# E3 -------------------------------------------------------------------------
def _distinct_scores(preds: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, checkpointed.

    Rows with a NULL label or score take no part in E3 and E4, as they are in no cell of E1.
    """
    y = F.col(label)
    return cut_lineage(preds.where(y.isNotNull() & F.col(score).isNotNull())
                       .groupBy(*group, F.col(score).alias("score")).agg(
                           F.count_if(y == 1).cast("bigint").alias("pos"),
                           F.count_if(y == 0).cast("bigint").alias("neg")))


def roc_auc(preds: DataFrame, group: list[str] = GROUP, label: str = "label",
            score: str = "probability", decimals: int | None = fixed.METRIC_DECIMALS) -> DataFrame:
    """Exact ROC-AUC with tied scores counted one half.

    ``sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N)``; NULL when a class
    is absent.
    """
    d = cumulative_within(_distinct_scores(preds, group, label, score), group, "score", ["neg"])
    auc = d.groupBy(*group).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)),
                     (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))
    if decimals is not None:
        auc = auc.withColumn("roc_auc", X.round_half_up("roc_auc", decimals))
    return auc


# E4 -------------------------------------------------------------------------
def roc_curve(preds: DataFrame, group: list[str] = GROUP, label: str = "label",
              score: str = "probability", drop_intermediate: bool = True, decimals: int = 6) -> DataFrame:
    """ROC points ``(idx, fpr, tpr, threshold)`` from (0, 0), thresholds descending.

    ``drop_intermediate`` removes points collinear with both neighbours (zero
    second difference of fps and tps), as the usual library default does: a point stays
    where the next score adds other counts than its own, and at both ends.
    """
    d = cumulative_within(_distinct_scores(preds, group, label, score), group, "score", ["pos", "neg"],
                          descending=True)
    first = (F.col("pos_before") == 0) & (F.col("neg_before") == 0)
    pts = d.select(*group, "score", (F.col("pos_before") + F.col("pos")).alias("tps"),
                   (F.col("neg_before") + F.col("neg")).alias("fps"),
                   (first | F.col("pos_next").isNull() | (F.col("pos") != F.col("pos_next"))
                    | (F.col("neg") != F.col("neg_next"))).alias("corner"))
    totals = pts.groupBy(*group).agg(F.max("tps").alias("n_pos"), F.max("fps").alias("n_neg"))
    kept = pts.where("corner") if drop_intermediate else pts
    kept = cut_lineage(kept.select(*group, "score", "tps", "fps", F.lit(1).cast("bigint").alias("one")))
    placed = cumulative_within(kept, group, "score", ["one"], descending=True).join(totals, group)
    r = lambda c: X.round_half_up(c, decimals)
    body = placed.select(*group, (F.col("one_before") + 1).cast("long").alias("idx"),
                         r(X.safe_ratio("fps", "n_neg")).alias("fpr"),
                         r(X.safe_ratio("tps", "n_pos")).alias("tpr"),
                         F.col("score").alias("threshold"))
    origin = totals.select(*group, F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("fpr"),
                           F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return origin.unionByName(body)


# E5-E10 ---------------------------------------------------------------------
def comparison(preds: DataFrame, group: list[str] = GROUP, model_order: list[str] | None = None
               ) -> DataFrame:
    """All metrics per (split, model) (E5): E1 + E2 + E3 in one table."""
    table = metrics(confusion(preds, group), group).join(roc_auc(preds, group), group)
    if model_order:
        m = F.create_map(*[F.lit(x) for i, n in enumerate(model_order) for x in (n, i)])
        table = table.withColumn("model_ordinal", F.try_element_at(m, F.col("model")))
    return table


def cv_recall(fold_preds: DataFrame, decimals: int = fixed.METRIC_DECIMALS) -> DataFrame:
    """Per model: mean and population std of per-fold recall (M8 aggregation)."""
    cm = confusion(fold_preds, ["model", "fold"])
    rec = cm.select("model", "fold", X.safe_ratio("tp", F.col("tp") + F.col("fn")).alias("r"))
    return rec.groupBy("model").agg(
        X.round_half_up(F.avg("r"), decimals).alias("cv_recall_mean"),
        X.round_half_up(F.stddev_pop("r"), decimals).alias("cv_recall_std"))


def with_cv(comp: DataFrame, cv: DataFrame) -> DataFrame:
    """Left-join CV results on the model name (E6); ``cv`` has one row per model."""
    return comp.join(cv, "model", "left")


def best_model(comp: DataFrame, split: str = "validation", exclude: list[str] | None = None
               ) -> DataFrame:
    """Recall first, then F1, then model order, on rounded metrics."""
    c = comp.where(F.col("split") == split)
    if exclude:
        c = c.where(~F.col("model").isin(exclude))
    return c.orderBy(F.col("recall").desc(), F.col("f1_score").desc(),
                     F.col("model_ordinal").asc()).limit(1)


def flag_best(comp: DataFrame, metric_names: list[str] = METRICS) -> DataFrame:
    """``is_best_<metric>`` per split: the value equals the split's maximum."""
    w = Window.partitionBy("split")
    return comp.select("*", *[(F.col(m) == F.max(m).over(w)).alias(f"is_best_{m}")
                              for m in metric_names])


def comparison_long(comp: DataFrame, metric_names: list[str] = METRICS) -> DataFrame:
    """(split, model, metric, value) for grouped bars."""
    return comp.unpivot(["split", "model"], metric_names, "metric", "value")
