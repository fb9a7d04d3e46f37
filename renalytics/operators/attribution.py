"""Attribution tables (X3-X9) and linear scoring.

The attribution layout is long: ``(patient_id, feature, feature_ordinal,
feature_value, shap_value)`` — one row per patient and feature, produced by an
``inline`` of a fixed-size array (no join).  Every per-patient operator is a
window or aggregate partitioned by ``patient_id`` (at most one row per
feature in a group), and global ones are partial aggregates per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .features import fit_scaler

ID = "patient_id"


# M10 ------------------------------------------------------------------------
def linear_margin(weights: dict[str, float], intercept: float) -> Column:
    """``b + sum_i w_i x_i`` as column arithmetic (the model is a few literals)."""
    return X.add_all([F.lit(float(intercept))]
                     + [F.lit(float(w)) * F.col(c).cast("double") for c, w in weights.items()])


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def linear_scores(df: DataFrame, weights: dict[str, float], intercept: float,
                  keep: list[str] | None = None) -> DataFrame:
    """Margin and probability of a logistic model given by its coefficients."""
    m = linear_margin(weights, intercept)
    return df.select(*(keep or [ID]), m.alias("margin"), sigmoid(m).alias("probability"))


def coefficients_of(lr_model, feature_order: list[str]) -> tuple[dict[str, float], float]:
    """Coefficients of a fitted binary ``LogisticRegressionModel`` (small, fitted stats)."""
    w = lr_model.coefficients.toArray().tolist()
    return dict(zip(feature_order, w)), float(lr_model.intercept)


# X3 -------------------------------------------------------------------------
def background_means(background: DataFrame, feats: list[str]) -> dict[str, float]:
    """Fitted feature means of the background rows (one small job)."""
    row = fit_scaler(background, feats).first().asDict()
    return {c: row[f"{c}__mean"] for c in feats}


def _cells(values: dict[str, Column], shaps: dict[str, Column]) -> Column:
    """One struct per feature, in feature order: the attributions of a row as an array."""
    return F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("feature_ordinal"),
                              values[c].cast("double").alias("feature_value"),
                              shaps[c].cast("double").alias("shap_value"))
                     for i, c in enumerate(values)])


def linear_cells(df: DataFrame, weights: dict[str, float], background: DataFrame | None = None,
                 means: dict[str, float] | None = None) -> tuple[DataFrame, Column]:
    """``(id, cells)``: ``w_i (x_i - mean_i)`` of each feature as an array in the patient's row.

    ``background`` supplies the feature means (the training rows), fitted once;
    pass ``means`` to reuse an earlier fit.  Also returns the baseline
    ``sum_i w_i mean_i`` (add the intercept to get the expected margin).
    """
    feats = list(weights)
    if means is None:
        means = background_means(background, feats)
    mean = {c: F.lit(means[c]) for c in feats}
    shaps = {c: F.lit(float(weights[c])) * (F.col(c).cast("double") - mean[c]) for c in feats}
    baseline = X.add_all([F.lit(float(weights[c])) * mean[c] for c in feats])
    return df.select(ID, _cells({c: F.col(c) for c in feats}, shaps).alias("cells")), baseline


def linear_attribution(df: DataFrame, weights: dict[str, float], background: DataFrame | None = None,
                       means: dict[str, float] | None = None) -> tuple[DataFrame, Column]:
    """:func:`linear_cells` as a long table, one row per patient and feature."""
    rows, baseline = linear_cells(df, weights, background, means)
    return rows.select(ID, F.inline("cells")), baseline


def wide_to_cells(df: DataFrame, feats: list[str], shap_cols: list[str]) -> DataFrame:
    """Wide ``(id, x_i..., shap_i...)`` to ``(id, cells)``."""
    cells = _cells({c: F.col(c) for c in feats}, {c: F.col(s) for c, s in zip(feats, shap_cols)})
    return df.select(ID, cells.alias("cells"))


def wide_to_long(df: DataFrame, feats: list[str], shap_cols: list[str]) -> DataFrame:
    """Wide ``(id, x_i..., shap_i...)`` to the long attribution layout."""
    return wide_to_cells(df, feats, shap_cols).select(ID, F.inline("cells"))


# X4 / X6 --------------------------------------------------------------------
def _by_size(cells: Column | str, descending: bool) -> Column:
    """The row's cells by |attribution|, ties in feature order."""
    c = F.col(cells) if isinstance(cells, str) else cells
    size = (lambda s: -F.abs(s["shap_value"])) if descending else (lambda s: F.abs(s["shap_value"]))
    return F.array_sort(F.transform(c, lambda s: F.struct(
        size(s).alias("size"), s["feature_ordinal"].alias("ordinal"), s["feature"].alias("feature"),
        s["shap_value"].alias("shap_value"))))


def top_factors(rows: DataFrame, n: int = 3, decimals: int = 4) -> DataFrame:
    """Top-``n`` features per patient by |attribution| (ties: feature order).

    ``rows`` are ``(id, cells)``; the choice is made inside each row, without a shuffle.
    ``direction`` is "increases" for a positive value, else "decreases"; the
    description reads ``<feature> <direction> CKD risk (SHAP = +0.1234)``.
    """
    ranked = rows.select(ID, F.posexplode(F.slice(_by_size("cells", True), 1, n)).alias("pos", "cell")) \
                 .select(ID, (F.col("pos") + 1).alias("rank"), "cell.feature", "cell.shap_value")
    direction = F.when(F.col("shap_value") > 0, F.lit("increases")).otherwise(F.lit("decreases"))
    rounded = X.round_half_up("shap_value", decimals)
    # the text shows the rounded value so that every engine prints the same digits
    return ranked.select(
        ID, "rank", "feature", rounded.alias("shap_value"), direction.alias("direction"),
        F.format_string("%s %s CKD risk (SHAP = %+.4f)", F.col("feature"), direction,
                        rounded).alias("description"))


def factor_lists(rows: DataFrame, n: int = 5) -> DataFrame:
    """Display names of risk-increasing (>0) and decreasing (<0) factors in the top ``n``."""
    def names(keep) -> Column:
        top = F.filter(F.slice(_by_size("cells", True), 1, n), lambda s: keep(s["shap_value"]))
        return F.array_join(F.transform(top, lambda s: X.display_name_expr(s["feature"])), ", ")
    return rows.select(ID, names(lambda v: v > 0).alias("increasing"), names(lambda v: v < 0).alias("decreasing"))


# X5 -------------------------------------------------------------------------
def global_importance(long: DataFrame, decimals: int = 6) -> DataFrame:
    """Mean |attribution| per feature with its rank."""
    g = long.groupBy("feature", "feature_ordinal").agg(F.avg(F.abs("shap_value")).alias("m"))
    w = Window.orderBy(F.col("m").desc(), F.col("feature_ordinal").asc())
    return g.select("feature", X.display_name_expr("feature").alias("display_name"),
                    X.round_half_up("m", decimals).alias("mean_abs_shap"),
                    F.row_number().over(w).alias("importance_rank"))


# X7 -------------------------------------------------------------------------
def beeswarm(long: DataFrame, decimals: int = 6) -> DataFrame:
    """Feature value normalised to [0, 1] per feature, beside the attribution."""
    mm = long.groupBy("feature").agg(F.min("feature_value").alias("lo"),
                                     F.max("feature_value").alias("hi"))
    j = long.join(F.broadcast(mm), "feature")
    norm = F.when(F.col("hi") > F.col("lo"),
                  (F.col("feature_value") - F.col("lo")) / (F.col("hi") - F.col("lo"))) \
            .otherwise(F.lit(0.5))
    r = lambda c: X.round_half_up(c, decimals)
    return j.select(ID, "feature", r("feature_value").alias("feature_value"),
                    r(norm).alias("normalised_value"), r("shap_value").alias("shap_value"))


# X8 / X9 --------------------------------------------------------------------
def waterfall(rows: DataFrame, baseline: Column, decimals: int = 6) -> DataFrame:
    """Running total from the baseline, smallest |attribution| first (X8), inside each row."""
    ordered = rows.select(ID, _by_size("cells", False).alias("ordered"))

    def total(i):
        return F.aggregate(F.slice(F.col("ordered"), F.lit(1), i + 1), F.lit(0.0),
                           lambda acc, s: acc + s["shap_value"])

    steps = F.transform("ordered", lambda s, i: F.struct(
        (i + 1).alias("step"), s["feature"].alias("feature"), s["shap_value"].alias("shap_value"),
        (baseline + total(i)).alias("end")))
    r = lambda c: X.round_half_up(c, decimals)
    return ordered.select(ID, F.inline(steps)).select(
        ID, "step", "feature", r("shap_value").alias("shap_value"),
        r(F.col("end") - F.col("shap_value")).alias("start"), r("end").alias("end"))


def force_totals(rows: DataFrame, baseline: Column, decimals: int = 6) -> DataFrame:
    """Per patient: sum of positive and of negative attributions, and the output."""
    def total(pick) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda acc, s: acc + pick(s["shap_value"]))
    r = lambda c: X.round_half_up(c, decimals)
    return rows.select(
        ID,
        r(total(lambda v: F.greatest(v, F.lit(0.0)))).alias("positive_total"),
        r(total(lambda v: F.least(v, F.lit(0.0)))).alias("negative_total"),
        r(baseline + total(lambda v: v)).alias("output"))
