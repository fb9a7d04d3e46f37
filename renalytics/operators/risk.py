"""Risk scoring operators (K1-K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from .spine import value_range, int_spine, literal_spine


def risk_table(scored: DataFrame, id_col: str = "patient_id", prob: str = "probability",
               label: str = "label", closed: str = "right") -> DataFrame:
    """``patient_id, ckd_probability (4 dp), risk_category, actual_label`` (K1-K3).

    The band is taken from the unrounded probability, then it is rounded.
    """
    return scored.select(
        F.col(id_col).alias("patient_id"),
        X.round_half_up(prob, fixed.METRIC_DECIMALS).alias("ckd_probability"),
        X.risk_band(prob, closed).alias("risk_category"),
        F.col(label).cast("int").alias("actual_label"))


def with_colours(risk: DataFrame, band_col: str = "risk_category") -> DataFrame:
    """Band colour, default grey for unknown bands (K6)."""
    return risk.withColumn("colour", X.band_colour(band_col))


def band_distribution(risk: DataFrame, band_col: str = "risk_category",
                      decimals: int = 6) -> DataFrame:
    """Low / Medium / High counts and shares, fixed order, zero-filled (K4).

    Rows with no band (probability outside the edges) are not counted.
    """
    counts = (risk.where(F.col(band_col).isNotNull())
              .groupBy(F.col(band_col).alias("risk_category"))
              .agg(F.count(F.lit(1)).alias("n")))
    spine = literal_spine(risk.sparkSession, list(enumerate(fixed.BAND_ORDER, start=1)),
                          "band_ordinal INT, risk_category STRING")
    out = spine.join(F.broadcast(counts), "risk_category", "left").select(
        "band_ordinal", "risk_category", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        X.band_colour("risk_category").alias("colour"))
    total = F.sum("n").over(Window.partitionBy())
    return out.withColumn("share", X.round_half_up(X.safe_ratio("n", total), decimals))


def probability_histogram(risk: DataFrame, n_bins: int = 20, prob: str = "ckd_probability",
                          decimals: int = 6) -> DataFrame:
    """Equal-width histogram of probabilities with band-edge labels per bin (K5)."""
    vals = risk.select(F.col(prob).alias("x")).where(F.col("x").isNotNull())
    lo, hi = value_range(vals, "x")
    counts = (vals.select(X.hist_bin("x", lo, hi, n_bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    width = (hi - lo) / F.lit(float(n_bins))
    lo_e, hi_e = lo + F.col("bin") * width, lo + (F.col("bin") + 1) * width
    edges = [(fixed.BAND_LOW_MAX, "Low/Medium"), (fixed.BAND_MEDIUM_MAX, "Medium/High")]
    labels = [F.when((F.lit(v) >= lo_e) & (F.lit(v) < hi_e), F.lit(n)) for v, n in edges]
    return (int_spine(risk.sparkSession, n_bins, "bin").join(F.broadcast(counts), "bin", "left")
            .select("bin", X.round_half_up(lo_e, decimals).alias("bin_lo"),
                    X.round_half_up(hi_e, decimals).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                    F.concat_ws(";", *labels).alias("boundaries")))


def band_by_label(risk: DataFrame, band_col: str = "risk_category",
                  label: str = "actual_label") -> DataFrame:
    """Band x actual label cross-tab, zero-filled (K7)."""
    counts = (risk.where(F.col(band_col).isNotNull())
              .groupBy(F.col(band_col).alias("risk_category"))
              .agg(F.count_if(F.col(label) == 0).cast("bigint").alias("label_0"),
                   F.count_if(F.col(label) == 1).cast("bigint").alias("label_1")))
    spine = literal_spine(risk.sparkSession, list(enumerate(fixed.BAND_ORDER, start=1)),
                          "band_ordinal INT, risk_category STRING")
    return spine.join(F.broadcast(counts), "risk_category", "left").select(
        "band_ordinal", "risk_category",
        F.coalesce("label_0", F.lit(0)).cast("bigint").alias("label_0"),
        F.coalesce("label_1", F.lit(0)).cast("bigint").alias("label_1"))


def gauge(scored: DataFrame, prob: str = "probability") -> DataFrame:
    """Probability x 100 with its gauge zone and bar colour."""
    pct = F.col(prob) * 100.0
    zone = None
    for lo, hi, colour in fixed.GAUGE_ZONES:
        cond = (pct >= lo) & (pct <= hi) if hi == 100.0 else (pct >= lo) & (pct < hi)
        zone = (F.when(cond, F.lit(f"{lo:g}-{hi:g}")) if zone is None
                else zone.when(cond, F.lit(f"{lo:g}-{hi:g}")))
    zone_colour = None
    for lo, hi, colour in fixed.GAUGE_ZONES:
        cond = (pct >= lo) & (pct <= hi) if hi == 100.0 else (pct >= lo) & (pct < hi)
        zone_colour = (F.when(cond, F.lit(colour)) if zone_colour is None
                       else zone_colour.when(cond, F.lit(colour)))
    band = X.risk_band(prob, "left")
    return scored.select("patient_id", X.round_half_up(pct, 2).alias("gauge_value"),
                         zone.alias("gauge_zone"), zone_colour.alias("zone_colour"),
                         band.alias("risk_category"), X.band_colour(band).alias("bar_colour"))
