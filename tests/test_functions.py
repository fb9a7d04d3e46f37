"""Literal fixtures for column expressions and small operators (FIXTURES section 5)."""

import pytest

from renalytics.functions import exprs as X
from renalytics.operators import evaluate as EV
from renalytics.operators import features as FE
from renalytics.operators import profile as P
from renalytics.functions.spec import COHORT_SPEC


def col_values(df, c):
    return [r[c] for r in df.collect()]


def test_stage_literals(spark):
    vals = [90.0, 89.99, 60.0, 45.0, 30.0, 15.0, 14.99, 0.0, -1.0, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, e double")
    out = df.select("i", X.egfr_stage(X.nan_to_null("e")).alias("s")).orderBy("i")
    assert col_values(out, "s") == ["Stage 1", "Stage 2", "Stage 2", "Stage 3a", "Stage 3b",
                                    "Stage 4", "Stage 5", "Stage 5", "Stage 5", "Stage 5", "Stage 5"]
    strict = df.select("i", X.egfr_stage(X.nan_to_null("e"), strict=True).alias("s")).orderBy("i")
    assert col_values(strict, "s")[-2:] == [None, None]


def test_stage_description_and_colour(spark):
    df = spark.createDataFrame([("Stage 3b",), ("Stage 9",)], "s string")
    out = df.select(X.stage_description("s").alias("d"), X.stage_colour("s").alias("c")).collect()
    assert out[0]["d"] == "Moderate-Severe Decrease" and out[1]["d"] == "Unknown"
    assert out[1]["c"] == "#95a5a6"


def test_bands_right_and_left_closed(spark):
    right = [0.0, 0.3, 0.30001, 0.7, 0.70001, 1.0, 1.02, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(right)], "i int, p double")
    out = df.select("i", X.risk_band("p", "right").alias("b")).orderBy("i")
    assert col_values(out, "b") == ["Low", "Low", "Medium", "Medium", "High", "High", None, None]
    left = [0.29999, 0.3, 0.69999, 0.7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(left)], "i int, p double")
    out = df.select("i", X.risk_band("p", "left").alias("b")).orderBy("i")
    assert col_values(out, "b") == ["Low", "Medium", "Medium", "High"]


def test_egfr_spot_checks(spark):
    rows = [(0.8, 45, "Male"), (1.5, 55, "Male"), (0.6, 40, "Female"), (1.2, 65, "Female"),
            (4.0, 70, "Male")]
    df = spark.createDataFrame(rows, "scr double, age int, g string")
    e = X.egfr_ckd_epi("scr", "age", X.is_female("g"))
    out = df.select(e.alias("e"), X.egfr_stage(e).alias("s")).collect()
    assert [r["e"] for r in out] == [111.22, 54.64, 114.92, 49.64, 15.34]
    assert [r["s"] for r in out] == ["Stage 1", "Stage 3a", "Stage 1", "Stage 3a", "Stage 4"]


def test_egfr_non_positive_creatinine_is_null(spark):
    df = spark.createDataFrame([(0.0, 40, "Male")], "scr double, age int, g string")
    assert df.select(X.egfr_ckd_epi("scr", "age", X.is_female("g")).alias("e")).first()["e"] is None


def test_median_fill_interpolates(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0), (5, None)], "id int, x double")
    out = FE.fill_median(df, ["x"]).where("id = 5").first()["x"]
    assert out == 2.5


def test_encoding_and_audit(spark):
    df = spark.createDataFrame([(1, "Yes"), (2, "yes"), (3, "No"), (4, None), (5, "1")],
                               "patient_id int, diabetes string")
    spec = COHORT_SPEC.with_(yes_no=("diabetes",))
    enc = FE.encode_features(df, spec).orderBy("patient_id")
    assert col_values(enc, "diabetes") == [1, 0, 0, 0, 0]
    audit = {r["column"]: r["n_unmapped"] for r in FE.unmapped_audit(df, spec).collect()}
    assert audit == {"diabetes": 3}


def test_scaler_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "a double, b double")
    st = FE.fit_scaler(df, ["a", "b"]).first()
    assert st["a__scale"] == pytest.approx(3.5355339059327378, abs=1e-12)
    assert st["b__scale"] == 1.0


def test_age_groups_zero_filled(spark):
    df = spark.createDataFrame([(a, 1) for a in (0, 30, 31, 40, 120, 121)], "age int, ckd_diagnosis int")
    out = P.age_group_by_class(df).collect()
    assert len(out) == 6  # 6 bins x 1 observed class
    got = {r["age_group"]: r["n"] for r in out}
    assert got == {"<30": 1, "30-39": 2, "40-49": 0, "50-59": 0, "60-69": 0, "70+": 1}


def test_correlation_constant_and_null_pair(spark):
    df = spark.createDataFrame([(1.0, 1.0, 7.0), (2.0, None, 7.0), (3.0, 5.0, 7.0), (4.0, 4.0, 7.0)],
                               "a double, b double, c double")
    out = {(r["x"], r["y"]): r["r"] for r in P.correlation_long(df, ["a", "b", "c"], decimals=12).collect()}
    assert out[("a", "c")] is None
    assert out[("a", "b")] == pytest.approx(0.8386278693775346, abs=1e-12)
    assert out[("a", "a")] == 1.0 and out[("c", "c")] is None


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([("v", "m", 1, 0), ("v", "m", 0, 0)], "split string, model string, label int, prediction int")
    m = EV.metrics(EV.confusion(df)).first()
    assert m["precision"] == 0.0 and m["f1_score"] == 0.0 and m["recall"] == 0.0


def test_auc_all_tied_is_half(spark):
    df = spark.createDataFrame([("v", "m", i % 2, 0.4) for i in range(10)],
                               "split string, model string, label int, probability double")
    assert EV.roc_auc(df).first()["roc_auc"] == 0.5


def test_display_names():
    assert [X.display_name(c) for c in ("egfr", "living_area", "new_col")] == ["eGFR", "Living Area", "New Col"]


def test_round_half_up_matches_sql_twin(spark):
    df = spark.createDataFrame([(1.005,), (-2.5,), (2.675,)], "x double")
    out = df.select(X.round_half_up("x", 0).alias("r")).collect()
    assert [r["r"] for r in out] == [1.0, -3.0, 3.0]


def test_histogram_last_bin_is_closed_and_edges_labelled(spark):
    from renalytics.operators import risk as RK
    df = spark.createDataFrame([(i, p, 1) for i, p in enumerate([0.0, 0.25, 0.3, 0.5, 0.7, 1.0])],
                               "patient_id long, ckd_probability double, actual_label int")
    h = sorted(RK.probability_histogram(df, n_bins=10).collect(), key=lambda r: r["bin"])
    assert len(h) == 10 and sum(r["n"] for r in h) == 6
    assert h[-1]["n"] == 1  # the maximum lands in the last bin, not in an 11th
    # edges are lo + b * width in floating point (3 * 0.1 > 0.3), as in the SQL twin
    def bin_of(v):
        return next(b for b in range(10) if b * 0.1 <= v < (b + 1) * 0.1)
    low, high = bin_of(0.3), bin_of(0.7)
    assert h[low]["boundaries"] == "Low/Medium" and h[high]["boundaries"] == "Medium/High"
    assert all(r["boundaries"] == "" for r in h if r["bin"] not in (low, high))


def test_gauge_zones(spark):
    from renalytics.operators import risk as RK
    df = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.69999), (4, 1.0)], "patient_id long, probability double")
    g = {r["patient_id"]: r for r in RK.gauge(df).collect()}
    assert [g[i]["gauge_zone"] for i in (1, 2, 3, 4)] == ["0-30", "30-70", "30-70", "70-100"]
    assert [g[i]["risk_category"] for i in (1, 2, 3, 4)] == ["Low", "Medium", "Medium", "High"]
    assert g[4]["gauge_value"] == 100.0 and g[4]["bar_colour"] == "#e74c3c"
