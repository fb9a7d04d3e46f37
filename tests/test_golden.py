"""Published numbers of the original pipeline reproduced from their confusion matrices."""

import pytest

from renalytics.operators import evaluate as EV

# FIXED VALUES — (split, model, TP, FP, FN, TN, accuracy, precision, recall, F1) as published
PUBLISHED = [
    ("validation", "LightGBM", 367, 18, 43, 4, 0.8588, 0.9532, 0.8951, 0.9233),
    ("validation", "CatBoost", 366, 19, 44, 3, 0.8542, 0.9506, 0.8927, 0.9208),
    ("validation", "XGBoost", 355, 16, 55, 6, 0.8356, 0.9569, 0.8659, 0.9091),
    ("validation", "RandomForest", 355, 17, 55, 5, 0.8333, 0.9543, 0.8659, 0.9079),
    ("validation", "Stacking", 372, 21, 38, 1, 0.8634, 0.9466, 0.9073, 0.9265),
    ("test", "LightGBM", 192, 8, 13, 3, 0.9028, 0.9600, 0.9366, 0.9481),
    ("test", "CatBoost", 195, 9, 10, 2, 0.9120, 0.9559, 0.9512, 0.9535),
    ("test", "XGBoost", 191, 8, 14, 3, 0.8981, 0.9598, 0.9317, 0.9455),
    ("test", "RandomForest", 186, 7, 19, 4, 0.8796, 0.9637, 0.9073, 0.9347),
    ("test", "Stacking", 199, 9, 6, 2, 0.9306, 0.9567, 0.9707, 0.9637),
]
ORDER = ["LightGBM", "CatBoost", "XGBoost", "RandomForest", "Stacking"]


@pytest.fixture(scope="module")
def preds(spark):
    rows = []
    for split, model, tp, fp, fn, tn, *_ in PUBLISHED:
        cells = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn
        rows += [(split, model, y, p) for y, p in cells]
    return spark.createDataFrame(rows, "split string, model string, label int, prediction int")


def test_published_metrics(preds):
    got = {(r["split"], r["model"]): r for r in EV.metrics(EV.confusion(preds)).collect()}
    for split, model, tp, fp, fn, tn, acc, prec, rec, f1 in PUBLISHED:
        r = got[(split, model)]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, tn)
        assert (r["accuracy"], r["precision"], r["recall"], r["f1_score"]) == (acc, prec, rec, f1)


def test_best_model_and_fallback(preds, spark):
    from pyspark.sql import functions as F
    comp = EV.metrics(EV.confusion(preds)).withColumn("roc_auc", F.lit(None).cast("double"))
    m = F.create_map(*[F.lit(x) for i, n in enumerate(ORDER) for x in (n, i)])
    comp = comp.withColumn("model_ordinal", F.try_element_at(m, F.col("model")))
    assert EV.best_model(comp).first()["model"] == "Stacking"
    fb = EV.best_model(comp, exclude=["Stacking"]).first()
    assert fb["model"] == "LightGBM" and fb["recall"] == 0.8951


def test_risk_band_counts_of_published_scores(spark):
    # 432 validation rows: High 376 (359 positive), Medium 36 (31), Low 20 (20)
    from renalytics.operators import risk as RK
    rows = ([(i, 0.9, 1) for i in range(359)] + [(1000 + i, 0.9, 0) for i in range(17)]
            + [(2000 + i, 0.5, 1) for i in range(31)] + [(3000 + i, 0.5, 0) for i in range(5)]
            + [(4000 + i, 0.1, 1) for i in range(20)])
    df = spark.createDataFrame(rows, "patient_id long, probability double, label int")
    risk = RK.risk_table(df)
    dist = {r["risk_category"]: r["n"] for r in RK.band_distribution(risk).collect()}
    assert dist == {"Low": 20, "Medium": 36, "High": 376}
    xt = {r["risk_category"]: (r["label_0"], r["label_1"]) for r in RK.band_by_label(risk).collect()}
    assert xt == {"Low": (0, 20), "Medium": (5, 31), "High": (17, 359)}
