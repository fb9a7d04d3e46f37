"""Training runs (small settings for speed), registry, persistence, stacking folds, attribution."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from renalytics.functions import fixed
from renalytics.operators import models as MD
from renalytics.operators import tree_shap as TS
from renalytics.operators.model_registry import Registry
from renalytics.plans.base import FEATURES
from renalytics.plans.fixture_models import scaled_split

from .conftest import SMALL_SF


@pytest.fixture(scope="module")
def train(spark):
    t = (scaled_split(spark, SMALL_SF).where(F.col("split") == "train").where("ckd_diagnosis IS NOT NULL")
         .select("patient_id", F.col("patient_id").alias("row_id"), *FEATURES, F.col("ckd_diagnosis").cast("double").alias("label"),
                 "ckd_diagnosis"))
    return MD.with_folds(t).persist()


@pytest.fixture(scope="module")
def root():
    return tempfile.mkdtemp(prefix="renalytics-registry-")


def run_of(spark, train, root, **kw):
    return MD.Training(train, FEATURES, Registry(spark, "test", root=root), rounds=4, n_trees=5, **kw)


def test_folds_inside_folds_are_stratified(train):
    rows = train.select("fold", "label", *[f"inner_{f}" for f in range(5)]).collect()
    for f in range(5):
        assert all((r[f"inner_{f}"] == -1) == (r["fold"] == f) for r in rows)
        for c in (0.0, 1.0):
            sizes = [sum(1 for r in rows if r[f"inner_{f}"] == j and r["label"] == c) for j in range(5)]
            assert max(sizes) - min(sizes) <= 1


def test_train_predict_save_load(spark, train, root):
    run = run_of(spark, train, root)
    models = run.models()
    assert list(models) == ["LightGBM", "CatBoost", "XGBoost", "RandomForest", "Stacking"]
    preds = MD.predictions_long(models, train, ["patient_id", "label"])
    assert preds.count() == 5 * train.count()
    assert preds.where((F.col("probability") < 0) | (F.col("probability") > 1)).count() == 0
    base = tempfile.mkdtemp(prefix="renalytics-models-")
    MD.save_models(models, base)
    loaded = MD.load_models(spark, base)
    assert set(loaded) == set(models)
    for name in models:
        a, b = (MD.predict(m[name], train, ["patient_id"]).orderBy("patient_id").collect() for m in (models, loaded))
        assert a == b
    with pytest.warns(UserWarning):
        assert MD.load_models(spark, tempfile.mkdtemp()) == {}
    imp = MD.feature_importance(spark, models["RandomForest"]).collect()
    assert len(imp) == len(FEATURES) and abs(sum(r["importance"] for r in imp) - 1) < 1e-5


def test_registry_resumes_with_what_was_recorded(spark, train, root, monkeypatch):
    first = run_of(spark, train, root)
    want = [r["probability"] for r in MD.predict(first.model("Stacking"), train, ["row_id"]).orderBy("row_id").collect()]
    again = run_of(spark, train, root)

    def refuse(*_a, **_k):
        raise AssertionError("fitted again")
    monkeypatch.setattr(MD.B, "grow", refuse)
    monkeypatch.setattr(MD, "fit_pipeline", refuse)
    got = [r["probability"] for r in MD.predict(again.models()["Stacking"], train, ["row_id"]).orderBy("row_id").collect()]
    assert got == want
    other = MD.Training(train, FEATURES, Registry(spark, "other parameters", root=root), rounds=4, n_trees=5)
    assert other.registry.manifest().count() == 0
    with pytest.raises(AssertionError):
        other.model("XGBoost")


def test_registry_makes_a_table_again_whose_folder_is_gone(spark, root):
    registry = Registry(spark, "folders", root=root)
    assert registry.table("numbers", lambda: spark.range(3)).count() == 3
    assert registry.table("numbers", lambda: spark.range(9)).count() == 3
    old = registry.path_of("numbers")
    path = spark._jvm.org.apache.hadoop.fs.Path(old)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    assert registry.table("numbers", lambda: spark.range(9)).count() == 9 and registry.path_of("numbers") != old


def test_out_of_fold_scores_are_those_of_refitted_models(spark, train, root):
    """A fold fit equals a whole-table fit on the other folds, and the meta model of a fold sees no row of it."""
    run = run_of(spark, train, root)
    preds = run.fold_predictions()
    counts = {r["model"]: (r["n"], r["ids"]) for r in preds.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids")).collect()}
    n = train.count()
    assert counts == {m: (n, n) for m in fixed.MODEL_ORDER}
    part = train.where("fold <> 2")
    thresholds = run.thresholds()
    fit = next(f for f in run.fits() if f.name == "XGBoost")
    table = MD.B.blocks(part, FEATURES, thresholds, "label", ["fold"], "row_id")
    trees = MD.B.grow(table, [fit], thresholds).where("tree >= 0").collect()
    model = MD.B.as_spark_model(spark, trees, thresholds, fit)
    scored = MD.predict(MD.PipelineModel(stages=[MD.assembler(FEATURES), model]), train.where("fold = 2"), ["row_id"]).collect()
    held = {r["row_id"]: r["probability"] for r in preds.where("model = 'XGBoost' AND fold = 2").collect()}
    assert held.keys() == {r["row_id"] for r in scored}
    assert all(r["probability"] == pytest.approx(held[r["row_id"]], abs=1e-12) for r in scored)
    inner = run.held_out_inner()
    for f in range(5):
        ids = {r["row_id"] for r in inner.where(F.col("outer") == f).collect()}
        assert ids == {r["row_id"] for r in train.where(F.col("fold") != f).collect()}


def brute_shap(x, leaves, n):
    """Shapley values by the definition, over all coalitions of features."""
    from itertools import combinations
    phi = [0.0] * n
    for _, v, path, _ in leaves:
        o = [float(lo < xi <= hi) for xi, (lo, hi, _) in zip(x, path, strict=True)]
        z = [p[2] for p in path]
        for i in range(n):
            others = [j for j in range(n) if j != i]
            for k in range(n):
                w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                for s in combinations(others, k):
                    phi[i] += w * v * (o[i] - z[i]) * math.prod(o[j] if j in s else z[j] for j in others)
    return phi


@pytest.mark.parametrize("name", ["XGBoost", "CatBoost", "RandomForest"])
def test_tree_attributions(spark, train, root, name):
    model = run_of(spark, train, root).model(name)
    wide, base = TS.tree_attributions(train.unionByName(train.limit(3)), model)
    assert wide.count() == train.count() + 3
    out = model.transform(train).select("patient_id", vector_to_array("rawPrediction")[1].alias("margin"),
                                        vector_to_array("probability")[1].alias("p"))
    j = wide.join(out, "patient_id").toPandas()
    target = j["p"] if name == "RandomForest" else j["margin"]
    total = j[[f"shap__{c}" for c in FEATURES]].sum(axis=1) + base
    assert float(np.abs(total - target).max()) < 1e-9
    assert TS.expected_value(spark, model).first()["expected_value"] == pytest.approx(base, abs=1e-12)
    if name == "XGBoost":
        leaves = TS.leaf_rows(spark, model.stages[-1], len(FEATURES))
        for r in j.head(3).to_dict("records"):
            want = brute_shap([r[c] for c in FEATURES], leaves, len(FEATURES))
            assert [r[f"shap__{c}"] for c in FEATURES] == pytest.approx(want, abs=1e-10)


def test_tree_attributions_by_cells(spark, train, root):
    """Rows between the same thresholds are attributed once, missing values lie in no interval, and one batch may hold many patterns."""
    model = run_of(spark, train, root).model("XGBoost")
    leaves = TS.leaf_rows(spark, model.stages[-1], len(FEATURES))
    cuts = {f: sorted({x for _, _, path, _ in leaves for x in path[f][:2] if math.isfinite(x)}) for f in range(len(FEATURES))}
    f = max(cuts, key=lambda f: len(cuts[f]))
    row = train.select("patient_id", *[F.col(c).cast("double").alias(c) for c in FEATURES]).limit(1)
    edges = [cuts[f][0], cuts[f][0] - 1.0, cuts[f][0] - 2.0, cuts[f][-1] + 1.0, math.inf, -math.inf, math.nan, None]
    many = row.crossJoin(spark.createDataFrame([(i, x) for i, x in enumerate(edges)], "i int, edge double")).select(
        F.col("i").alias("patient_id"), *[(F.col("edge") if c == FEATURES[f] else F.col(c)).alias(c) for c in FEATURES])
    wide, _ = TS.tree_attributions(many, model)
    got = {r["patient_id"]: r for r in wide.collect()}
    assert len(got) == len(edges)
    for i, r in got.items():
        x = [r[c] for c in FEATURES]
        assert r[FEATURES[f]] == edges[i] or edges[i] is None or math.isnan(edges[i])
        x[f] = math.nan if edges[i] is None else edges[i]
        assert [r[f"shap__{c}"] for c in FEATURES] == pytest.approx(brute_shap(x, leaves, len(FEATURES)), abs=1e-10)
    assert [got[1][f"shap__{c}"] for c in FEATURES] == [got[2][f"shap__{c}"] for c in FEATURES]  # one cell
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan  # no pair of row and tree


def test_oversampling_inside_folds(spark, train, root):
    """Synthetic rows are held out nowhere, and a fold's fit equals one on just the rows it may see."""
    real = train.select("row_id", *FEATURES, "label", "fold")
    syn = real.where("label = 1").limit(60).select((F.col("fold") + 1).alias("near"), F.col("row_id").alias("synthetic_id"), *FEATURES, "label")
    syn = syn.select(F.expr("cast(near % 5 as int)").alias("for_fold"), "synthetic_id", *FEATURES, "label")
    table = MD.in_fold_table(real, syn, FEATURES).persist()
    assert table.select("row_id").distinct().count() == table.count()
    run = MD.InFoldTraining(table, FEATURES, Registry(spark, "in-fold", root=root), rounds=4, n_trees=5)
    held = run.fold_predictions()
    n = real.count()
    assert {(r["model"], r["n"], r["ids"]) for r in held.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids")).collect()} == {(m, n, n) for m in (*MD.BOOSTED, MD.FOREST)}
    assert held.where("row_id < 0").count() == 0
    # fold 2 alone: its own table with only the rows that its fit may see
    alone = table.where("skip_2 = 0").withColumn("fold", F.when(F.col("fold") == 2, 2).otherwise(-1))
    only = MD.InFoldTraining(alone, FEATURES, Registry(spark, "alone", root=root), rounds=4, n_trees=5)
    only.thresholds = run.thresholds  # the bins are those of the whole table
    a = {r["row_id"]: r["p_xgb"] for r in run.held_out().where("fold = 2").collect()}
    b = {r["row_id"]: r["p_xgb"] for r in only.held_out().where("fold = 2").collect()}
    assert a == b and a
    with pytest.raises(ValueError):
        run.fold_predictions((fixed.ENSEMBLE_NAME,))


def test_forest_keeps_node_ids_and_stays_the_same(train):
    """Remembered node ids save walking every tree in every pass; the trees do not change."""
    walk, kept = (MD.fit_pipeline(train, FEATURES, f).stages[1] for f in (MD.forest(4).setCacheNodeIds(False), MD.forest(4)))
    assert kept.getCacheNodeIds() and not walk.getCacheNodeIds()
    assert kept.toDebugString.split("\n", 1)[1] == walk.toDebugString.split("\n", 1)[1]
