"""The forest over blocks: draws, splits, saved form, and likeness to Spark ML's own."""

import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from renalytics.operators import boosting as B
from renalytics.operators import forest as FR
from renalytics.operators import models as MD
from renalytics.operators.model_registry import Registry

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=1500), rng.integers(0, 40, 1500), rng.integers(0, 2, 1500)
    y = (a + 0.05 * b + rng.normal(size=1500) > 1.2).astype(float)
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), float(y[i]), i % 5) for i in range(1500)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double, fold int").persist()


@pytest.fixture(scope="module")
def packed(train):
    thresholds = B.fit_bins(train, FEATS)
    table = B.blocks(train, FEATS, thresholds, "label", ["fold"], "row_id")
    return table, thresholds, B.Rows(table.first().asDict(), 3, max(map(len, thresholds)) + 1)


def run_of(spark, train, name):
    run = MD.Training(train, FEATS, Registry(spark, name, root=tempfile.mkdtemp(prefix="renalytics-registry-")), n_trees=8)
    run.fold_columns = lambda: ["fold"]
    return run


def test_first_split_by_plain_counting(packed):
    _, thresholds, rows = packed
    fit = FR.Forest("x", ((0, 3),), trees=20, min_rows=5)
    counts = FR.drawn(rows, fit, 4)
    assert abs(counts.sum() / 1200 - 1) < 0.1  # Poisson(1) draws of four folds
    times = np.searchsorted(FR.POISSON[:-1], B._shares(rows.row_id, fit.seed + 11, 4), side="right") * rows.outside(fit.exclude)
    y, codes = rows.label, rows.codes[rows.cell >> 1]
    best = (0.0, None)
    for f in np.flatnonzero(FR.subsets(fit, 4, 0, 3)[0]):
        for b in range(len(thresholds[f])):
            sides = [times * (codes[:, f] <= b), times * (codes[:, f] > b)]
            if min(s.sum() for s in sides) >= 5:
                gini = [2 * (s @ y / s.sum()) * (1 - s @ y / s.sum()) * s.sum() for s in (times, *sides)]
                gain = (gini[0] - gini[1] - gini[2]) / times.sum()
                best = max(best, (gain, (f, b)), key=lambda g: g[0])
    tree, leaf = FR.grow_tree(rows, fit, 4)
    assert (tree.feature[1], tree.bin[1]) == best[1] and tree.gain[1] == pytest.approx(best[0], rel=1e-9)
    assert FR.subsets(fit, 4, 3, 3).sum(axis=1).tolist() == [2] * 8
    ends = np.unique(leaf)
    assert (tree.feature[ends] < 0).all() and (tree.sums[ends, 2] >= 5).all()
    for n in ends:  # a leaf holds what was drawn into it
        here = leaf[rows.cell >> 1] == n
        assert tree.sums[n, ::2].tolist() == [(times * y)[here].sum(), times[here].sum()]
    inner = np.flatnonzero(tree.feature >= 0)
    both = [n for n in inner if tree.feature[2 * n] < 0 and tree.feature[2 * n + 1] < 0]
    assert all((tree.value[2 * n] > 0.5) != (tree.value[2 * n + 1] > 0.5) for n in both) and both


def test_held_out_scores_are_those_of_the_saved_model(spark, train, packed):
    table, thresholds, _ = packed
    fit = FR.Forest("f", ((0, 2),), trees=30)  # two tasks
    model = FR.as_spark_model(FR.nodes(table, fit, thresholds), fit, 3)
    rows = MD.PipelineModel(stages=[MD.assembler(FEATS), model]).transform(train.where("fold = 2"))
    want = {r["row_id"]: r["p"] for r in rows.select("row_id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r["row_id"]: (r["label"], r["probability"]) for r in FR.held_out(table, [fit], thresholds).collect()}
    labels = {r["row_id"]: r["label"] for r in train.collect()}
    assert got.keys() == want.keys() and len(want) == 300
    assert all(p == pytest.approx(want[i], abs=1e-12) and y == labels[i] for i, (y, p) in got.items())
    assert model.getNumTrees == 30 and float(sum(model.featureImportances)) == pytest.approx(1)


def test_as_good_as_the_forest_of_the_library(spark, train, packed):
    table, thresholds, _ = packed
    fit = FR.Forest("f", ((0, 1),), trees=60)
    ours = FR.held_out(table, [fit], thresholds).select("row_id", F.col("probability").alias("ours"))
    other = MD.fit_pipeline(train.where("fold <> 1"), FEATS, MD.forest(60)).transform(train.where("fold = 1"))
    both = other.select("row_id", "label", vector_to_array("probability")[1].alias("theirs")).join(ours, "row_id").toPandas()
    assert len(both) == 300 and np.corrcoef(both["ours"], both["theirs"])[0, 1] > 0.97
    losses = [((both[c] - both["label"]) ** 2).mean() for c in ("ours", "theirs")]
    assert losses[0] < losses[1] * 1.05


def test_training_takes_blocks_and_leaves_large_tables_to_the_library(spark, train, monkeypatch):
    def refuse(*_a, **_k):
        raise AssertionError("a pass over all rows for every tree level")
    with monkeypatch.context() as patch:
        patch.setattr(MD, "fit_pipeline", refuse)
        run = run_of(spark, train, "blocks")
        assert run.model(MD.FOREST).stages[-1].getNumTrees == 8
        held = run.fold_predictions((MD.FOREST,))
        assert held.count() == held.select("row_id").distinct().count() == 1500
        assert held.join(train, ["row_id", "fold", "label"]).count() == 1500
    with monkeypatch.context() as patch:
        patch.setattr(B, "ONE_BLOCK_ROWS", 1000)
        patch.setattr(B, "BLOCK_ROWS", 400)
        large = run_of(spark, train, "large")
        assert large.blocks().count() > 1
        assert large.model(MD.FOREST).stages[-1].getNumTrees == 8 and large.fold_predictions((MD.FOREST,)).count() == 1500


def test_gaps_are_refused_and_repeated_or_missing_ids_stay(spark, train):
    ids = train.withColumn("row_id", F.when(F.col("row_id") < 10, None).when(F.col("row_id") < 20, 7).otherwise(F.col("row_id")))
    held = run_of(spark, ids, "ids").fold_predictions((MD.FOREST,))
    assert held.count() == 1500 and held.where("row_id IS NULL").count() == 10 and held.where("row_id = 7").count() == 10
    gap = train.withColumn("a", F.when(F.col("row_id") != 4, F.col("a")))
    with pytest.raises(ValueError, match="1 training rows"):
        run_of(spark, gap, "gap").model(MD.FOREST)
