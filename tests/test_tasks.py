"""Fits over several blocks in tasks, shared draws, held-out rows from vectors, and scores by cells."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from renalytics.operators import boosting as B
from renalytics.operators import cells as C
from renalytics.operators import forest as FR
from renalytics.operators import models as MD
from renalytics.operators.model_registry import Registry

FEATS = ["a", "b", "c"]
KINDS = {"LightGBM": dict(min_rows=5, l1=0.1, l2=0.1, row_share=0.8, column_share=0.8, max_leaves=5), "CatBoost": dict(l2=3.0, symmetric=True)}


def refuse(*_a, **_k):
    raise AssertionError("not this way")


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(9)
    a, b, c = rng.normal(size=900), rng.integers(0, 9, 900), rng.integers(0, 2, 900)
    y = (a + 0.1 * b + rng.normal(size=900) > 0.6).astype(float)
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), float(y[i]), i % 3, (i // 3) % 2) for i in range(900)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double, fold int, inner_0 int").persist()


@pytest.fixture(scope="module")
def tables(train):
    thresholds = B.fit_bins(train, FEATS, 12)
    return thresholds, [B.blocks(train, FEATS, thresholds, "label", ["fold", "inner_0"], "row_id", n) for n in (900, 130)]


def fits(rounds=5):
    return [B.Fit(f"{k}{i}", exclude, rounds=rounds, depth=3, **v) for k, v in KINDS.items()
            for i, exclude in enumerate([(), ((0, 0),), ((0, 1),), ((0, 0), (1, 1))])]


def test_several_blocks_grow_in_tasks_and_give_the_trees_of_jobs(tables, monkeypatch):
    thresholds, (one, many) = tables
    assert one.count() == 1 and many.count() > 5

    def collected(table):
        rows = B.grow(table, fits(), thresholds).collect()
        trees = {(r["fit"], r["tree"]): [r[c] for c in ("feature", "bin", "gain", "cover", "value")] for r in rows if r["tree"] >= 0}
        return trees, {(r["fit"], i): m for r in rows if r["tree"] < 0 for i, m in zip(r["row_id"], r["margin"], strict=True)}

    with monkeypatch.context() as patch:
        patch.setattr(B, "_grow_in_jobs", refuse)  # a job per tree level of every tree
        alone, tasks = collected(one), collected(many)
        patch.setattr(B, "TASK_FITS", 1)
        assert collected(many) == tasks
    assert alone == tasks and len(alone[0]) == 8 * 5 and len(alone[1]) == 2 * (300 + 300 + 300)
    with monkeypatch.context() as patch:
        for name in ("TASK_ROWS", "ONE_BLOCK_ROWS"):
            patch.setattr(B, name, 500)
        patch.setattr(B, "_grow_in_tasks", refuse)
        assert not B.in_task(many) and collected(many) == tasks


def test_draws_are_those_of_the_shares():
    ids = np.concatenate([np.arange(70_000), np.arange(-500, 0)]).astype(np.int64)
    for share in (0.8, 0.5, 0.013, 1.0):
        assert (B.drawn_below(ids.astype(np.uint64), 42, 7, share) == (B._shares(ids, 42, 7) < share)).all()
        cut = B._cut(share)
        assert not cut or float(cut - 1) / 2.0**64 < share
        assert cut >= 1 << 64 or float(cut) / 2.0**64 >= share
    assert (FR.times_drawn(ids.astype(np.uint64), 42, 3) == np.searchsorted(FR.POISSON[:-1], B._shares(ids, 53, 3), side="right")).all()


@pytest.mark.parametrize("n_vectors", [40, 60_000])
def test_sums_by_vector_and_label(n_vectors):
    """Listed in full, and only where there are rows (many vectors and groups for few rows)."""
    rng = np.random.default_rng(2)
    n, codes = 3000, np.stack(np.unravel_index(np.arange(n_vectors), (32, 32, 64)), axis=1).astype(np.uint8)
    cell, group = np.sort(rng.integers(0, 2 * n_vectors, n)), np.append(rng.integers(0, 20, n - 1), 19)
    folds = np.stack(np.unravel_index(np.arange(20), (5, 4)), axis=1).astype(np.int8)
    rows = B.Rows({"n": n, "vectors": n_vectors, "codes": codes.tobytes(), "cell": cell.astype("<u4").tobytes(), "folds": folds.tobytes(),
                   "fold_group": group.astype("<u2").tobytes(), "row_id": np.arange(n).astype("<i8").tobytes()}, 3, 64)
    assert (rows._dealt[2] is None) == (n_vectors == 40)
    for exclude in ((), ((0, 2),), ((0, 2), (1, 3))):
        keep = rows.outside(exclude) & (B._shares(rows.row_id, 42, 5) < 0.8)
        fit = B.Fit("f", exclude, row_share=0.8)
        assert (rows.counts(fit, 5).ravel() == np.bincount(cell[keep], minlength=2 * n_vectors)).all()
        assert (rows.counts(B.Fit("f", exclude), 5).ravel() == np.bincount(cell[rows.outside(exclude)], minlength=2 * n_vectors)).all()
        times = FR.times_drawn(rows.row_id.astype(np.uint64), 42, 5) * rows.outside(exclude)
        assert (FR.drawn(rows, FR.Forest("f", exclude), 5).ravel() == np.bincount(cell, times, 2 * n_vectors)).all()


def test_forests_over_several_blocks(spark, train, tables, monkeypatch):
    thresholds, tables = tables
    model, folds = FR.Forest("m", trees=12, depth=5), [FR.Forest(f"f{f}", ((0, f),), trees=12, depth=5) for f in range(3)]
    monkeypatch.setattr(FR, "TASK_TREES", 2)
    nodes, held = [], []
    for table in tables:
        nodes.append(sorted((r["treeID"], r["nodeData"]["id"], repr(r["nodeData"])) for r in FR.nodes(table, model, thresholds).collect()))
        held.append(sorted(map(tuple, FR.held_out(table, folds, thresholds).collect())))
    assert nodes[0] == nodes[1] and held[0] == held[1] and len(held[0]) == 900
    monkeypatch.setattr(MD, "fit_pipeline", refuse)  # passes over all rows for every tree level
    monkeypatch.setattr(B, "ONE_BLOCK_ROWS", 400)
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    run = MD.Training(train, FEATS, Registry(spark, "blocks", root=tempfile.mkdtemp(prefix="renalytics-registry-")), n_trees=6)
    run.fold_columns = lambda: ["fold"]
    assert run.blocks().count() > 5 and run.model(MD.FOREST).stages[-1].getNumTrees == 6
    run.k = 3
    assert run.fold_predictions((MD.FOREST,)).select("row_id").distinct().count() == 900


def run_of(spark, train, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 120)
    monkeypatch.setattr(B, "ONE_BLOCK_ROWS", 400)
    return MD.Training(MD.with_folds(train.withColumn("patient_id", F.col("row_id")).withColumn("ckd_diagnosis", F.col("label")).drop("fold", "inner_0")),
                       FEATS, Registry(spark, "held", root=tempfile.mkdtemp(prefix="renalytics-registry-")), rounds=3, n_trees=4)


def test_held_out_rows_come_from_vectors(spark, train, monkeypatch):
    """The scores that fits give to single rows, though only the margins of vectors are written."""
    run = run_of(spark, train, monkeypatch)
    assert run.grown().where("tree = -1 AND row_id IS NOT NULL").isEmpty()
    for inner, wide in ((False, run.held_out()), (True, run.held_out_inner())):
        want = {(r["fit"], r["row_id"]): r["probability"] for r in B.held_out_scores(B.grow(run.blocks(), run.fits(inner), run.thresholds())).collect()}
        labels, got = {r["row_id"]: r for r in run.train.collect()}, {}
        for r in wide.collect():
            row = labels[r["row_id"]]
            assert r["label"] == row["label"] and (inner or r["fold"] == row["fold"])
            line = f"{r['outer']}-{row['inner_' + str(r['outer'])]}" if inner else f"{r['fold']}"
            got |= {(f"{n}-{line}", r["row_id"]): r[f"p_{t}"] for n, t in MD.TAGS.items()}
        assert got == want and len(got) == (3 * 900 * 4 if inner else 3 * 900)


def test_repeated_and_missing_ids_of_held_out_rows(spark, train, monkeypatch):
    """Rows that share an id share the greatest score, rows without one are left out of the boosted models' scores."""
    ids = train.withColumn("row_id", F.when(F.col("row_id") < 6, None).when(F.col("row_id") < 10, 7).otherwise(F.col("row_id")))
    held = run_of(spark, ids, monkeypatch).held_out().collect()
    assert len(held) == 894 and len({r["p_xgb"] for r in held if r["row_id"] == 7}) == 1
    assert len([r for r in held if r["row_id"] == 7]) == 4


def test_trees_score_one_row_of_each_cell(spark, train, monkeypatch):
    run = run_of(spark, train, monkeypatch)
    models = run.models()
    cuts = C.thresholds(models["Stacking"])
    edges = [math.inf, -math.inf, cuts[0][0], cuts[0][-1], math.nextafter(cuts[0][0], math.inf)]
    more = spark.createDataFrame([(float(e), float(b), 1.0, 1000 + 10 * i + b) for i, e in enumerate(edges) for b in range(3)], "a double, b double, c double, row_id long")
    rows = train.select("a", "b", "c", "row_id").unionByName(more)
    rows = rows.unionByName(rows.withColumn("row_id", F.col("row_id") + 5000))
    want = {}
    for name, m in models.items():
        want |= {(name, r["row_id"]): r["p"] for r in m.transform(rows).select("row_id", vector_to_array("probability")[1].alias("p")).collect()}
    transformed, plain = [], C._row_by_row
    monkeypatch.setattr(C, "_row_by_row", lambda df, m: (transformed.append(df), plain(df, m))[1])
    long = MD.predictions_long(models, rows, ["row_id"])
    assert {(r["model"], r["row_id"]): r["probability"] for r in long.collect()} == want
    single = MD.predict(models["XGBoost"], rows, ["row_id"])
    assert {("XGBoost", r["row_id"]): r["probability"] for r in single.collect()}.items() <= want.items()
    assert all("__cell0" in df.columns for df in transformed)
    assert transformed[1].count() < 950  # of 1830 rows
    with pytest.raises(Exception, match="(?i)null"):
        MD.predict(models["CatBoost"], rows.withColumn("a", F.when(F.col("row_id") != 3, F.col("a"))), ["row_id"]).collect()


def test_pipelines_that_use_features_otherwise_are_scored_row_by_row(spark, train):
    from pyspark.ml.classification import LogisticRegression
    linear = MD.plain(MD.fit_pipeline(train, FEATS, LogisticRegression(labelCol="label")))
    assert isinstance(linear, PipelineModel) and C.thresholds(linear) is None
    assert MD.predict(linear, train, ["row_id"]).count() == 900
