"""Shared-histogram boosting: equal trees from one block and from many, plain re-computation, Spark ML form."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from renalytics.operators import boosting as B

FEATS = ["a", "b", "c"]
KINDS = {"leafwise": dict(min_rows=5, l1=0.1, l2=0.1, row_share=0.8, column_share=0.8, max_leaves=5),
         "symmetric": dict(l2=3.0, symmetric=True), "levelwise": dict(min_weight=1.0, l1=0.1, l2=1.0, row_share=0.8)}


def fits(rounds=6, depth=3):
    return [B.Fit(f"{k}{'' if f is None else f}", () if f is None else ((0, f),), rounds=rounds, depth=depth, **v)
            for k, v in KINDS.items() for f in (None, 0, 1)]


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.random(700), rng.integers(0, 2, 700), rng.normal(size=700).round(2)
    y = (a + 0.3 * b + 0.1 * c + 0.3 * rng.normal(size=700) > 0.7).astype(int)
    rows = [(i, float(a[i]), int(b[i]), float(c[i]), int(y[i]), i % 3) for i in range(700)]
    return spark.createDataFrame(rows, "id long, a double, b int, c double, y int, fold int").repartition(4).persist()


def grown(train, rows, **kw):
    thresholds = B.fit_bins(train, FEATS)
    table = B.blocks(train if rows < 700 else train.coalesce(1), FEATS, thresholds, "y", ["fold"], "id", rows)
    return table, thresholds, B.grow(table, fits(**kw), thresholds).collect()


def test_one_block_and_many_give_the_same_trees(train):
    one, thresholds, alone = grown(train, 700)
    many, _, together = grown(train, 90)
    assert one.count() == 1 and many.count() >= 8
    trees = [{(r["fit"], r["tree"]): r for r in rows if r["tree"] >= 0} for rows in (alone, together)]
    assert trees[0].keys() == trees[1].keys() and len(trees[0]) == 9 * 6
    for k, r in trees[0].items():
        for c in ("feature", "bin", "gain", "cover", "value"):
            assert r[c] == trees[1][k][c], (k, c)
    held = [{(r["fit"], i): m for r in rows if r["tree"] < 0 for i, m in zip(r["row_id"], r["margin"], strict=True)} for rows in (alone, together)]
    assert held[0] == held[1] and len(held[0]) == 3 * sum(1 for i in range(700) if i % 3 != 2)


def test_plain_recomputation_of_the_first_tree(train):
    """Root split and leaf values of a fit without sampling, by trying every split over the rows."""
    _, thresholds, rows = grown(train, 700, depth=1)
    tree = next(r for r in rows if r["fit"] == "levelwise" and r["tree"] == 0)
    data = train.orderBy("id").collect()
    taught = B._shares(np.array([r["id"] for r in data]), 42, 0) < 0.8
    y = np.array([r["y"] for r in data], float)
    p0 = y.mean()
    g, h = np.rint((p0 - y) * B.UNIT) / B.UNIT, np.full(len(y), np.rint(p0 * (1 - p0) * B.UNIT) / B.UNIT)

    def score(m):
        return max(abs(g[m].sum()) - 0.1, 0) ** 2 / (h[m].sum() + 1.0)

    best = None
    for f, name in enumerate(FEATS):
        x = np.array([float(r[name]) for r in data])
        for b, t in enumerate(thresholds[f]):
            left, right = taught & (x <= t), taught & (x > t)
            if min(h[left].sum(), h[right].sum()) >= 1.0:
                gain = score(left) + score(right) - score(taught)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, b, left, right)
    gain, f, b, left, right = best
    assert (tree["feature"][1], tree["bin"][1]) == (f, b) and tree["gain"][1] == pytest.approx(gain, rel=1e-9)
    for node, side in ((2, left), (3, right)):
        total = g[side].sum()
        value = -0.05 * math.copysign(max(abs(total) - 0.1, 0), total) / (h[side].sum() + 1.0) + math.log(p0 / (1 - p0))
        assert tree["value"][node] == pytest.approx(value, rel=1e-9)


def test_limits_hold(train):
    _, thresholds, rows = grown(train, 700, depth=5)
    for r in rows:
        if r["tree"] < 0:
            continue
        inner = [i for i, f in enumerate(r["feature"]) if f >= 0]
        if r["fit"].startswith("leafwise"):
            assert len(inner) <= 4
            assert all(min(r["cover"][2 * i], r["cover"][2 * i + 1]) >= 5 for i in inner)
            assert len({r["feature"][i] for i in inner}) <= 2  # 0.8 of three features
        if r["fit"].startswith("symmetric"):
            for level in range(5):
                used = {(r["feature"][i], r["bin"][i]) for i in inner if 1 << level <= i < 2 << level
                        and 0 <= r["bin"][i] < len(thresholds[r["feature"][i]])}
                assert len(used) <= 1


@pytest.mark.parametrize("kind", list(KINDS))
def test_spark_model_scores_as_the_fit(spark, train, kind):
    table, thresholds, rows = grown(train, 700, rounds=8, depth=4)
    fit = next(f for f in fits(8, 4) if f.name == f"{kind}0")
    model = B.as_spark_model(spark, [r for r in rows if r["fit"] == fit.name and r["tree"] >= 0], thresholds, fit)
    held = {i: 1 / (1 + math.exp(-m)) for r in rows if r["fit"] == fit.name and r["tree"] < 0
            for i, m in zip(r["row_id"], r["margin"], strict=True)}
    scored = model.transform(VectorAssembler(inputCols=FEATS, outputCol="features").transform(train)).select(
        "id", vector_to_array("probability")[1].alias("p")).collect()
    got = {r["id"]: r["p"] for r in scored}
    assert all(got[i] == pytest.approx(p, abs=1e-12) for i, p in held.items())
    assert model.getNumTrees == 8 and abs(sum(model.featureImportances.toArray()) - 1) < 1e-9


def test_better_than_the_share_and_odd_tables(spark, train):
    thresholds = B.fit_bins(train, FEATS)
    table = B.blocks(train, FEATS, thresholds, "y", ["fold"], "id")
    scores = B.held_out_scores(B.grow(table, fits(60), thresholds)).join(train.select(F.col("id").alias("row_id"), "y"), "row_id")
    for r in scores.groupBy("fit").agg(F.avg(((F.col("probability") > 0.5) == (F.col("y") == 1)).cast("int")).alias("right")).collect():
        assert r["right"] > 0.72, r
    same = train.withColumn("y", F.lit(1)).withColumn("a", F.lit(2.0)).withColumn("b", F.lit(0))
    bins = B.fit_bins(same, FEATS)
    assert bins[0] == bins[1] == []
    trees = B.grow(B.blocks(same, FEATS, bins, "y", ["fold"], "id"), fits(2), bins).where("tree >= 0").collect()
    assert all(r["value"][1] > 5 or r["tree"] > 0 for r in trees)  # one class only: all the odds there are
    with pytest.raises(ValueError):
        B.grow(B.blocks(train.where("false"), FEATS, thresholds, "y", ["fold"], "id"), fits(2), thresholds)


def test_partitions_do_not_make_blocks_and_equal_codes_are_kept_once(train):
    """A table of few rows is one block however it is dealt, and rows with equal codes share a vector."""
    thresholds = B.fit_bins(train, FEATS)
    twice = train.unionByName(train.withColumn("id", F.col("id") + 700)).repartition(9)
    table = B.blocks(twice, FEATS, thresholds, "y", ["fold"], "id")
    row = table.collect()
    assert len(row) == 1 and row[0]["n"] == 1400 and row[0]["vectors"] <= 700
    many = B.blocks(twice, FEATS, thresholds, "y", ["fold"], "id", 100)
    trees = [{(r["fit"], r["tree"]): (r["feature"], r["bin"], r["value"]) for r in B.grow(t, fits(4), thresholds).where("tree >= 0").collect()}
             for t in (table, many)]
    assert many.count() > 1 and trees[0] == trees[1]


def test_joint_and_remaining_histograms_equal_plain_sums():
    """Features counted together and the child that is left over give the sums of a plain count, feature by feature."""
    rng = np.random.default_rng(5)
    codes = np.unique(np.column_stack([rng.integers(0, 32, 900), rng.integers(0, 32, 900), *rng.integers(0, 2, (5, 900)), rng.integers(0, 9, 900)]), axis=0)
    v = len(codes)
    cell = np.sort(rng.integers(0, 2 * v, 5000))
    rows = B.Rows({"n": 5000, "vectors": v, "codes": codes.astype(np.uint8).tobytes(), "cell": cell.astype("<u4").tobytes(),
                   "folds": np.array([[0], [1]], np.int8).tobytes(), "fold_group": rng.integers(0, 2, 5000).astype("<u2").tobytes(),
                   "row_id": np.arange(5000).astype("<i8").tobytes()}, 8, 32)
    assert sorted(f for features, _, _ in rows.joint for f in features) == list(range(8)) and len(rows.joint) < 4
    fit = B.Fit("f", ((0, 0),), depth=4, row_share=0.7)
    counts = rows.counts(fit, 3)
    drawn = rows.outside(fit.exclude) & (B._shares(rows.row_id, fit.seed, 3) < 0.7)
    assert counts.sum() == drawn.sum() and (counts.ravel() == np.bincount(cell[drawn], minlength=2 * v)).all()
    at = np.flatnonzero(counts.any(axis=1))
    sums = rows.derivatives(rng.normal(size=v)[at], counts[at])
    tree, node, hist = B.Tree(4), np.ones(len(at), np.int64), rows.histogram(np.ones(len(at), np.int64), 0, at, sums)
    for level in range(4):
        if level:
            hist = rows.histogram_below(hist, tree, node, level, at, sums)
        k, plain = 1 << level, np.zeros((3, 1 << level, 8, 32))
        live = node >= k
        for i, s in enumerate(sums):
            for f in range(8):
                np.add.at(plain[i, :, f], (node[live] - k, codes[at, f][live]), s[live])
        assert (hist == plain).all()
        assert B.grow_level(tree, fit, 3, level, hist)
        node = tree.place(codes[at], level + 1)
    B.finish(tree, B.Fit("f", max_leaves=5))
    assert (tree.leaves()[node] == tree.place(codes[at], 4)).all() and len(set(tree.leaves()[node])) == 5
