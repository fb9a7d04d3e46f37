"""Properties of the distributed operators (ranks, quantiles, split, k-NN, SMOTE, AUC, attribution)."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from renalytics.operators import evaluate as EV
from renalytics.operators import knn as KN
from renalytics.operators import quantiles as Q
from renalytics.operators import rank as R
from renalytics.operators import smote as SM
from renalytics.operators import split as SP

from .conftest import SMALL_SF


def test_two_level_rank_equals_global_rank(spark):
    rnd = random.Random(3)
    rows = [(i, 0 if i % 3 else 1) for i in rnd.sample(range(100000), 3000)]  # one hot class
    df = spark.createDataFrame(rows, "id long, g int").withColumn("h", R.hash60(F.lit("7"), "id"))
    mine = R.ranked_within(df, ["g"], ["h", "id"], R.hash_bucket("h", 6), rank_col="r")
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")) - 1)
    assert sorted(map(tuple, mine.select("id", "r").collect())) == \
        sorted(map(tuple, ref.select("id", "r").collect()))


def test_exact_quantiles_match_numpy_with_hot_value(spark):
    rnd = np.random.default_rng(5)
    vals = np.concatenate([np.full(2000, 7.25), rnd.normal(10, 3, 4000)])
    groups = np.arange(len(vals)) % 3
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g int, x double")
    qs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = {(r["g"], r["q"]): r["value"] for r in Q.exact_quantiles(df, ["x"], qs, ["g"]).collect()}
    for g in range(3):
        for q in qs:
            assert got[(g, q)] == pytest.approx(np.quantile(vals[groups == g], q), abs=1e-9)
    whole = {r["q"]: r["value"] for r in Q.exact_quantiles(df, ["x"], qs).collect()}
    for q in qs:
        assert whole[q] == pytest.approx(np.quantile(vals, q), abs=1e-9)


def test_split_is_disjoint_complete_and_stratified(spark):
    from renalytics.plans.base import patients
    p = patients(spark, SMALL_SF)
    s = SP.stratified_split(p)
    assert s.count() == p.count() == s.select("patient_id").distinct().count()
    for r in s.groupBy("ckd_diagnosis").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t"),
            F.count_if(F.col("split") == "validation").alias("v")).collect():
        n_test = int(np.floor(r["n"] * 0.1 + 0.5))
        assert r["t"] == n_test
        assert r["v"] == int(np.floor((r["n"] - n_test) * 0.2222 + 0.5))


def _brute_knn(vecs, k):
    """(gid, j) -> nb_gid by (rounded d2, group id), expanded by multiplicity."""
    out = {}
    for g, (xg, mg) in vecs.items():
        cand = []
        for h, (xh, mh) in vecs.items():
            if h == g:
                if mg > 1:
                    cand.append((0.0, h, mg - 1))
                continue
            d2 = sum((a - b) ** 2 for a, b in zip(xg, xh))
            cand.append((round(d2, 9), h, mh))
        cand.sort()
        j = 0
        for _, h, m in cand:
            for _ in range(m):
                if j < k:
                    out[(g, j)] = h
                    j += 1
    return out


def test_grid_knn_equals_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        v = (round(rnd.gauss(0, 1), 2), round(rnd.gauss(0, 1), 1), rnd.randint(0, 1), rnd.randint(0, 1))
        rows.append((i, *v))
    rows += [(1000 + i, *rows[0][1:]) for i in range(30)]  # a hot duplicated vector
    df = spark.createDataFrame(rows, "id long, a double, b double, c int, d int")
    vec = df.groupBy("a", "b", "c", "d").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("mult"))
    got = {(r["gid"], r["j"]): r["nb_gid"] for r in KN.knn_table(vec, ["a", "b"], ["c", "d"], 5).collect()}
    vecs = {r["gid"]: ((r["a"], r["b"], float(r["c"]), float(r["d"])), r["mult"]) for r in vec.collect()}
    assert got == _brute_knn(vecs, 5)


def test_smote_counts_and_segments(spark):
    maj = [(i, float(i), float(i % 2), 1) for i in range(10)]
    mino = [(100, 0.0, 0.0, 0), (101, 1.0, 1.0, 0), (102, 0.5, 0.0, 0), (103, 3.0, 1.0, 0)]
    df = spark.createDataFrame(maj + mino, "patient_id long, x double, b double, y int")
    syn = SM.smote(df, ["x"], ["b"], "y", "patient_id").collect()
    assert len(syn) == int(0.6 * 10) - 4 == 2
    pts = [(x, b) for _, x, b, _ in mino]
    for r in syn:
        assert r["y"] == 0
        on_segment = any(
            abs((r["x"] - p[0]) * (q[1] - p[1]) - (r["b"] - p[1]) * (q[0] - p[0])) < 1e-9
            and min(p[0], q[0]) - 1e-9 <= r["x"] <= max(p[0], q[0]) + 1e-9
            for p, q in itertools.permutations(pts, 2))
        assert on_segment


def test_smote_adds_nothing_when_ratio_met(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(20)], "patient_id long, x double, y int")
    assert SM.smote(df, ["x"], [], "y", "patient_id").count() == 0


def test_auc_invariant_under_monotone_transform(spark):
    rnd = random.Random(2)
    rows = [("v", "m", rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "split string, model string, label int, probability double")
    a = EV.roc_auc(df, decimals=None).first()["roc_auc"]
    b = EV.roc_auc(df.withColumn("probability", F.pow("probability", 3)), decimals=None).first()["roc_auc"]
    assert a == pytest.approx(b, abs=1e-12)
    # against the average-rank formula
    y = np.array([r[2] for r in rows]); s = np.array([r[3] for r in rows])
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):  # average ranks of ties
        ranks[s == v] = ranks[s == v].mean()
    npos, nneg = y.sum(), (1 - y).sum()
    assert a == pytest.approx((ranks[y == 1].sum() - npos * (npos + 1) / 2) / (npos * nneg), abs=1e-12)


def test_roc_curve_ends_at_one(spark):
    rows = [("v", "m", i % 2, (i % 7) / 7.0) for i in range(100)]
    df = spark.createDataFrame(rows, "split string, model string, label int, probability double")
    pts = sorted(EV.roc_curve(df).collect(), key=lambda r: r["idx"])
    assert (pts[0]["fpr"], pts[0]["tpr"]) == (0.0, 0.0)
    assert (pts[-1]["fpr"], pts[-1]["tpr"]) == (1.0, 1.0)
    assert [r["idx"] for r in pts] == list(range(len(pts)))


def test_every_patient_gets_one_stage_and_band(spark):
    from renalytics.operators import staging as ST
    from renalytics.plans.base import patients
    p = patients(spark, SMALL_SF)
    st = ST.stage_table(p)
    assert st.where(F.col("ckd_stage").isNull()).count() == 0
    dist = ST.stage_distribution(st).collect()
    assert sum(r["n_patients"] for r in dist) == p.count()


def test_grid_knn_dense_cluster_guard_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, 5.0 + rnd.random() * 1e-3, 5.0 + rnd.random() * 1e-3, 1, 0) for i in range(120)]  # dense
    rows += [(500 + i, rnd.gauss(0, 3), rnd.gauss(0, 3), rnd.randint(0, 1), rnd.randint(0, 1))
             for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c int, d int")
    vec = df.groupBy("a", "b", "c", "d").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("mult"))
    got = {(r["gid"], r["j"]): r["nb_gid"]
           for r in KN.knn_table(vec, ["a", "b"], ["c", "d"], 5, max_cell=16).collect()}
    vecs = {r["gid"]: ((r["a"], r["b"], float(r["c"]), float(r["d"])), r["mult"]) for r in vec.collect()}
    assert got == _brute_knn(vecs, 5)


def test_exact_quantiles_of_odd_columns(spark, monkeypatch):
    """Distinct values, spread over all magnitudes, infinities, few values, and few bins, so that several rounds are needed."""
    monkeypatch.setattr(Q, "BINS", 48)
    rng = np.random.default_rng(2)
    qs = [0.0, 0.5, 0.77]
    odd = {"distinct": rng.permutation(3000).astype(float), "wide": 10.0 ** rng.uniform(-300, 300, 800) * rng.choice([-1, 1], 800),
           "hot": np.repeat([1.0, 2.0, 2.5], [5, 4000, 6]), "two": np.array([1.0, 2.0]), "one": np.array([7.0]),
           "ends": np.array([-np.inf, -1.7e308, 0.0, 1.7e308, np.inf, 3.0, 4.0])}
    rows = [(None if name == "two" else name, float(v)) for name, vs in odd.items() for v in vs] + [("one", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {(r["g"], r["q"]): r["value"] for r in Q.exact_quantiles(df, ["x"], qs, ["g"], accuracy=50).collect()}
    for name, vs in odd.items():
        for q in qs:
            s, at = np.sort(vs), q * (len(vs) - 1)
            lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
            want = lo if lo == hi else lo + (at - np.floor(at)) * (hi - lo)
            assert got[(None if name == "two" else name), q] == pytest.approx(want, rel=1e-12), (name, q)
    assert Q.exact_quantiles(df.where("false"), ["x"], qs).count() == 0


def test_values_of_a_quantile_are_not_gathered_by_column(spark, monkeypatch):
    """The brackets come to the values, so that no task gets a whole column."""
    plans, inner = [], Q._round

    def watched(rows, targets, keys):
        rows.groupBy().count().collect()
        seen = rows.select("value", "lo")
        seen.collect()
        plans.append(seen._jdf.queryExecution().executedPlan().toString())
        return inner(rows, targets, keys)

    monkeypatch.setattr(Q, "_round", watched)
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") % 9973).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table whose estimated size is above it
    try:
        got = {(r["column"], r["q"]): r["value"] for r in Q.exact_quantiles(df, ["x", "y"], [0.25, 0.5]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got["y", 0.5] == 3.0 and len(got) == 4
    assert plans and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
