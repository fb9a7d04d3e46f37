"""Rows that must not get lost or wrong: NULL labels, features and scores, large numbers, outliers."""

import random

import pytest
from pyspark.sql import functions as F

from renalytics.functions import exprs as X
from renalytics.functions.spec import COHORT_SPEC
from renalytics.operators import evaluate as EV
from renalytics.operators import knn as KN
from renalytics.operators import smote as SM
from renalytics.operators import split as SP


def test_split_and_folds_keep_null_labels(spark):
    rows = [(i, None if i % 10 == 0 else i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "patient_id long, ckd_diagnosis int")
    split = SP.stratified_split(df)
    assert split.count() == 100 and split.where("split IS NULL").count() == 0
    assert split.where("ckd_diagnosis IS NULL AND split = 'test'").count() == 1
    assert SP.kfold_assign(df, spec=COHORT_SPEC).count() == 100
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Exchange", "Window", "Sort"))
    assert SP.stratified_split(df.limit(0)).count() == 0


def test_smote_refuses_null_features(spark):
    rows = [(i, float(i), 0) for i in range(60)] + [(100 + i, None if i < 3 else float(i), 1) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, x double, y int")
    with pytest.raises(ValueError, match="3 minority rows"):
        SM.smote(df, ["x"], [], "y", "id")
    whole = SM.smote(df.where("x IS NOT NULL OR y = 0"), ["x"], [], "y", "id")
    assert whole.count() == 36 - 7


def test_scores_without_value_take_no_part(spark):
    rows = [("v", "m", 1, 0.9), ("v", "m", 0, 0.1), ("v", "m", 1, None), ("v", "m", 0, None), ("v", "m", None, 0.5)]
    df = spark.createDataFrame(rows, "split string, model string, label int, probability double")
    assert EV.roc_auc(df).first()["roc_auc"] == 1.0
    cm = EV.confusion(EV.predictions(df)).first()
    assert (cm["tp"], cm["fp"], cm["fn"], cm["tn"]) == (1, 0, 0, 1)
    curve = EV.roc_curve(df).orderBy("idx").collect()
    assert [(r["fpr"], r["tpr"]) for r in curve] == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


@pytest.mark.parametrize("value", [1e13, -1e13, 1e18, 1e300, 12345.678901249, -0.0000001])
def test_rounding_does_not_saturate(spark, value):
    got = spark.createDataFrame([(value,)], "x double").select(X.round_half_up("x", 6).alias("r")).first()["r"]
    assert got == pytest.approx(round(value, 6), rel=1e-15)


def brute_knn(points, k):
    out = {}
    for g, p in points.items():
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(p, q)), 9), h) for h, q in points.items() if h != g)
        out[g] = [h for _, h in near[:k]]
    return out


@pytest.mark.parametrize("shape", ["outlier", "wide", "clusters"])
def test_knn_finds_every_neighbour(spark, shape):
    rng = random.Random(3)
    if shape == "outlier":
        points = {i: (float(i),) for i in range(30)} | {30: (1e6,)}
        cont, binary = ["a"], []
    elif shape == "wide":
        points = {i: tuple([rng.random() * 3 for _ in range(5)] + [float(rng.random() < 0.3) for _ in range(12)]) for i in range(60)}
        cont, binary = [f"c{i}" for i in range(5)], [f"b{i}" for i in range(12)]
    else:
        points = {i: (rng.gauss(100 * (i % 3), 0.01), rng.gauss(0, 0.01)) for i in range(90)} | {90: (1e5, -1e5), 91: (5e4, 0.0)}
        cont, binary = ["a", "b"], []
    df = spark.createDataFrame([(g, 1, *p) for g, p in points.items()],
                               "gid long, mult long, " + ", ".join(f"{c} double" for c in cont + binary))
    got = {}
    for r in KN.knn_table(df, cont, binary, 5, max_cell=4).orderBy("gid", "j").collect():
        got.setdefault(r["gid"], []).append(r["nb_gid"])
    assert got == brute_knn(points, 5)


def test_unset_checkpoint_folder_on_a_cluster_is_refused():
    from renalytics import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, _key, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_stream_guidance_keeps_no_state(spark, tmp_path):
    from renalytics.plans.base import patients_raw
    from renalytics.plans.fixture_models import fixture_artefacts
    from renalytics.streaming.scoring_stream import start_scoring

    from .conftest import SMALL_SF
    raw = patients_raw(spark, SMALL_SF)
    raw.write.parquet(f"{tmp_path}/in")
    query = start_scoring(spark, f"{tmp_path}/in", raw.schema, fixture_artefacts(spark, SMALL_SF), f"{tmp_path}/out",
                          f"{tmp_path}/ckpt", with_guidance=True)
    query.awaitTermination()
    assert not query.lastProgress["stateOperators"]
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == raw.count() and out.where(F.col("guidance") != "").count() == raw.count()


def test_knn_outside_folds_equals_brute_force(spark):
    """Copies, vectors whose copies all lie in one fold, and a near cluster that lies in one fold whole."""
    rng = random.Random(5)
    rows = []  # (id, fold, a, b)
    for i in range(60):
        a, b = (rng.gauss(0, 0.01), 0.0) if i < 25 else (rng.choice([1.0, 2.0, 3.5, 9.0]), float(rng.random() < 0.5))
        rows.append((i, 0 if i < 25 else rng.randrange(3), a, b))
    vectors = {}
    for i, f, a, b in rows:
        vectors.setdefault((a, b), []).append((i, f))
    gid = {v: min(i for i, _f in m) for v, m in vectors.items()}
    table = [(gid[v], *[sum(f != g for _i, f in m) for g in range(3)], *v) for v, m in vectors.items()]
    df = spark.createDataFrame(table, "gid long, o0 long, o1 long, o2 long, a double, b double")
    got = {(r["for_fold"], r["gid"], r["j"]): r["nb_gid"]
           for r in KN.knn_outside_folds(df, ["a"], ["b"], 4, ["o0", "o1", "o2"], max_cell=8).collect()}
    want = {}
    for g in range(3):
        for v, members in vectors.items():
            if all(f == g for _i, f in members):
                continue
            near = []
            for w, others in vectors.items():
                copies = sum(f != g for _i, f in others) - (v == w)
                near += [(round(sum((x - y) ** 2 for x, y in zip(v, w)), 9), gid[w])] * copies
            want |= {(g, gid[v], j): h for j, (_d, h) in enumerate(sorted(near)[:4])}
    assert got == want


def test_smote_in_folds_never_reads_the_fold_it_is_for(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(3), int(i % 5 == 0), rng.random(), float(rng.random() < 0.4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, fold int, y int, a double, b double")
    syn = SM.smote_in_folds(df, ["a"], ["b"], "y", "id", n_folds=3).collect()
    fold = {i: f for i, f, *_ in rows}
    assert {r["for_fold"] for r in syn} == {0, 1, 2}
    assert all(fold[r["base_gid"]] != r["for_fold"] and fold[r["nb_gid"]] != r["for_fold"] for r in syn)  # all vectors differ
    for f in range(3):
        m = sum(y for _i, g, y, *_ in rows if g != f)
        rest = sum(1 - y for _i, g, y, *_ in rows if g != f)
        assert sorted(r["synthetic_id"] for r in syn if r["for_fold"] == f) == list(range(int(0.6 * rest) - m))
    one = df.where("y = 0")
    assert SM.smote_in_folds(one, ["a"], ["b"], "y", "id", n_folds=3).count() == 0
    with pytest.raises(ValueError):
        SM.smote_in_folds(df.withColumn("a", F.when(F.col("id") != 5, F.col("a"))), ["a"], ["b"], "y", "id", n_folds=3)
