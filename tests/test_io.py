"""Loader checks and tolerant readers."""

import os
import tempfile

import pytest

from renalytics.functions.spec import SURVEY_SPEC
from renalytics.sources import io as IO


def test_load_normalises_drops_and_requires_target(spark):
    base = tempfile.mkdtemp(prefix="renalytics-io-")
    df = spark.createDataFrame([(1, " x ", 0.5, float("nan"), 1)],
                               "patient_id long, `Timestamp` string, `Hemoglobin ` double, egfr double, "
                               "`CKD_Diagnosis` int")
    df.write.parquet(f"{base}/ok")
    out = IO.load_patients(spark, f"{base}/ok", spec=SURVEY_SPEC)
    assert out.columns == ["patient_id", "hemoglobin", "egfr", "ckd_diagnosis"]
    assert out.first()["egfr"] is None  # NaN -> NULL
    df.drop("CKD_Diagnosis").write.parquet(f"{base}/no_target")
    with pytest.raises(ValueError):
        IO.load_patients(spark, f"{base}/no_target", spec=SURVEY_SPEC)
    with pytest.raises(FileNotFoundError):
        IO.load_patients(spark, f"{base}/absent", spec=SURVEY_SPEC)


def test_absent_result_table_reads_as_empty(spark):
    base = tempfile.mkdtemp(prefix="renalytics-io-")
    schema = "patient_id BIGINT, ckd_probability DOUBLE, risk_category STRING, actual_label INT"
    empty = IO.read_table_or_empty(spark, os.path.join(base, "missing"), schema)
    assert empty.count() == 0 and empty.columns == ["patient_id", "ckd_probability", "risk_category", "actual_label"]
    rows = spark.createDataFrame([(1, 0.25, "Low", 0)], schema)
    IO.write_table(rows, os.path.join(base, "risk"), "csv")
    back = IO.read_table_or_empty(spark, os.path.join(base, "risk"), schema, "csv")
    assert back.collect() == rows.collect()


def test_tolerant_reader_counts_bad_lines_and_files(spark):
    base = tempfile.mkdtemp(prefix="renalytics-io-")
    os.makedirs(f"{base}/csv")
    for i, body in enumerate(["1,40,1\n2,x,0\n", "3,50,1\n4,60\n5,70,0,9\n", ""]):
        with open(f"{base}/csv/part{i}.csv", "w") as f:
            f.write(body and " Patient_ID ,AGE,ckd_diagnosis\n" + body)
    schema = "` Patient_ID ` long, AGE int, ckd_diagnosis int"
    patients, rejects, files = IO.load_tolerant(spark, f"{base}/csv", "csv", schema, SURVEY_SPEC)
    assert sorted(tuple(r) for r in patients.collect()) == [(1, 40, 1), (3, 50, 1)]
    assert sorted(r["line"] for r in rejects.collect()) == ["2,x,0", "4,60", "5,70,0,9"]
    assert sorted((r["n_rows"], r["n_rejected"], r["readable"]) for r in files.collect()) == [(2, 1, True), (3, 2, True)]

    good = spark.createDataFrame([(1, 40, 1), (2, 41, 0)], schema.replace("`", ""). replace(" Patient_ID ", "patient_id "))
    good.coalesce(1).write.parquet(f"{base}/parquet")
    with open(f"{base}/parquet/part-bad.parquet", "w") as f:
        f.write("not a table")
    patients, rejects, files = IO.load_tolerant(spark, f"{base}/parquet", "parquet", "patient_id long, AGE int, ckd_diagnosis int", SURVEY_SPEC)
    assert patients.count() == 2 and rejects.count() == 0
    assert sorted((r["n_rows"], r["readable"]) for r in files.collect()) == [(0, False), (2, True)]
    with pytest.raises(FileNotFoundError):
        IO.load_tolerant(spark, f"{base}/absent", "csv", schema, SURVEY_SPEC)


def test_correlation_is_pairwise_complete_and_null_for_constants(spark):
    import numpy as np

    from renalytics.operators import profile as P
    rng = np.random.default_rng(1)
    rows = [(float(a) + 1e7, None if a > 0.8 else float(a + b), 5.0, None if b > 0.1 else 1.0, None) for a, b in rng.random((400, 2))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    got = {(r["x"], r["y"]): r["r"] for r in P.correlation_long(df, list("abcde")).collect()}
    keep = [(r[0], r[1]) for r in rows if r[1] is not None]
    assert got["a", "b"] == pytest.approx(float(np.corrcoef(np.array(keep).T)[0, 1]), abs=1e-6) == got["b", "a"]
    assert got["a", "a"] == got["b", "b"] == 1.0
    assert all(got[x, y] is None for x in "abcde" for y in "cde")
    assert len(got) == 25 and P.correlation_long(df.where("false"), ["a", "b"]).where("r IS NOT NULL").count() == 0
