"""Batch scoring and streaming scoring give the same rows (R4 = R4s)."""

import tempfile

import pytest
from pyspark.sql import functions as F

from renalytics.operators import models as MD
from renalytics.operators import observed as OB
from renalytics.operators.features import unmapped_audit
from renalytics.operators.scoring import SCORED, score_fitted, score_patients
from renalytics.plans.base import FEATURES, patients_raw
from renalytics.plans.fixture_models import fixture_artefacts, scaled_split
from renalytics.streaming import fitted_stream as FS
from renalytics.streaming.scoring_stream import OUTPUT_COLUMNS, start_scoring

from .conftest import SMALL_SF


def test_stream_equals_batch(spark):
    art = fixture_artefacts(spark, SMALL_SF)
    raw = patients_raw(spark, SMALL_SF)
    base = tempfile.mkdtemp(prefix="renalytics-stream-")
    raw.write.mode("overwrite").parquet(f"{base}/in")
    q = start_scoring(spark, f"{base}/in", raw.schema, art, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    streamed = spark.read.parquet(f"{base}/out").select(*OUTPUT_COLUMNS)
    batch = score_patients(raw, art).select(*OUTPUT_COLUMNS)
    assert streamed.count() == batch.count() == raw.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_fitted_stream_equals_batch_and_replays_add_nothing(spark):
    art = fixture_artefacts(spark, SMALL_SF)
    train = scaled_split(spark, SMALL_SF).where("split = 'train' AND ckd_diagnosis IS NOT NULL")
    model = MD.plain(MD.fit_pipeline(train.select(*FEATURES, F.col("ckd_diagnosis").cast("double").alias("label")), FEATURES, MD.forest(3)))
    base = tempfile.mkdtemp(prefix="renalytics-fitted-")
    raw = patients_raw(spark, SMALL_SF).withColumn("age", F.when(F.col("patient_id") % 50 != 0, F.col("age")))
    raw.repartition(4).write.parquet(f"{base}/in")

    def run():
        FS.start_fitted_scoring(spark, f"{base}/in", raw.schema, art, model, f"{base}/out", f"{base}/stream", files_per_batch=2).awaitTermination()
        return FS.scored_rows(spark, f"{base}/out").select("patient_id", *SCORED)

    batch = score_fitted(raw, art, model).select("patient_id", *SCORED)
    n = raw.count()
    streamed = run()
    assert streamed.count() == n and streamed.exceptAll(batch).count() == 0
    counts = FS.batch_counts(spark, f"{base}/out").agg(F.sum("rows"), F.sum("unscored"), F.count(F.lit(1)), F.sum("unmapped_gender")).first()
    unscored = raw.where("age IS NULL").count()
    assert list(counts)[:3] == [n, unscored, 2] and unscored > 0
    assert counts[3] == unmapped_audit(raw).where("column = 'gender'").first()["n_unmapped"]

    some = score_fitted(raw.limit(7), art, model)
    assert not FS.put_batch(some, 0, f"{base}/out", art)           # a replayed batch
    some.write.parquet(f"{base}/out/rows/batch=2")                 # a batch whose driver was lost before it was recorded
    assert FS.scored_rows(spark, f"{base}/out").count() == n
    assert FS.put_batch(some, 2, f"{base}/out", art)               # ... and comes again
    assert FS.scored_rows(spark, f"{base}/out").count() == n + 7
    with pytest.raises(ValueError):
        FS.start_fitted_scoring(spark, f"{base}/in", raw.schema, art, model, f"{base}/out", f"{base}/other")


def test_counts_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert OB.write_counted(empty, f"{tempfile.mkdtemp()}/t", OB.null_counts(empty)) == {"rows": 0, "a": 0, "b": 0}
