"""Split and fold plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observed as OB
from ..operators import split as SP
from ..session import shared_path
from .base import encoded_split, patients, rhu, split_patients, with_ctes
from .registry import register


@register("f6_stratified_split", with_ctes(
    "SELECT patient_id, ckd_diagnosis, split FROM split", "split"))
def f6_stratified_split(spark, sf_dir):
    return split_patients(spark, sf_dir).select("patient_id", "ckd_diagnosis", "split")


_F7 = (f"SELECT split, ckd_diagnosis, n, {rhu('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY split)', 6)} AS share "
       "FROM (SELECT split, ckd_diagnosis, CAST(count(*) AS BIGINT) AS n FROM split GROUP BY 1, 2) t")


@register("f7_split_sizes_on_write", with_ctes(_F7, "split"))
def f7_split_sizes_on_write(spark, sf_dir):
    """The same counts, observed while the split table is written; the classes are 0, 1 and NULL."""
    wanted = OB.class_counts("ckd_diagnosis", [0, 1, None], "split", ["train", "validation", "test"])
    seen = OB.write_counted(split_patients(spark, sf_dir), shared_path(spark, "split"), wanted)
    rows = spark.createDataFrame([(g, c, seen[g, c]) for g, c in wanted if seen[g, c]], "split string, ckd_diagnosis int, n long")
    return SP.shares(rows)


@register("f7_split_sizes", with_ctes(_F7, "split"))
def f7_split_sizes(spark, sf_dir):
    return SP.split_sizes(split_patients(spark, sf_dir))


@register("f8_remaining_after_test", with_ctes(
    "SELECT p.patient_id, p.ckd_diagnosis FROM patients p "
    "WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.split = 'test' AND s.patient_id = p.patient_id)",
    "split"))
def f8_remaining_after_test(spark, sf_dir):
    sp = split_patients(spark, sf_dir)
    test_ids = sp.where(F.col("split") == "test").select("patient_id")
    return SP.remaining_after(patients(spark, sf_dir), test_ids, "patient_id") \
             .select("patient_id", "ckd_diagnosis")


_M7 = """
SELECT patient_id, ckd_diagnosis, CAST((row_number() OVER (PARTITION BY ckd_diagnosis ORDER BY h, patient_id) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT patient_id, ckd_diagnosis,
             ('0x' || substr(md5('42|kfold|' || CAST(patient_id AS VARCHAR)), 1, 15))::BIGINT AS h
      FROM split WHERE split = 'train') t
"""


@register("m7_stratified_kfold", with_ctes(_M7, "split"))
def m7_stratified_kfold(spark, sf_dir):
    train = encoded_split(spark, sf_dir).where(F.col("split") == "train")
    return SP.kfold_assign(train.select("patient_id", "ckd_diagnosis"))
