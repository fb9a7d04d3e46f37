"""Patient cohort derived from the driver tables (test and bench input).

The original pipeline reads one survey table.  The driver ships TPC-H-like
tables instead, so a deterministic cohort is derived from ``orders`` joined to
``customer``: one patient per order.  It deliberately contains the edge cases
the operators must handle (NULL answers, wrong-case answers, missing eGFR and
hemoglobin, probabilities exactly on band edges, ages outside all bins).

The DataFrame form below and :data:`COHORT_SQL` compute the same rows; the
SQL text runs unchanged in Spark SQL and DuckDB and heads every oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

COHORT_COLUMNS = [
    "patient_id", "age", "gender", "diabetes", "hypertension", "foamy_urine",
    "extra_salt", "living_area", "serum_creatinine", "hemoglobin", "egfr",
    "probability", "ckd_diagnosis",
]

COHORT_SQL = """
SELECT patient_id, age, gender, diabetes, hypertension, foamy_urine, extra_salt, living_area,
       serum_creatinine, hemoglobin, egfr, probability,
       CASE WHEN (coalesce(egfr, 0e0) < 60e0) <> (patient_id % 19 = 0) THEN 1 ELSE 0 END AS ckd_diagnosis
FROM (
  SELECT b.*,
    CASE WHEN patient_id % 41 = 0 THEN CAST(NULL AS DOUBLE)
         WHEN patient_id % 500 = 1 THEN 15e0 * (1 + CAST(floor(patient_id / 500e0) AS BIGINT) % 6)
         ELSE floor(14200e0 * power(serum_creatinine / (CASE WHEN gender = 'Female' THEN 0.7e0 ELSE 0.9e0 END),
                CASE WHEN gender = 'Female' AND serum_creatinine <= 0.7e0 THEN -0.241e0
                     WHEN (gender IS NULL OR gender <> 'Female') AND serum_creatinine <= 0.9e0 THEN -0.302e0
                     ELSE -1.2e0 END) * power(0.9938e0, CAST(age AS DOUBLE)) + 0.5e0) / 100e0 END AS egfr,
    CASE WHEN patient_id % 700 = 0 THEN 0.3e0
         WHEN patient_id % 700 = 1 THEN 0.7e0
         ELSE floor(10000e0 / (1e0 + exp(2.5e0 - 0.9e0 * serum_creatinine - 0.01e0 * age
                + 0.05e0 * coalesce(hemoglobin, 11e0))) + 0.5e0) / 10000e0 END AS probability
  FROM (
    SELECT o_orderkey AS patient_id,
      CAST(o_orderkey % 123 AS INT) AS age,
      CASE WHEN o_orderkey % 20 = 0 THEN CAST(NULL AS VARCHAR(10)) WHEN o_orderkey % 20 = 1 THEN 'male'
           WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Yes' WHEN o_orderpriority = '5-LOW' THEN 'yes' ELSE 'No' END AS diabetes,
      CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS hypertension,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Yes' WHEN c_mktsegment = 'AUTOMOBILE' THEN CAST(NULL AS VARCHAR(10)) ELSE 'No' END AS foamy_urine,
      CASE WHEN c_nationkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS extra_salt,
      CASE WHEN c_nationkey % 3 = 0 THEN 'Urban' WHEN c_nationkey % 3 = 1 THEN 'Rural' ELSE CAST(NULL AS VARCHAR(10)) END AS living_area,
      floor(o_totalprice / 1000e0) / 100e0 + 0.4e0 AS serum_creatinine,
      CASE WHEN o_orderkey % 37 = 0 THEN CAST(NULL AS DOUBLE) ELSE floor((c_acctbal + 1000e0) / 11e0) / 100e0 + 6e0 END AS hemoglobin
    FROM orders JOIN customer ON o_custkey = c_custkey
  ) b
) e
"""


def _null(t: str):
    return F.lit(None).cast(t)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture cohort, one row per order, built with the DataFrame API.

    Only the six order columns and four customer columns are read.  The join is
    left to Catalyst/AQE: ``customer`` is broadcast when small, otherwise both
    sides shuffle on the customer key and AQE splits a hot key.
    """
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer",
                   ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    j = o.join(c, o.o_custkey == c.c_custkey)

    k = F.col("o_orderkey")
    b = j.select(
        k.alias("patient_id"),
        (k % 123).cast("int").alias("age"),
        F.when(k % 20 == 0, _null("string"))
         .when(k % 20 == 1, F.lit("male"))
         .when(F.col("o_custkey") % 2 == 0, F.lit("Male"))
         .otherwise(F.lit("Female")).alias("gender"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("Yes"))
         .when(F.col("o_orderpriority") == "5-LOW", F.lit("yes"))
         .otherwise(F.lit("No")).alias("diabetes"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Yes")).otherwise(F.lit("No")).alias("hypertension"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("Yes"))
         .when(F.col("c_mktsegment") == "AUTOMOBILE", _null("string"))
         .otherwise(F.lit("No")).alias("foamy_urine"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias("extra_salt"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit("Urban"))
         .when(F.col("c_nationkey") % 3 == 1, F.lit("Rural"))
         .otherwise(_null("string")).alias("living_area"),
        (F.floor(F.col("o_totalprice") / 1000.0) / 100.0 + 0.4).alias("serum_creatinine"),
        F.when(k % 37 == 0, _null("double"))
         .otherwise(F.floor((F.col("c_acctbal") + 1000.0) / 11.0) / 100.0 + 6.0).alias("hemoglobin"),
    )

    pid, scr, g = F.col("patient_id"), F.col("serum_creatinine"), F.col("gender")
    female = g == "Female"
    kappa = F.when(female, F.lit(0.7)).otherwise(F.lit(0.9))
    exponent = (F.when(female & (scr <= 0.7), F.lit(-0.241))
                .when((g.isNull() | (g != "Female")) & (scr <= 0.9), F.lit(-0.302))
                .otherwise(F.lit(-1.2)))
    egfr = (F.when(pid % 41 == 0, _null("double"))
            .when(pid % 500 == 1,
                  F.lit(15.0) * (F.lit(1) + F.floor(pid / 500.0).cast("bigint") % 6))
            .otherwise(F.floor(F.lit(14200.0) * F.pow(scr / kappa, exponent)
                               * F.pow(F.lit(0.9938), F.col("age").cast("double")) + 0.5) / 100.0))
    probability = (F.when(pid % 700 == 0, F.lit(0.3))
                   .when(pid % 700 == 1, F.lit(0.7))
                   .otherwise(F.floor(F.lit(10000.0) / (F.lit(1.0) + F.exp(
                       F.lit(2.5) - F.lit(0.9) * scr - F.lit(0.01) * F.col("age")
                       + F.lit(0.05) * F.coalesce(F.col("hemoglobin"), F.lit(11.0))))
                       + 0.5) / 10000.0))
    e = b.select("*", egfr.alias("egfr"), probability.alias("probability"))
    label = F.when((F.coalesce(F.col("egfr"), F.lit(0.0)) < 60.0) != (F.col("patient_id") % 19 == 0),
                   F.lit(1)).otherwise(F.lit(0))
    return e.select(*COHORT_COLUMNS[:-1], label.alias("ckd_diagnosis"))


def cohort_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cohort through Spark SQL on temp views (used to test :func:`cohort`)."""
    for t in ("orders", "customer"):
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(COHORT_SQL)
