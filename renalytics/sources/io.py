"""Sources and sinks of the pipeline.

* :func:`load_patients` reads parquet or CSV with an explicit schema, normalises
  column names, turns NaN into NULL, drops the listed columns and checks the
  target (A1-A4).  No schema inference on large inputs.  :func:`load_tolerant`
  goes on past bad records and files and counts them.
* :func:`write_table` / :func:`read_table_or_empty` are the result-table sink
  and its tolerant reader (A5, A6).
* :func:`write_report_text` writes one text record per patient report (A8),
  partitioned like the report table — never one file through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from ..functions import exprs as X
from ..functions.spec import COHORT_SPEC, ColumnSpec
from ..session import shared_path


def normalise_columns(df: DataFrame) -> DataFrame:
    """Strip and lower-case every column name (A2)."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def drop_listed(df: DataFrame, cols) -> DataFrame:
    """Drop the listed columns that are present; absent ones are ignored (A3)."""
    return df.drop(*[c for c in cols if c in df.columns])


def require_target(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """Fail before any job runs when the target column is missing (A4)."""
    if spec.target not in df.columns:
        raise ValueError(f"Target column {spec.target!r} not found in the dataset.")
    return df


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """NaN -> NULL on every floating column (NaN >= 90 is TRUE in Spark)."""
    return df.select(*[
        X.nan_to_null(c).alias(c) if isinstance(df.schema[c].dataType, (DoubleType, FloatType))
        else F.col(c)
        for c in df.columns])


def clean_patients(df: DataFrame, spec: ColumnSpec = COHORT_SPEC) -> DataFrame:
    """Column normalisation, NaN handling, drop list and target check (A2-A4)."""
    df = normalise_columns(df)
    df = nan_to_null_all(df)
    df = drop_listed(df, spec.drop)
    return require_target(df, spec)


def _require_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        raise FileNotFoundError(f"Dataset not found at: {path}")


def load_patients(spark: SparkSession, path: str, fmt: str = "parquet",
                  schema: StructType | str | None = None,
                  spec: ColumnSpec = COHORT_SPEC) -> DataFrame:
    """Read a patient table (A1).  A missing path raises before any job; a bad record or file fails the job."""
    _require_path(spark, path)
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return clean_patients(reader.format(fmt).load(path), spec)


CORRUPT = "_corrupt_record"


def load_tolerant(spark: SparkSession, path: str, fmt: str, schema: StructType | str,
                  spec: ColumnSpec = COHORT_SPEC) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read a patient table that may hold bad records and files (A1): (patients, rejects, files).

    ``rejects`` are the raw lines that do not fit ``schema`` with their ``file``; ``patients`` is everything else, cleaned.
    ``files`` has one row per file of ``path`` that is not empty, with ``n_rows``, ``n_rejected`` and ``readable``: a file
    that yields no row could not be read (or holds a header only), and its rows are in neither of the other two.  Nothing is dropped
    without a count.
    """
    _require_path(spark, path)
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    reader = spark.read.option("ignoreCorruptFiles", "true")
    if fmt == "csv":
        reader = reader.option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        rows = reader.schema(StructType([*wanted.fields, StructField(CORRUPT, StringType())])).csv(path)
    else:
        rows = reader.schema(wanted).format(fmt).load(path).withColumn(CORRUPT, F.lit(None).cast("string"))
    # Parsed once and kept: a CSV scan that reads fewer columns judges lines by those columns alone.
    parsed = shared_path(spark, "parsed")
    rows.withColumn("__file", F.col("_metadata.file_path")).write.parquet(parsed)
    rows = spark.read.parquet(parsed)
    rejects = rows.where(F.col(CORRUPT).isNotNull()).select(F.col("__file").alias("file"), F.col(CORRUPT).alias("line"))
    patients = clean_patients(rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "__file"), spec)
    per_file = rows.groupBy(F.col("__file").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(CORRUPT).alias("n_rejected"))
    listed = (spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file")))
    n_rows = F.coalesce("n_rows", F.lit(0)).cast("long")
    files = listed.join(per_file, "file", "left").select(
        "file", n_rows.alias("n_rows"), F.coalesce("n_rejected", F.lit(0)).cast("long").alias("n_rejected"),
        (n_rows > 0).alias("readable"))
    return patients, rejects, files


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Result-table sink (A5): overwrite, parallel writers, header for CSV."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def read_table_or_empty(spark: SparkSession, path: str, schema: StructType | str,
                        fmt: str = "parquet") -> DataFrame:
    """Tolerant reader (A6): an absent result table is an empty one of that schema."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


RECORD_SEPARATOR = "\x1e"  # ASCII record separator: a report card has line ends of its own


def write_report_text(reports: DataFrame, path: str, text_col: str = "report_text") -> None:
    """Report cards as text records, one per patient."""
    reports.select(text_col).write.mode("overwrite").option("lineSep", RECORD_SEPARATOR).text(path)


def read_report_text(spark: SparkSession, path: str) -> DataFrame:
    """The records of :func:`write_report_text`, one report card per row (``value``)."""
    return spark.read.option("lineSep", RECORD_SEPARATOR).text(path)
