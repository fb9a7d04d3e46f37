"""Readers for the driver's parquet tables.

Every reader selects only the columns a plan needs, so the parquet scan's
``ReadSchema`` stays narrow; Catalyst pushes filters into the same scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def tables_version(spark: SparkSession, sf_dir: str, names=("orders", "customer")) -> tuple:
    """Files, lengths and modification times of the tables: what a cached fit depends on."""
    found = []
    for n in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, n))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)]
    return tuple(sorted(found))


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the tables as temp views (for the SQL form of the same plans)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
