"""Registry of fitted members on shared storage.

A *key* names one training run: the versions of its input tables and its parameters.  Under it every member (a Spark ML
pipeline, or a table such as held-out scores) is saved as soon as it is fitted, and then recorded as a row of the
manifest table.  What is recorded is loaded, not fitted again, by any session that sees the same folder, so a driver that is
lost goes on after the last recorded member.  Members are written under fresh names; of two drivers that fit the
same one, the first to record wins.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

MANIFEST = "key string, member string, kind string, path string, written timestamp"


def registry_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names, else the session's own scratch folder (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/renalytics-models"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Registry:
    def __init__(self, spark: SparkSession, *key, root: str | None = None):
        self.spark = spark
        self.root = (root or registry_root(spark)).rstrip("/")
        self.key = hashlib.sha256(repr(key).encode()).hexdigest()[:16]
        self._loaded: dict[str, PipelineModel] = {}

    def manifest(self) -> DataFrame:
        """All recorded members of this key."""
        path = f"{self.root}/manifest"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(path).where(F.col("key") == self.key)

    def path_of(self, member: str) -> str | None:
        """Where the member lies; a record whose folder was cleared away does not count."""
        rows = self.manifest().where(F.col("member") == member).orderBy("written", "path").select("path").collect()
        return next((r["path"] for r in rows if exists(self.spark, r["path"])), None)

    def _record(self, member: str, kind: str, path: str) -> None:
        row = self.spark.createDataFrame([(self.key, member, kind, path)], "key string, member string, kind string, path string")
        row.withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _fresh(self, member: str) -> str:
        return f"{self.root}/{self.key}/{member.lower()}-{uuid.uuid4().hex[:12]}"

    def table(self, member: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The recorded table, made and saved first where there is none."""
        path = self.path_of(member)
        if path is None:
            path = self._fresh(member)
            make().write.parquet(path)
            self._record(member, "table", path)
        return self.spark.read.parquet(path)

    def model(self, member: str, make: Callable[[], PipelineModel]) -> PipelineModel:
        """The recorded pipeline; one that is fitted here is saved, recorded and read back."""
        if member not in self._loaded:
            path = self.path_of(member)
            if path is None:
                path = self._fresh(member)
                make().write().save(path)
                self._record(member, "model", path)
            self._loaded[member] = PipelineModel.load(path)
        return self._loaded[member]
