"""Scoring of arriving patients by a fitted pipeline of the registry, with a sink that a replayed batch leaves as it is.

``readStream`` -> ``foreachBatch`` -> :func:`..operators.scoring.score_fitted`.  Every batch is scored as a batch (one row per cell of
the model's thresholds) and written to a folder of
its own number and then recorded by a row of counts (rows, unscored rows, unmapped values, classes), which are observed
while the rows are written.  A batch that is recorded is skipped when it comes again; one that is not, because the
driver was lost in between, is written anew over what is left of it.  Readers take recorded batches only.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import observed as OB
from ..operators.model_registry import exists
from ..operators.scoring import SCORED, ScoringArtefacts, score_fitted


def put_batch(scored: DataFrame, batch: int, sink: str, art: ScoringArtefacts) -> bool:
    """Write one batch of scored rows unless it is recorded; whether it was written."""
    done = f"{sink}/counts/batch={batch}"
    spark = scored.sparkSession
    if exists(spark, f"{done}/_SUCCESS"):
        return False
    unmapped = {f"unmapped_{c}": n for c, n in OB.unmapped_counts(scored, art.spec).items()}
    counts = unmapped | {"unscored": F.count_if(F.col("probability").isNull()), "positive": F.count_if(F.col("prediction") == 1)}
    seen = OB.write_counted(scored, f"{sink}/rows/batch={batch}", counts, "overwrite")
    spark.createDataFrame([tuple(seen.values())], ", ".join(f"{n} long" for n in seen)).coalesce(1) \
         .write.mode("overwrite").parquet(done)
    return True


def batch_counts(spark: SparkSession, sink: str) -> DataFrame:
    """One row of counts per recorded batch."""
    return spark.read.parquet(f"{sink}/counts")


def scored_rows(spark: SparkSession, sink: str) -> DataFrame:
    """Rows of the recorded batches, with their ``batch``."""
    return spark.read.parquet(f"{sink}/rows").join(batch_counts(spark, sink).select("batch"), "batch", "left_semi")


def start_fitted_scoring(spark: SparkSession, source: str, schema: StructType, art: ScoringArtefacts, model: PipelineModel,
                         sink: str, checkpoint: str, available_now: bool = True, files_per_batch: int | None = None) -> StreamingQuery:
    """Start the stream.  Batch numbers come from the checkpoint, so a sink that holds batches is refused without it."""
    if exists(spark, f"{sink}/counts") and not exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{sink} holds batches of another checkpoint than {checkpoint}")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    keep = list(dict.fromkeys([art.spec.id, *[c for c in (*art.spec.yes_no, art.spec.gender, art.spec.living_area) if c in schema.names]]))
    writer = reader.parquet(source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, batch: put_batch(score_fitted(rows, art, model).select(*keep, *SCORED), batch, sink, art) and None)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
