"""Streaming scoring of arriving patients (R4s).

The batch scoring function is a pure projection, so the same code runs on a
streaming DataFrame: ``readStream`` (parquet files landing in a folder) ->
``score_patients`` -> ``writeStream`` with a checkpoint in the shared folder.
Stateless, so no watermark is needed; ``availableNow`` processes everything
present and stops (exactly-once through the file sink and checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.scoring import ScoringArtefacts, guidance_text, score_patients

OUTPUT_COLUMNS = ["patient_id", "probability", "prediction", "risk_category",
                  "egfr_estimated", "ckd_stage", "stage_description"]


def scored_stream(spark: SparkSession, source_path: str, schema: StructType,
                  art: ScoringArtefacts, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return score_patients(reader.parquet(source_path), art)


def start_scoring(spark: SparkSession, source_path: str, schema: StructType,
                  art: ScoringArtefacts, sink_path: str, checkpoint_path: str,
                  available_now: bool = True, with_guidance: bool = False) -> StreamingQuery:
    """Start the scoring stream into a parquet sink (file sink: exactly once)."""
    scored = scored_stream(spark, source_path, schema, art)
    extra = [guidance_text(art).alias("guidance")] if with_guidance else []
    out = scored.select(*OUTPUT_COLUMNS, *extra)
    w = (out.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint_path).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
