"""The corpus pipeline: documents in, token ids of the training mix out.

Stages, in order: toxicity, line dedup, near-dedup, mixing, BPE.  Every stage works on all that the one
before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renalytics.llm import bpe, line_dedup, mixing, order_minhash, toxicity
from renalytics.llm.common import documents, fold, labels
from renalytics.session import shared_path

MAX_EPOCHS = 2.0      # repetition limit of the mix
TARGET_ENTROPY = 0.9  # share of the entropy of equal source weights


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
EXTRAS = "other_columns_of_documents"


def whole_rows(stage):
    """``stage`` with all further columns packed away, so that no working column can clash with them."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extras = [c for c in docs.columns if c not in COLUMNS]
        if not extras:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*[c for c in docs.columns if c in COLUMNS], F.struct(*extras).alias(EXTRAS))
        return stage(spark, packed, sf_dir).select(*[c if c in COLUMNS else F.col(EXTRAS)[c].alias(c) for c in docs.columns])
    return run_stage


@whole_rows
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 2 does not predict toxic; labels of the held-out fold are not learned."""
    model = toxicity.train(documents(spark, sf_dir, "doc_id", "text"), labels(spark, sf_dir), fold("doc_id", 4) != 2)
    scored = toxicity.score_documents(docs, model, docs.columns)
    return scored.where("predicted = 0").select(*docs.columns)


@whole_rows
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; ``n_chars`` follows the text."""
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@whole_rows
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    return order_minhash.keep_one(docs)


@whole_rows
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: every one at least once, none over the repetition limit."""
    return mixing.mix(docs, target_entropy=TARGET_ENTROPY, max_epochs=MAX_EPOCHS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix."""
    return bpe.encode_documents(docs)


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("bpe", encode)]

# Learned scores, near-duplicate components and BPE merges have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
