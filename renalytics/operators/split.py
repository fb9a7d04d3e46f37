"""Reproducible stratified split and k-fold assignment.

Membership is decided by the rank of ``md5(seed|id)`` inside each class: the
first ``round(n*test)`` rows of a class are test, the next
``round((n-n_test)*val)`` validation, the rest train.  Class shares are
therefore exact per class (the original rounds globally and spreads the
remainder, which can differ by one row per class; row membership cannot match
another random generator and is not a goal).  The id travels with the row, so
demographics and predictions can never be paired with the wrong patient.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..functions.spec import COHORT_SPEC, ColumnSpec
from .rank import hash60, hash_bucket, ranked_within


ROWS_PER_BUCKET = 2000


def _cut_offs(df: DataFrame, spec: ColumnSpec, h: Column, sizes: dict, wanted: dict) -> dict:
    """For each (class, rank) in ``wanted``: the ``(hash, id)`` of the row with that rank.

    Rows are counted per (class, hash prefix); a running sum finds the bucket that holds each
    wanted rank, and only the rows of those buckets are ranked.  One row per wanted rank comes back.
    """
    largest = max(sizes.values(), default=1)
    bits = max(1, min(20, math.ceil(math.log2(max(2, largest // ROWS_PER_BUCKET)))))
    spark = df.sparkSession
    target = df.schema[spec.target].dataType.simpleString()
    want = spark.createDataFrame([(c, r) for c, ranks in wanted.items() for r in ranks],
                                 f"w_class {target}, w_rank long")
    hashed = df.select(F.col(spec.target).alias("c"), h.alias("h"), F.col(spec.id).alias("i"))
    hashed = hashed.withColumn("b", hash_bucket("h", bits))
    counts = hashed.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    spans = counts.withColumn("end", F.sum("n").over(upto))
    # The wanted ranks are two per class: a broadcast of a few rows.
    hit = spans.join(F.broadcast(want), F.col("c").eqNullSafe(F.col("w_class"))
                     & (F.col("w_rank") < F.col("end")) & (F.col("w_rank") >= F.col("end") - F.col("n")))
    hit = hit.select("w_class", "w_rank", F.col("b").alias("w_b"), (F.col("end") - F.col("n")).alias("before"))
    rows = hashed.join(F.broadcast(hit), F.col("c").eqNullSafe(F.col("w_class")) & (F.col("b") == F.col("w_b")))
    within = Window.partitionBy("w_class", "w_rank").orderBy("h", "i")
    at = (rows.withColumn("r", F.col("before") + F.row_number().over(within) - 1)
          .where("r = w_rank").select("w_class", "w_rank", "h", "i"))
    return {(r["w_class"], r["w_rank"]): (r["h"], r["i"]) for r in at.collect()}


def stratified_split(df: DataFrame, spec: ColumnSpec = COHORT_SPEC, seed: int = fixed.RANDOM_STATE,
                     test_size: float = fixed.TEST_SIZE, val_size: float = fixed.VAL_SIZE_OF_REST
                     ) -> DataFrame:
    """Add ``split`` in {'train', 'validation', 'test'}.

    Two cut-offs per class are fitted (see :func:`_cut_offs`); the split itself compares
    ``(hash, id)`` with them in a projection, without a shuffle.  A NULL label is a class of its own.
    """
    h = hash60(F.lit(str(seed)), spec.id)
    sizes = {r[0]: r[1] for r in df.groupBy(spec.target).agg(F.count(F.lit(1))).collect()}  # classes
    wanted = {}
    for c, n in sizes.items():
        n_test = math.floor(float(n) * test_size + 0.5)
        wanted[c] = (n_test, n_test + math.floor((float(n) - n_test) * val_size + 0.5))
    found = _cut_offs(df, spec, h, sizes, wanted)

    def before(cut) -> Column:
        """Rows whose (hash, id) lies before a cut-off; a rank beyond the last row has none."""
        if cut is None:
            return F.lit(True)
        i = F.col(spec.id)
        return (F.col("__h") < F.lit(cut[0])) | ((F.col("__h") == F.lit(cut[0])) & (i < F.lit(cut[1])))

    split = F.lit(None).cast("string")
    for c, (test_end, val_end) in wanted.items():
        own = F.col(spec.target).isNull() if c is None else F.col(spec.target) == F.lit(c)
        part = (F.when(before(found.get((c, test_end))), F.lit("test"))
                .when(before(found.get((c, val_end))), F.lit("validation")).otherwise(F.lit("train")))
        split = F.when(own, part).otherwise(split)
    return df.withColumn("__h", h).withColumn("split", split).drop("__h")


def split_sizes(split_df: DataFrame, spec: ColumnSpec = COHORT_SPEC) -> DataFrame:
    """Rows per (split, class) and the class share within each split."""
    counts = split_df.groupBy("split", spec.target).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return shares(counts)


def shares(counts: DataFrame) -> DataFrame:
    """Class share within each split, of a few rows of counts."""
    total = F.sum("n").over(Window.partitionBy("split"))
    return counts.withColumn("share", X.round_half_up(X.safe_ratio("n", total), 6))


def remaining_after(df: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Set difference on the key (F8): rows of ``df`` whose key is not in ``removed``."""
    return df.join(removed.select(key), key, "left_anti")


def kfold_assign(df: DataFrame, k: int = fixed.CV_FOLDS, spec: ColumnSpec = COHORT_SPEC,
                 seed: int = fixed.RANDOM_STATE, bucket_bits: int = 12, rank_col: str | None = None) -> DataFrame:
    """Stratified fold 0..k-1: within-class rank of ``md5(seed|kfold|id)`` mod k (M7).

    A NULL label is a class of its own; no row is lost.  ``rank_col`` keeps the rank as well.
    """
    h = hash60(F.lit(str(seed)), F.lit("kfold"), spec.id)
    ranked = ranked_within(df.withColumn("__h", h), [spec.target], ["__h", spec.id],
                           hash_bucket("__h", bucket_bits), rank_col="__rank", size_col=None)
    folded = ranked.withColumn("fold", (F.col("__rank") % k).cast("int")).drop("__h")
    return folded.withColumnRenamed("__rank", rank_col) if rank_col else folded.drop("__rank")
