"""SMOTE oversampling as a Spark job.

Steps (all distributed):

1. class counts (a two-row aggregate) give the minority class, ``m`` and the
   number of synthetic rows ``int(ratio * n_majority) - m``;
2. minority rows get a dense index 0..m-1 by the two-level rank of
   ``md5(seed|smote|id)``;
3. identical minority vectors are collapsed (group id = smallest id), and the
   exact k-NN table is built on the distinct vectors (:mod:`.knn`);
4. synthetic ids come from ``spark.range`` (partitioned); three hashes per id
   pick the base row, the neighbour rank and the gap in [0, 1);
5. two equi-joins fetch base and neighbour, and every feature becomes
   ``x + gap * (neighbour - x)``.

A NULL or NaN feature in a minority row is refused with a count, as the feature
assembler does: it has no neighbours and could not be interpolated.

``smote_in_folds`` does the same for each fold of a cross-validation, from the rows outside that fold only, so no
synthetic row carries anything of the rows it is validated on.  All folds share one neighbour search.

0/1 columns are interpolated too (fractions), as the original does; pass
``binary_mode="vote"`` to round them instead.  If the ratio is already met no
rows are added (the usual library raises).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import cut_lineage
from .knn import knn_outside_folds, knn_table
from .rank import hash60, hash_bucket, ranked_within

TWO_60 = float(1 << 60)


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class; rows without a label belong to none."""
    return {r[label]: r["n"] for r in df.where(F.col(label).isNotNull())
            .groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def smote(train: DataFrame, cont: list[str], binary: list[str], label: str, id_col: str,
          ratio: float = fixed.SMOTE_RATIO, k: int = fixed.SMOTE_K, seed: int = fixed.RANDOM_STATE,
          binary_mode: str = "interpolate") -> DataFrame:
    """Synthetic minority rows ``(synthetic_id, features..., label)``."""
    spark = train.sparkSession
    feats = cont + binary
    counts = class_counts(train, label)  # at most a few labels: fitted stats
    if len(counts) < 2:
        return spark.createDataFrame([], train.select(F.lit(0).cast("long").alias("synthetic_id"),
                                                      *feats, label).schema)
    minority = min(counts, key=lambda c: (counts[c], c))
    majority_n = max(v for c, v in counts.items() if c != minority)
    m = counts[minority]
    n_syn = int(ratio * majority_n) - m
    mino = train.where(F.col(label) == minority).select(id_col, *[F.col(c).cast("double").alias(c)
                                                                  for c in feats])
    if n_syn <= 0 or m < 2:
        return spark.createDataFrame([], mino.select(F.lit(0).cast("long").alias("synthetic_id"),
                                                     *feats, F.lit(minority).alias(label)).schema)
    k_eff = min(k, m - 1)
    mino = cut_lineage(mino)  # read by the check, the index and the vectors
    _refuse_empty(mino, feats)

    # dense index over minority rows
    hcol = hash60(F.lit(str(seed)), F.lit("smote"), id_col)
    indexed = ranked_within(mino.withColumn("__h", hcol), [], ["__h", id_col],
                            hash_bucket("__h"), rank_col="idx", size_col=None).drop("__h")
    # distinct vectors (partial aggregation: a hot vector is one row)
    vectors = mino.groupBy(*feats).agg(F.min(id_col).alias("gid"), F.count(F.lit(1)).alias("mult"))
    vectors = cut_lineage(vectors)  # read by the search, the index and the features of neighbours
    indexed = indexed.join(vectors.select(*feats, "gid"), feats)
    knn = knn_table(vectors, cont, binary, k_eff)

    syn = spark.range(n_syn).withColumnRenamed("id", "synthetic_id")
    sid = F.col("synthetic_id")
    syn = syn.select(
        "synthetic_id",
        (F.pmod(hash60(F.lit(str(seed)), F.lit("smote"), sid, F.lit("base")), F.lit(m))).alias("idx"),
        (F.pmod(hash60(F.lit(str(seed)), F.lit("smote"), sid, F.lit("nn")), F.lit(k_eff)))
        .cast("int").alias("j"),
        (hash60(F.lit(str(seed)), F.lit("smote"), sid, F.lit("gap")).cast("double")
         / F.lit(TWO_60)).alias("gap"))
    base = syn.join(indexed.select("idx", "gid", *[F.col(c).alias(f"b_{c}") for c in feats]), "idx")
    with_nb = base.join(knn.select("gid", "j", "nb_gid"), ["gid", "j"])
    nbv = vectors.select(F.col("gid").alias("nb_gid"), *[F.col(c).alias(f"n_{c}") for c in feats])
    full = with_nb.join(nbv, "nb_gid")

    def value(c: str):
        v = F.col(f"b_{c}") + F.col("gap") * (F.col(f"n_{c}") - F.col(f"b_{c}"))
        if c in binary and binary_mode == "vote":
            v = F.round(v)
        return v.alias(c)

    return full.select("synthetic_id", *[value(c) for c in feats], F.lit(minority).alias(label))


def _refuse_empty(mino: DataFrame, feats: list[str]) -> None:
    empty = mino.where(" OR ".join(f"`{c}` IS NULL OR isnan(`{c}`)" for c in feats)).count()
    if empty:
        raise ValueError(f"{empty} minority rows have a NULL or NaN feature; impute them before oversampling")


def _of_fold(column: str, values: dict[int, int]) -> Column:
    """The value of the fold in ``column``; folds are few, so a chain of conditions."""
    chain = F.lit(None).cast("long")
    for f, v in values.items():
        chain = F.when(F.col(column) == f, F.lit(int(v)).cast("long")).otherwise(chain)
    return chain


def smote_in_folds(train: DataFrame, cont: list[str], binary: list[str], label: str, id_col: str,
                   n_folds: int = fixed.CV_FOLDS, fold: str = "fold", ratio: float = fixed.SMOTE_RATIO,
                   k: int = fixed.SMOTE_K, seed: int = fixed.RANDOM_STATE) -> DataFrame:
    """Synthetic minority rows per fold: ``(for_fold, synthetic_id, base_gid, nb_gid, features..., label)``.

    The rows of ``for_fold`` = f are for the fit that validates on fold f: base and neighbour are minority rows
    outside f, and their number lifts the minority outside f to ``ratio`` of the largest other class outside f.
    ``base_gid`` and ``nb_gid`` are the smallest ids of the two vectors.  Folds with fewer than two minority
    rows outside them, or with the ratio already met, get none.
    """
    spark = train.sparkSession
    feats = cont + binary
    sizes = {(r[label], r[fold]): r["n"] for r in train.where(F.col(label).isNotNull())
             .groupBy(label, fold).agg(F.count(F.lit(1)).alias("n")).collect()}  # classes x folds
    classes = sorted({c for c, _f in sizes})
    rows = {c: sum(n for (d, _f), n in sizes.items() if d == c) for c in classes}
    types = {f.name: f.dataType.simpleString() for f in train.schema.fields}
    empty = spark.createDataFrame([], f"for_fold int, synthetic_id long, base_gid {types[id_col]}, nb_gid {types[id_col]}, "
                                  + ", ".join(f"`{c}` double" for c in feats) + f", `{label}` {types[label]}")
    if len(classes) < 2:
        return empty
    minority = min(classes, key=lambda c: (rows[c], c))
    outside = {f: {c: rows[c] - sizes.get((c, f), 0) for c in classes} for f in range(n_folds)}
    m = {f: n[minority] for f, n in outside.items()}
    wanted = {f: int(ratio * max(v for c, v in n.items() if c != minority)) - m[f] for f, n in outside.items()}
    wanted = {f: n for f, n in wanted.items() if n > 0 and m[f] >= 2}
    if not wanted:
        return empty
    mino = train.where(F.col(label) == minority).select(id_col, fold, *[F.col(c).cast("double").alias(c) for c in feats])
    mino = cut_lineage(mino)  # read by the check, the index and the vectors
    _refuse_empty(mino, feats)

    out_cols = [f"out_{f}" for f in range(n_folds)]
    vectors = mino.groupBy(*feats).agg(F.min(id_col).alias("gid"), *[
        F.count_if(F.col(fold) != f).alias(c) for f, c in enumerate(out_cols)])
    vectors = cut_lineage(vectors)  # read by the search, the index and the features of both ends
    knn = knn_outside_folds(vectors, cont, binary, k, out_cols)

    hcol = hash60(F.lit(str(seed)), F.lit("smote"), id_col)
    per_fold = mino.join(vectors.select(*feats, "gid"), feats).withColumn("__h", hcol).withColumn(
        "for_fold", F.explode(F.array(*[F.lit(f) for f in wanted]))).where(F.col("for_fold") != F.col(fold))
    indexed = ranked_within(per_fold, ["for_fold"], ["__h", id_col], hash_bucket("__h"), rank_col="idx", size_col=None)

    ends, total = [], 0
    for f, n in wanted.items():
        total += n
        ends.append((f, total - n, total))
    place = F.lit(None).cast("int")
    start = F.lit(None).cast("long")
    for f, low, high in reversed(ends):
        place = F.when(F.col("id") < high, F.lit(f)).otherwise(place)
        start = F.when(F.col("id") < high, F.lit(low)).otherwise(start)
    syn = spark.range(total).select(place.alias("for_fold"), (F.col("id") - start).alias("synthetic_id"))

    def drawn(what: str) -> Column:
        return hash60(F.lit(str(seed)), F.lit("smote"), F.col("for_fold"), F.col("synthetic_id"), F.lit(what))

    syn = syn.select("for_fold", "synthetic_id", F.pmod(drawn("base"), _of_fold("for_fold", m)).alias("idx"),
                     F.pmod(drawn("nn"), _of_fold("for_fold", {f: min(k, m[f] - 1) for f in wanted})).cast("int").alias("j"),
                     (drawn("gap").cast("double") / F.lit(TWO_60)).alias("gap"))
    base = syn.join(indexed.select("for_fold", "idx", "gid", *[F.col(c).alias(f"b_{c}") for c in feats]), ["for_fold", "idx"])
    with_nb = base.join(knn.select("for_fold", "gid", "j", "nb_gid"), ["for_fold", "gid", "j"])
    full = with_nb.join(vectors.select(F.col("gid").alias("nb_gid"), *[F.col(c).alias(f"n_{c}") for c in feats]), "nb_gid")
    return full.select("for_fold", "synthetic_id", F.col("gid").alias("base_gid"), "nb_gid", *[
        (F.col(f"b_{c}") + F.col("gap") * (F.col(f"n_{c}") - F.col(f"b_{c}"))).alias(c) for c in feats],
        F.lit(minority).cast(types[label]).alias(label))


def oversample(train: DataFrame, synthetic: DataFrame, label: str) -> DataFrame:
    """Training rows plus synthetic rows, with an ``origin`` column."""
    cols = [c for c in synthetic.columns if c != "synthetic_id"]
    real = train.select(*cols, F.lit("real").alias("origin"))
    return real.unionByName(synthetic.select(*cols, F.lit("synthetic").alias("origin")))


def class_balance(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Rows per class before and after oversampling."""
    b = before.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("n")) \
              .withColumn("stage", F.lit("before"))
    a = after.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("n")) \
             .withColumn("stage", F.lit("after"))
    return b.unionByName(a).select("stage", label, "n")
