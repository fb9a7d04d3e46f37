"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return df.select(*columns) if columns else df


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def tokenizer_path(tokenizer: str) -> str:
    """Place of a public tokenizer file; a path to a file passes through."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers
    return public_tokenizers.path(tokenizer)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, so that working columns never clash."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def labelled_sample(docs: DataFrame, labels_df: DataFrame, label_col: str, max_rows: int,
                    keep: Column | None = None) -> DataFrame:
    """About ``max_rows`` documents with a 0/1 label: ``docs`` rows plus ``label`` double.

    The rows are those whose xxhash64 of doc_id falls below the share that ``max_rows`` is
    of all labelled ids, so the choice does not depend on partitions.  A document with
    several labels takes the largest.  The sample's ids are broadcast: ``max_rows`` bounds them.
    """
    lab = (labels_df.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
           .where(keep if keep is not None else F.lit(True))
           .groupBy("doc_id").agg(F.max(F.col(label_col).cast("double")).alias("label")))
    n = lab.count()
    share = min(1.0, max_rows / max(n, 1))
    if share < 1.0:
        lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.join(F.broadcast(lab), "doc_id")


def fit_on_sample(sample: DataFrame, fit, *columns: str) -> object:
    """``fit(*lists)`` over the named columns of a bounded sample, run in one task; the returned model.

    The caller bounds the sample; the model comes back pickled, so it must be small.
    """
    import pickle

    import pyarrow as pa

    def run(batches):
        lists: list[list] = [[] for _ in columns]
        for batch in batches:
            for values, column in zip(lists, batch.columns, strict=True):
                values.extend(column.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(*lists))], pa.binary())], names=["model"])

    # One row in ascending order of text, so that the fit does not depend on partitions.
    ordered = sample.select(*columns).repartition(1).sortWithinPartitions(*columns)
    row = ordered.mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row is not None else fit(*([] for _ in columns))


def scored_columns(docs: DataFrame, score, columns: list[str], added: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus what ``score(model inputs of a batch)`` returns per row.

    ``score`` gets one list per name in ``columns`` and returns Arrow arrays for the schema ``added``.
    A kept column with the name of an added one is replaced.
    """
    import pyarrow as pa

    names = [a.split()[0] for a in added.split(", ")]
    keep = [c for c in keep if c.lower() not in names]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    inner = [f"_keep{keep.index(c)}" if c in keep else f"_in{i}" for i, c in enumerate(columns)]

    texts = [n for c, n in zip(columns, inner, strict=True) if types.get(c) == "string"]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, texts)):
            made = score(*(batch.column(c).to_pylist() for c in inner))
            yield pa.RecordBatch.from_arrays([batch.column(f"_keep{i}") for i in range(len(keep))] + made,
                                             names=[*keep, *names])

    narrow = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
                         *[F.col(c).alias(n) for c, n in zip(columns, inner, strict=True) if c not in keep])
    return narrow.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + [added]))


def slices(batch, columns: list[str], most_bytes: int = 2_000_000):
    """Parts of an Arrow batch whose texts in ``columns`` take about ``most_bytes``; one row at least.

    Python copies of a part are made one part at a time, which bounds a worker's memory.
    """
    import numpy as np
    import pyarrow.compute as pc

    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        size += np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0))
    part = np.cumsum(size) // most_bytes
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
