"""Mixing sources to target weights by temperature (operator 5).

A source with share p of all tokens gets weight p**a / sum(p**a).  The exponent a is 1 for the natural mix and
0 for equal weights; it is bisected to the largest one whose weights reach a target entropy, and from there
to the smallest change that keeps the repetition limit: how often the most repeated source is read while
the least repeated is read once.

The weights are realised over a token budget.  Each source is read in epochs; each epoch is a permutation
of its own, by the hash of the document and the epoch.  Within a source, documents get their place in
tokens from the totals of hash-range buckets and a running sum inside the bucket, so a source with a third
of all rows is many small partitions.  Block number n of the mix holds, from every source, the documents
that begin in the n-th stretch of weight x block tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from renalytics.llm.common import free_name
from renalytics.llm.syncmers import words
from renalytics.session import cut_lineage, shared_path

BLOCK_TOKENS = 200_000
BUCKET_ROWS = 1000   # rows of an epoch of a source that one partition sums up
HALVINGS = 40
STEPS = 4            # halvings that one job settles


def token_count(text: Column) -> Column:
    """Blank-separated words of a text and one end mark; null and empty texts count the mark."""
    return (F.size(words(F.coalesce(text, F.lit("")))) + 1).cast("long")


def _bisect(reaches, low: float, high: float) -> float:
    """Largest exponent in [low, high] for which ``reaches`` holds, given that it holds below and not above.

    ``reaches`` takes several exponents at once, so a job settles several halvings.
    """
    inner = 2 ** STEPS - 1
    for _ in range(HALVINGS // STEPS):
        points = [low + (high - low) * i / (inner + 1) for i in range(1, inner + 1)]
        held = reaches(points)
        last = sum(held)  # holds for the first ones
        low, high = ([low] + points)[last], (points + [high])[last]
    return low


def exponent(sources: DataFrame, target_entropy: float | None, max_epochs: float | None) -> float:
    """The temperature exponent for a table with one row per source and its ``tokens``.

    ``target_entropy`` is a share (0 to 1) of the entropy of equal weights.  Where both are given and
    disagree, the repetition limit wins.
    """
    total = sources.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    if not total[0] or total[3] < 2:
        return 1.0
    share = F.col("tokens") / F.lit(total[0])
    found = 1.0
    if target_entropy is not None:
        target = target_entropy * math.log(total[3])

        def entropies(points: list[float]) -> list[float]:
            sums = [c for a in points for c in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]
            row = sources.agg(*sums).first()
            return [math.log(row[2 * i]) - a * row[2 * i + 1] / row[2 * i] for i, a in enumerate(points)]

        if entropies([1.0])[0] < target:
            found = _bisect(lambda points: [h >= target for h in entropies(points)], 0.0, 1.0)
    if max_epochs is not None:
        spread = math.log(total[2] / total[1])
        if (1 - found) * spread > math.log(max_epochs):
            # Repetition falls as the exponent grows: mirror it so that the condition holds from below.
            mirrored = _bisect(lambda points: [(1 - (1 - x)) * spread <= math.log(max_epochs) for x in points],
                               0.0, 1 - found)
            found = 1 - mirrored
    return found


def weights(docs: DataFrame, source_col: str = "source", tokens: Column | None = None,
            target_entropy: float | None = None, max_epochs: float | None = None,
            total_tokens: int | None = None) -> DataFrame:
    """One row per source: source, docs, tokens, share, weight, epochs.

    ``epochs`` is how often the source is read within ``total_tokens``; the default budget is the smallest
    one that reads every source once, so that no document is left out.
    """
    tokens = token_count(F.col("text")) if tokens is None else tokens
    sources = cut_lineage(docs.select(F.col(source_col).alias("source"), tokens.alias("tokens")).groupBy("source")
                          .agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")))
    a = exponent(sources, target_entropy, max_epochs)
    raised = sources.withColumn("raised", F.pow(F.col("tokens").cast("double"), F.lit(a)))
    row = raised.agg(F.sum("tokens"), F.sum("raised"), F.max(F.col("tokens") / F.col("raised"))).first()
    everything, norm, thickest = row[0] or 0, row[1] or 1.0, row[2] or 1.0
    budget = float(total_tokens) if total_tokens is not None else thickest * norm
    return raised.select("source", "docs", "tokens", (F.col("tokens") / F.lit(float(max(1, everything)))).alias("share"),
                         (F.col("raised") / F.lit(norm)).alias("weight"),
                         F.round(F.col("raised") / F.lit(norm) * F.lit(budget) / F.col("tokens"), 9).alias("epochs"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        target_entropy: float | None = 0.9, max_epochs: float | None = 4.0, total_tokens: int | None = None,
        block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` as often as the mix reads them, plus epoch, n_tokens, start and block.

    ``epoch`` counts from 0; ``start`` is the row's place in tokens within its source, all epochs before it
    included; ``block`` is the block of the mix that it falls into.  Documents of a last, partial epoch are
    taken while they begin before its end.  A null source is a source; null texts and empty ones have one
    token; a null id is a document; repeated rows are documents of their own, with places in an arbitrary
    order among themselves; an empty table gives an empty one.  Input columns named like the added ones
    are replaced.
    """
    spark = docs.sparkSession
    added = ("epoch", "n_tokens", "start", "block")
    keep = [c for c in docs.columns if c.lower() not in added]
    source, key, order, bucket, rows, before, epochs, tokens, weight = (free_name(docs, c) for c in (
        "mix_source", "mix_key", "mix_order", "mix_bucket", "mix_rows", "mix_before", "mix_epochs", "mix_tokens", "mix_weight"))
    # A null source is a key of its own, so that joins and windows share one partitioning.
    named = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    base = docs.select(*keep, named.alias(source), token_count(F.col(text_col)).alias("n_tokens"))
    place = shared_path(spark, "mix-weights")
    weights(base, source, F.col("n_tokens"), target_entropy, max_epochs, total_tokens).write.parquet(place)
    # Written, so that Spark knows its size when it chooses how to join.
    table = spark.read.parquet(place).select(
        F.col("source").alias(key), F.col("docs").alias(rows), F.col("tokens").alias(tokens),
        F.col("weight").alias(weight), F.col("epochs").alias(epochs))
    joined = base.join(table, F.col(source) == F.col(key))
    read = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(epochs).cast("int") - 1))))
    read = read.withColumn(order, F.xxhash64(F.col(id_col), "epoch", F.lit(seed)))
    buckets = F.ceil(F.col(rows) / BUCKET_ROWS)
    read = read.withColumn(bucket, F.floor((F.shiftright(order, 11) / F.lit(float(1 << 53)) + 0.5) * buckets).cast("long"))
    dealt = [source, "epoch", bucket]
    totals = read.groupBy(*dealt).agg(F.sum("n_tokens").alias("sum"))
    earlier = Window.partitionBy(source, "epoch").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"{c}_of") for c in dealt], F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias(before))
    same = ((F.col(f"{source}_of") == F.col(source)) & (F.col("epoch_of") == F.col("epoch"))
            & (F.col(f"{bucket}_of") == F.col(bucket)))
    within = Window.partitionBy(*dealt).orderBy(order, id_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(totals, same)
    begins = F.col(before) + F.col("own")
    taken = placed.where(begins < (F.col(epochs) - F.col("epoch")) * F.col(tokens))
    start = F.col("epoch") * F.col(tokens) + begins
    return taken.select(*keep, "epoch", "n_tokens", start.alias("start"),
                        F.floor(start / (F.col(weight) * block_tokens)).alias("block"))


def slots(mixed: DataFrame, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """``mixed`` with ``slot``, the row's place in the permutation of its block, from 0."""
    order = F.xxhash64(F.col(id_col), "epoch", "block", F.lit(seed + 1))
    return mixed.withColumn("slot", F.row_number().over(Window.partitionBy("block").orderBy(order, id_col, "epoch")) - 1)
