"""Exact distributed ranks (used by the split, k-fold, SMOTE and ROC operators).

``row_number() over (partition by label)`` would put a whole class in one task
(two tasks for a binary label).  The two-level form used here:

1. every row gets an order key whose leading bits define a ``bucket``
   (hash prefix or score range), so ordering by key orders buckets too;
2. rows are counted per (group, bucket): a table of at most
   groups x ``n_buckets`` rows, partial-aggregated in every task;
3. a running sum over that small table gives each bucket's offset;
4. ``row_number`` runs per (group, bucket) — thousands of parallel tasks — and
   ``rank = offset + row_number - 1`` equals the global rank exactly.

A hot group (one label holding most rows) is spread over all of its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HASH_BITS = 60


def hash60(*parts: Column | str) -> Column:
    """First 60 bits of md5 over ``part|part|...`` as BIGINT (same in DuckDB)."""
    s = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string")
                          for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def hash_bucket(h: Column | str, bucket_bits: int = 12) -> Column:
    """Leading ``bucket_bits`` of a 60-bit hash: buckets in hash order."""
    h = F.col(h) if isinstance(h, str) else h
    return F.shiftright(h, HASH_BITS - bucket_bits).cast("int")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where a NULL key equals NULL, so a NULL group keeps its rows."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, same).drop(*[f"__r_{k}" for k in keys])


def ranked_within(df: DataFrame, group_cols: list[str], order_cols: list[Column | str],
                  bucket: Column, rank_col: str = "rank", size_col: str | None = "group_size"
                  ) -> DataFrame:
    """Add a 0-based exact rank within ``group_cols`` ordered by ``order_cols``.

    ``bucket`` must be non-decreasing in ``order_cols`` order.  Optionally adds
    the group size, taken from the same small count table.  NULL is a group of its own.
    """
    b = df.withColumn("__bucket", bucket)
    counts = b.groupBy(*group_cols, "__bucket").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*group_cols).orderBy("__bucket")
    offsets = counts.select(
        *group_cols, "__bucket",
        (F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__cnt"))
        .alias("__offset"),
        *([F.sum("__cnt").over(Window.partitionBy(*group_cols)).alias(size_col)]
          if size_col else []))
    # ``offsets`` has at most groups x buckets rows; AQE broadcasts it when its
    # runtime size is under the broadcast threshold, else it is shuffled.
    rn = F.row_number().over(Window.partitionBy(*group_cols, "__bucket").orderBy(*order_cols))
    return (_join_null_safe(b, offsets, [*group_cols, "__bucket"])
            .withColumn(rank_col, F.col("__offset") + rn - 1)
            .drop("__bucket", "__offset"))


def cumulative_within(df: DataFrame, group_cols: list[str], order_col: str, value_cols: list[str],
                      descending: bool = False, rows_per_part: int = 50_000) -> DataFrame:
    """``df`` with running totals along ``order_col`` (distinct values) within each group.

    Adds ``<v>_before`` (exclusive running sum) and ``<v>_next`` (the value of the next row, NULL at
    the end) for every value column.  Rows are dealt into ranges of (group, order) of equal size, as
    Spark samples them, so a skewed value distribution cannot fill one task; the part number is
    checkpointed with the rows.  Parts are joined to the running sum of their totals, and the
    window only runs inside a part.  ``df`` is read twice (a count and the deal): pass a checkpointed one.
    """
    parts = max(1, -(-df.count() // rows_per_part))
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    dealt = cut_lineage(df.repartitionByRange(parts, *group_cols, order)
                        .withColumn("__part", F.spark_partition_id()))
    first = F.max_by if descending else F.min_by
    totals = dealt.groupBy(*group_cols, "__part").agg(
        *[F.sum(v).alias(f"__t_{v}") for v in value_cols],
        *[first(v, order_col).alias(f"__f_{v}") for v in value_cols])
    by_part = Window.partitionBy(*group_cols).orderBy("__part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group_cols, "__part", *[c for v in value_cols for c in (
        F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}"),
        F.lead(f"__f_{v}").over(by_part).alias(f"__n_{v}"))])
    inside = Window.partitionBy(*group_cols, "__part").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = _join_null_safe(dealt, totals, [*group_cols, "__part"])
    return out.select(*df.columns, *[c for v in value_cols for c in (
        (F.col(f"__o_{v}") + F.coalesce(F.sum(v).over(upto), F.lit(0))).alias(f"{v}_before"),
        F.coalesce(F.lead(v).over(inside), F.col(f"__n_{v}")).alias(f"{v}_next"))])
