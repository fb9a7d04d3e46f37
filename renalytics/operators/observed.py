"""Counts taken while a table is written (B1, F4b, F7, F12), in batch and in each batch of a stream.

The counts are metrics observed on the rows as they pass to the sink, so they need no scan of their own.  They are taken
right before the write, with no shuffle behind them: a repeated task then counts once, as its rows are written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.spec import COHORT_SPEC, ColumnSpec
from .features import _encoders

ROWS = "rows"


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], mode: str = "errorifexists") -> dict[str, int]:
    """Write ``df`` as Parquet and return its ``rows`` and the named counts; an empty table counts 0."""
    names = list(counts)
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias(ROWS), *[counts[n].alias(f"c{i}") for i, n in enumerate(names)]]
    df.observe(seen, *metrics).write.mode(mode).parquet(path)
    got = seen.get
    return {ROWS: got.get(ROWS) or 0} | {n: got.get(f"c{i}") or 0 for i, n in enumerate(names)}


def null_counts(df: DataFrame) -> dict[str, Column]:
    """NULLs per column (B1)."""
    return {c: F.count_if(F.col(c).isNull()) for c in df.columns if c != ROWS}


def unmapped_counts(df: DataFrame, spec: ColumnSpec = COHORT_SPEC) -> dict[str, Column]:
    """Values outside the encoding per encoded column."""
    return {c: F.count_if(X.is_unmapped(c, m)) for c, m in _encoders(df, spec).items()}


def class_counts(label: str, classes: list, by: str | None = None, groups: list | None = None) -> dict[tuple, Column]:
    """Rows per (group, class) for known groups and classes, NULL among them if listed."""
    def holds(column: str, value) -> Column:
        return F.col(column).eqNullSafe(F.lit(value))

    return {(g, c): F.count_if((holds(by, g) if by else F.lit(True)) & holds(label, c))
            for g in (groups if by else [None]) for c in classes}
