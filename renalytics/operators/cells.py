"""Scores of fitted tree pipelines, computed once per cell of their thresholds (M9).

A tree asks only which of its thresholds lie below a value, so rows between the same thresholds of every feature (a *cell*) get
the same score from every tree, and from what a stacked model makes of these.  A batch is scored by one row of each cell: the
work of the trees grows with the cells that the data fill, not with the rows.  Streams, and pipelines that use their features
otherwise, are scored row by row.
"""

from __future__ import annotations

import re
from math import prod

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = re.compile(r"If \(feature (\d+) (?:<= ([^)]+)\)|in )")
KEY_SIZE = 1 << 62  # cells that one BIGINT can tell apart


def thresholds(model: PipelineModel) -> dict[int, list[float]] | None:
    """Ascending thresholds by feature of a pipeline of an assembler and trees; None where features are used otherwise."""
    if not hasattr(model, "_thresholds"):
        model._thresholds = _thresholds(model)
    return model._thresholds


def _thresholds(model: PipelineModel) -> dict[int, list[float]] | None:
    first, *rest = model.stages
    if not hasattr(first, "getInputCols"):
        return None
    given, found = {*first.getInputCols(), first.getOutputCol()}, {}
    for stage in rest:
        if hasattr(stage, "trees"):
            for f, t in SPLIT.findall(stage.toDebugString):
                if not t:
                    return None  # a categorical split
                found.setdefault(int(f), set()).add(float(t))
        elif given & {stage.getOrDefault(p) if p.name != "inputCols" else None for p in stage.params if p.name in ("inputCol", "featuresCol")
                      and stage.hasDefault(p) | stage.isSet(p)} or given & {*(stage.getInputCols() if hasattr(stage, "getInputCols") else ())}:
            return None
    return {f: sorted(t) for f, t in found.items()}


def _place(x: Column, cuts: list[float]) -> Column:
    """0 for a missing value, else one more than the thresholds below it."""
    below = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < x)) if cuts else F.lit(0)
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(below + 1).cast("long")


def _keys(features: list[str], cuts: dict[int, list[float]]) -> list[Column]:
    """The cell of a row as few numbers."""
    groups: list[list[int]] = []
    for f in range(len(features)):
        if not groups or prod(len(cuts.get(i, [])) + 2 for i in [*groups[-1], f]) > KEY_SIZE:
            groups.append([])
        groups[-1].append(f)
    keys = []
    for group in groups:
        key = F.lit(0).cast("long")
        for f in group:
            key = key * F.lit(len(cuts.get(f, [])) + 2).cast("long") + _place(F.col(features[f]).cast("double"), cuts.get(f, []))
        keys.append(key)
    return keys


def _row_by_row(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    out, done = df, []
    for name, m in models.items():
        out = m.transform(out).select(*df.columns, *done, vector_to_array(F.col("probability"))[1].alias(name))
        done.append(name)
    return out


def with_probabilities(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """``df`` with the probability of class 1 by every model, in columns named by the keys of ``models``."""
    if df.isStreaming:
        return _row_by_row(df, models)
    orders = {tuple(m.stages[0].getInputCols()) if hasattr(m.stages[0], "getInputCols") else None for m in models.values()}
    found = [thresholds(m) for m in models.values()] if len(orders) == 1 else [None]
    if any(t is None for t in found):
        return _row_by_row(df, models)
    features = list(orders.pop())
    cuts = {f: sorted({c for t in found for c in t.get(f, [])}) for f in range(len(features))}
    keys = [f"__cell{i}" for i in range(len(_keys(features, cuts)))]
    coded = df.select("*", *[c.alias(k) for k, c in zip(keys, _keys(features, cuts), strict=True)])
    # A fixed number of parts: the cells are few bytes but much work, so they must not be coalesced by size.
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    cells = coded.groupBy(*keys).agg(*[F.first(c).alias(c) for c in features]).repartition(parts, *keys)
    scored = _row_by_row(cells, models).select(*keys, *models)
    return coded.join(scored, keys).select(*df.columns, *models)
