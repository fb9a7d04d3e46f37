"""Exact k nearest neighbours without emitting all pairs.

Input: one row per *distinct* feature vector with its multiplicity ``mult``
(identical rows collapsed first, so a vector shared by a third of the rows is
one row).  Features are split into continuous columns and 0/1 columns.

Search rounds with a doubling radius R (driver loop over a shrinking set, as
any iterative Spark algorithm):

* grid cells of width R in the continuous dimensions, plus the 0/1 pattern;
* every unresolved vector probes the 3^c neighbouring cells and the 0/1
  patterns within Hamming distance R^2 (a tiny pattern-pair table of 4^b
  rows); c and b count at most the three widest continuous and the first six
  0/1 columns, the others only enter the distance;
* every vector within distance R is found this way, so a vector whose
  candidates within R already hold k neighbours (counting multiplicities and
  its own copies) has its exact k nearest; the others go to the next round;
* once R covers the data's diameter every vector is resolved.

Ties are ordered by (squared distance rounded to 9 dp, neighbour group id).
Work per round is bounded by the neighbourhoods, never by n^2.

:func:`knn_outside_folds` finds the k nearest outside each fold in the same search: a neighbour
whose copies all lie in one fold serves every other fold, any other neighbour serves all, so the
k nearest of each such kind hold the k nearest outside every fold.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import cut_lineage

GRID_COLUMNS = 3     # continuous columns that form grid cells: 27 neighbouring cells
PATTERN_COLUMNS = 6  # 0/1 columns that form patterns: 4096 pairs


def _pattern(binary: list[str]):
    if not binary:
        return F.lit(0)
    return X.add_all([F.col(b).cast("int") * F.lit(1 << i) for i, b in enumerate(binary)])


def _d2(a: str, b: str, cols: list[str]):
    return X.add_all([(F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}"))
                      for c in cols])


def knn_table(points: DataFrame, cont: list[str], binary: list[str], k: int,
              gid: str = "gid", mult: str = "mult", max_cell: int = 4096) -> DataFrame:
    """``(gid, j, nb_gid, d2)``: the j-th (0-based) nearest neighbour of each vector.

    Neighbours are expanded by multiplicity (a vector with 3 copies can fill 3
    ranks; a vector's own other copies come first at distance 0).  ``k`` is
    capped at ``total rows - 1`` (the usual library raises instead).
    """
    found, pts, need = _search(points, cont, binary, k, gid, [mult], None, max_cell)
    if found is None:
        return points.sparkSession.createDataFrame([], f"{gid} long, j int, nb_gid long, d2 double")
    return _expanded(found, pts, gid, mult, need[mult])


def knn_outside_folds(points: DataFrame, cont: list[str], binary: list[str], k: int, outside: list[str],
                      gid: str = "gid", max_cell: int = 4096) -> DataFrame:
    """``(for_fold, gid, j, nb_gid, d2)``: nearest neighbours among the rows outside each fold, from one search.

    ``outside`` names one column per fold: the copies of the vector outside that fold.  Vectors
    without a copy outside a fold have no list for it; ``k`` is capped at that fold's rows - 1.
    """
    total = F.greatest(*[F.col(c) for c in outside]) if len(outside) > 1 else F.col(outside[0])
    sole = F.lit(-1)  # the one fold that holds all copies, if any
    for f, c in enumerate(outside):
        sole = F.when(F.col(c) == 0, F.lit(f)).otherwise(sole)
    found, pts, need = _search(points.where(total > 0), cont, binary, k, gid, outside, sole, max_cell)
    schema = f"for_fold int, {gid} long, j int, nb_gid long, d2 double"
    out = points.sparkSession.createDataFrame([], schema)
    if found is None:
        return out
    for f, c in enumerate(outside):
        if need[c] > 0:
            out = out.unionByName(_expanded(found, pts, gid, c, need[c]).withColumn("for_fold", F.lit(f)))
    return out


def _search(points: DataFrame, cont: list[str], binary: list[str], k: int, gid: str, mults: list[str],
            kind: Column | None, max_cell: int):
    """Candidates that hold the nearest neighbours under every multiplicity column, the vectors, and k per column."""
    spark = points.sparkSession
    feats = cont + binary
    pats = binary[:PATTERN_COLUMNS]
    kind = F.lit(0) if kind is None else kind
    pts = points.select(gid, *mults, *[F.col(c).cast("double").alias(c) for c in feats],
                        _pattern(pats).alias("pat"), kind.alias("kind"))
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(f"rows_{m}") for m in mults]]
    for c in cont:
        aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    st = pts.agg(*aggs).first()  # fitted bounds: one small job
    need = {m: max(0, int(min(k, (st[f"rows_{m}"] or 0) - 1))) for m in mults}
    k_eff = max(need.values())
    if k_eff <= 0:
        return None, None, need
    ranges = [float(st[f"hi_{c}"] - st[f"lo_{c}"]) for c in cont]
    # the widest columns form the grid; the others only enter the distance, which stays exact
    axes = sorted(cont, key=lambda c: -ranges[cont.index(c)])[:GRID_COLUMNS]
    diameter2 = sum(r * r for r in ranges) + len(binary)
    spread = max(ranges) if ranges and max(ranges) > 0 else 1.0
    radius = max(spread * math.sqrt(k_eff / max(st["n"], 1)), 1e-6)

    nb = len(pats)
    pair_rows = [(p, q, bin(p ^ q).count("1")) for p in range(1 << nb) for q in range(1 << nb)]
    pattern_pairs = spark.createDataFrame(pair_rows, "pat int, q int, ham int")
    offsets = F.array(*[F.array(*[F.lit(o) for o in combo])
                        for combo in itertools.product((-1, 0, 1), repeat=len(axes))])

    pts = cut_lineage(pts)  # input vectors: read by every round
    # Dense regions: shrink the starting radius until no grid cell holds more
    # than ``max_cell`` distinct vectors, so no cell yields a quadratic burst of
    # pairs (counting job only; dense vectors then resolve in the first rounds).
    while axes and radius > spread * 1e-9:
        cells = [F.floor(F.col(c) / F.lit(radius)) for c in axes]
        occ = pts.groupBy(*cells, "pat").count().agg(F.max("count")).first()[0]
        if occ is None or occ <= max_cell:
            break
        radius /= 4.0
    unresolved = pts
    held = [f"h_{m}" for m in mults]
    parts: list[DataFrame] = []
    while True:  # the radius doubles, so some round covers the diameter and is the last
        last = radius * radius >= diameter2
        r2 = radius * radius
        cell = [F.floor(F.col(c) / F.lit(radius)).cast("long") for c in axes]
        grid = pts.select(F.col(gid).alias("h"), *[F.col(m).alias(f"h_{m}") for m in mults], "kind",
                          *[F.col(c).alias(f"h_{c}") for c in feats],
                          F.col("pat").alias("q"), *[v.alias(f"cell{i}") for i, v in enumerate(cell)])
        probes = (unresolved.select(gid, "pat", *[F.col(c).alias(f"g_{c}") for c in feats],
                                    *[v.alias(f"c{i}") for i, v in enumerate(cell)],
                                    F.explode(offsets).alias("off"))
                  .select("*", *[(F.col(f"c{i}") + F.col("off")[i]).alias(f"cell{i}")
                                 for i in range(len(axes))])
                  .join(F.broadcast(pattern_pairs.where(F.col("ham") <= F.lit(r2))), "pat"))
        cand = (probes.join(grid, [f"cell{i}" for i in range(len(axes))] + ["q"])
                .where(F.col("h") != F.col(gid))
                .select(gid, "h", *held, "kind", _d2("g_", "h_", feats).alias("d2raw"))
                .where(F.col("d2raw") <= F.lit(r2))
                .select(gid, "h", *held, "kind", X.round_half_up("d2raw", 9).alias("d2")))
        # Only the k nearest of each vector (and kind) are kept: the rank limit runs inside the tasks that join,
        # before the shuffle, and again after it.  They tell as well whether k lie within the radius.
        nearest = Window.partitionBy(gid, "kind").orderBy("d2", "h")
        cand = cut_lineage(cand.withColumn("at", F.row_number().over(nearest))
                           .where(F.col("at") <= k_eff).drop("at", "kind"))
        if last:
            parts.append(cand)
            break
        have = cand.groupBy(gid).agg(*[F.sum(f"h_{m}").alias(f"within_{m}") for m in mults])
        enough = [(F.col(m) == 0) | ((F.coalesce(f"within_{m}", F.lit(0)) + F.col(m) - 1) >= need[m]) for m in mults]
        status = cut_lineage(                          # one small row per unresolved vector
            unresolved.select(gid, *mults).join(have, gid, "left").select(
                gid, reduce(lambda a, b: a & b, enough).alias("done")))
        parts.append(cand.join(status.where("done").select(gid), gid, "left_semi"))
        pending = status.where(~F.col("done")).select(gid)
        if pending.isEmpty():
            break
        unresolved = pts.join(pending, gid, "left_semi")
        radius *= 2.0
    return reduce(DataFrame.unionByName, parts), pts, need


def _expanded(found: DataFrame, pts: DataFrame, gid: str, mult: str, k: int) -> DataFrame:
    """The k nearest rows of each vector under one multiplicity column, one row per rank."""
    own = pts.where(F.col(mult) > 1).select(gid, F.col(gid).alias("h"),
                                            (F.col(mult) - 1).alias("copies"), F.lit(0.0).alias("d2"))
    bases = pts.where(F.col(mult) > 0).select(gid)
    others = found.where(F.col(f"h_{mult}") > 0).select(gid, "h", F.col(f"h_{mult}").alias("copies"), "d2")
    allc = others.join(bases, gid, "left_semi").unionByName(own)
    w = Window.partitionBy(gid).orderBy("d2", "h").rowsBetween(Window.unboundedPreceding, 0)
    ranked = allc.select("*", (F.sum("copies").over(w) - F.col("copies")).alias("before"))
    kept = ranked.where(F.col("before") < k)
    return kept.select(gid, F.explode(F.sequence(F.col("before").cast("int"),
                                                 F.least(F.col("before") + F.col("copies"),
                                                         F.lit(k)).cast("int") - 1)).alias("j"),
                       F.col("h").alias("nb_gid"), "d2")
