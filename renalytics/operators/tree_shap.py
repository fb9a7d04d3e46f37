"""Exact path-dependent tree attributions for Spark tree ensembles, as matrix products over the leaves.

Every leaf becomes one row: its weighted value ``v`` and, per feature, the interval ``(lo, hi]`` that its path leaves
open and the cover fraction ``z`` of the path's splits on that feature (whole line and 1 for features off the path).  For
``o_f = [lo_f < x_f <= hi_f]`` the Shapley value of feature i is::

    v (o_i - z_i) * sum over S of |S|! (d-|S|-1)! / d! * prod_S o * prod_rest z
  = v (o_i - z_i) * integral over t in [0, 1] of  prod_{j != i} (o_j t + z_j (1 - t))

The weights are a beta integral, and the integrand is a polynomial in t of a degree below the number of features on the
path, so Gauss-Legendre quadrature with half as many nodes is exact.

Two patients between the same thresholds of every feature lie in the same leaves, so each distinct *cell* (the number of
thresholds below each value) is attributed once: there are at most as many as the thresholds allow, however many rows.  For
a quadrature node the integrand is a product over features, hence ``A(x) B(x)`` with the features in two groups, and the sum
over all leaves of all trees is the matrix product of the A rows of distinct patterns of one group with the B rows of
the other.  Spark deals the cells by their A patterns; a task multiplies ``A_CHUNK`` patterns by ``LEAF_CHUNK`` leaves at a
time, and the leaves are broadcast (bounded by the model).

Boosted attributions are on the margin (``rawPrediction[1]``), random-forest ones on the class-1 probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

SMALL_GROUP = 256  # patterns that the thresholds of the second group of features allow
A_CHUNK = 512
LEAF_CHUNK = 2048


def _saved_nodes(spark: SparkSession, tree_model) -> DataFrame:
    """The model's node table with the value of each node and the weight of its tree."""
    path = shared_path(spark, "tree-model")
    tree_model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    stats = F.col("impurityStats")
    if "GBT" in type(tree_model).__name__:
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weight").select("treeID", "weight")
        value = F.col("prediction")
        nodes = nodes.join(F.broadcast(weights), "treeID")
    else:
        value = F.try_divide(F.element_at(stats, 2), F.aggregate(stats, F.lit(0.0), lambda a, b: a + b))
        nodes = nodes.withColumn("weight", F.lit(1.0 / tree_model.getNumTrees))
    return nodes.select("treeID", "id", (F.col("weight") * value).alias("value"), F.col("rawCount").cast("double").alias("cover"),
                        "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
                        F.try_element_at(F.col("split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"),
                        F.col("split.numCategories").alias("categories"))


def leaf_rows(spark: SparkSession, tree_model, n_features: int) -> list[tuple]:
    """(tree, value, [(lo, hi, z) per feature], features on the path) of every leaf; bounded by the model."""
    trees: dict[int, dict] = {}
    for r in _saved_nodes(spark, tree_model).where("feature < 0 OR categories < 0").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    open_path = ((-math.inf, math.inf, 1.0),) * n_features
    out = []
    for tree, nodes in trees.items():
        stack = [(0, open_path, frozenset())]
        while stack:
            i, path, used = stack.pop()
            node = nodes.get(i)
            if node is None:
                raise ValueError("categorical splits are not supported; use continuous features")
            if node["leftChild"] < 0:
                out.append((tree, node["value"], path, len(used)))
                continue
            f, t = node["feature"], node["threshold"]
            lo, hi, z = path[f]
            for child, bounds in ((node["leftChild"], (lo, min(hi, t))), (node["rightChild"], (max(lo, t), hi))):
                share = nodes[child]["cover"] / node["cover"] if child in nodes else 0.0
                if share <= 0:
                    raise ValueError("a node without training rows has no cover fraction")
                stack.append((child, path[:f] + ((*bounds, z * share),) + path[f + 1:], used | {f}))
    return out


def _place(x: Column, cuts: list[float]) -> Column:
    """How many cuts lie below a value; -1 for a missing one, which lies in no interval."""
    below = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < x))
    return F.when(x.isNull() | F.isnan(x) | (x == F.lit(-math.inf)), -1).otherwise(below)


def _groups(cuts: dict[int, list[float]]) -> tuple[list[int], list[int]]:
    """The features in two groups, the second of few patterns."""
    large, small, patterns = [], [], 1
    for f in sorted(cuts, key=lambda f: (len(cuts[f]), f)):
        patterns *= len(cuts[f]) + 1
        (small if patterns <= SMALL_GROUP else large).append(f)
    return large or [small.pop()], small


def _patterns(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the place of each row among them."""
    if not codes.shape[1]:
        return codes[:1], np.zeros(len(codes), np.int64)
    found, place = np.unique(codes, axis=0, return_inverse=True)
    return found, place.reshape(-1)


def cell_attributions(large: np.ndarray, small: np.ndarray, leaves: dict, points: list[tuple[float, float]]) -> np.ndarray:
    """(features, large patterns, small patterns) attributions, the features of the large group first.

    ``leaves`` has ``v`` (leaves) and ``first``, ``last``, ``z`` (leaves, features): the places that a leaf's interval covers.
    """
    k = large.shape[1]
    out = np.zeros((leaves["z"].shape[1], len(large), len(small)))
    for start in range(0, len(leaves["v"]), LEAF_CHUNK):
        part = {name: a[start:start + LEAF_CHUNK] for name, a in leaves.items()}

        def inside(patterns: np.ndarray, f: int, at: int, part=part) -> np.ndarray:
            place = patterns[:, f, None]
            return ((place >= part["first"][:, at]) & (place <= part["last"][:, at])).astype(float)

        sides = [[(inside(patterns, f, at + f), part["z"][:, at + f]) for f in range(patterns.shape[1])]
                 for patterns, at in ((large, 0), (small, k))]
        for t, w in points:
            whole, own = [], []
            for side, patterns, scale in zip(sides, (large, small), (1.0, part["v"] * w), strict=True):
                terms = [o * t + z * (1 - t) for o, z in side]
                product = np.broadcast_to(scale, (len(patterns), len(part["v"]))).copy()
                for term in terms:
                    product *= term
                whole.append(product)
                # each feature takes its own factor out of the whole product
                own.append([(o - z) * product / term for (o, z), term in zip(side, terms, strict=True)])
            for f, share in enumerate(own[0]):
                out[f] += share @ whole[1].T
            for f, share in enumerate(own[1]):
                out[k + f] += whole[0] @ share.T
    return out


def tree_attributions(df: DataFrame, model: PipelineModel, id_col: str = "patient_id",
                      stage: int = -1) -> tuple[DataFrame, float]:
    """Wide attributions ``(id, shap__<feature>..., <feature>...)``, and the baseline.

    A missing value lies in no interval.
    """
    spark = df.sparkSession
    feats = list(model.stages[0].getInputCols())
    leaves = leaf_rows(spark, model.stages[stage], len(feats))
    nodes, weights = np.polynomial.legendre.leggauss(max(1, -(-max(d for *_, d in leaves) // 2)))
    points = [((1 + float(x)) / 2, float(w) / 2) for x, w in zip(nodes, weights, strict=True)]
    baseline = math.fsum(v * math.prod(z for _, _, z in path) for _, v, path, _ in leaves)

    bounds = np.array([path for _, _, path, _ in leaves])  # (leaves, features, 3)
    used = [f for f in range(len(feats)) if (bounds[:, f, 2] < 1.0).any()] or [0]
    ends = {f: np.unique(bounds[:, f, :2]) for f in used}
    cuts = {f: e[np.isfinite(e)].tolist() for f, e in ends.items()}
    large, small = _groups(cuts)
    order = [*large, *small]
    table = spark.sparkContext.broadcast({
        "v": np.array([v for _, v, _, _ in leaves]), "z": bounds[:, order, 2].copy(),
        "first": np.stack([np.searchsorted(cuts[f], bounds[:, f, 0], side="right") for f in order], axis=1),
        "last": np.stack([np.searchsorted(cuts[f], bounds[:, f, 1], side="left") for f in order], axis=1)})

    values, places = [f"x{f}" for f in range(len(feats))], [f"c{f}" for f in order]
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(feats, values, strict=True)])
    rows = rows.select("*", *[_place(F.col(f"x{f}"), cuts[f]).alias(c) for f, c in zip(order, places, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            (wide, row_of_wide), (narrow, row_of_narrow) = map(_patterns, np.split(codes, [len(large)], axis=1))
            for start in range(0, len(wide), A_CHUNK):
                here = np.flatnonzero((row_of_wide >= start) & (row_of_wide < start + A_CHUNK))
                found = cell_attributions(wide[start:start + A_CHUNK], narrow, table.value, points)[
                    :, row_of_wide[here] - start, row_of_narrow[here]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in codes[here].T], *[pa.array(s) for s in found]],
                                                 names=[*[f"of_{c}" for c in places], *[f"s{f}" for f in order]])

    # A fixed number of parts: the cells are few bytes but much work, so they must not be coalesced by size.
    parts, dealt = 2 * spark.sparkContext.defaultParallelism, places[:len(large)]
    cells = rows.select(*places).distinct().repartition(parts, *dealt).sortWithinPartitions(*dealt)
    sums = cells.mapInArrow(run, ", ".join([*[f"of_{c} int" for c in places], *[f"s{f} double" for f in order]]))
    found = rows.join(sums, [F.col(c) == F.col(f"of_{c}") for c in places])
    return found.select(F.col("id").alias(id_col), *[(F.col(f"s{f}") if f in used else F.lit(0.0)).alias(f"shap__{c}") for f, c in enumerate(feats)],
                        *[F.col(x).alias(c) for c, x in zip(feats, values, strict=True)]), baseline


def expected_value(spark: SparkSession, model: PipelineModel, stage: int = -1) -> DataFrame:
    """Baseline as a one-row table, from an aggregate over the node table."""
    nodes = _saved_nodes(spark, model.stages[stage])
    root = nodes.where(F.col("id") == 0).select("treeID", F.col("cover").alias("root"))
    leaves = nodes.where(F.col("leftChild") < 0).join(root, "treeID")
    return leaves.agg(F.sum(F.col("value") * F.col("cover") / F.col("root")).alias("expected_value"))
