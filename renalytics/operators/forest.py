"""Random forests over packed blocks (M4, M8).

The trees are those of Spark ML's ``RandomForestClassifier``: each row is drawn a Poisson(1) number of times per tree, each
node chooses among a random ceil(sqrt(n)) of the n features, a split is the best Gini gain with at least ``min_rows`` drawn
rows on each side, and sibling leaves that predict the same class are one leaf.  Other than there, a tree goes over the
distinct vectors of a block (:mod:`.boosting`) instead of all rows, and draws are hashes of row id, tree and seed, so a
retried task and another dealing of the rows give the same forest.  Thresholds are those of the whole training table.

Forests are grown in tasks of up to ``TASK_TREES`` trees, each over all blocks of the table.  The tasks return nodes in Spark
ML's saved form, or, for forests that only score held-out rows, sums over their trees by vector; the forests of all folds share
a tree's draws.  This is for tables that a task can hold (:func:`.boosting.in_task`); larger ones are left to Spark ML's own trainer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import shared_path
from . import boosting as B

TASK_TREES = 25
MIN_GAIN = 1e-12
POISSON = np.cumsum([exp(-1) / factorial(i) for i in range(18)])  # the last is 1


@dataclass(frozen=True)
class Forest:
    """One forest over the rows whose fold numbers avoid ``exclude``; held out as in :class:`.boosting.Fit`."""
    name: str
    exclude: tuple = ()
    trees: int = 300
    depth: int = 10
    min_rows: int = 2
    seed: int = 42


def _times() -> tuple[np.ndarray, np.ndarray]:
    """The hashes from which a row is drawn once more, and how often rows are drawn by the first 16 bits of their hash; 255 if these leave it open."""
    cuts = np.array([c for c in map(B._cut, POISSON[:-1]) if c < 1 << 64], np.uint64)
    first = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
    low, high = (np.searchsorted(cuts, h, side="right") for h in (first, first | np.uint64((1 << 48) - 1)))
    return cuts, np.where(low == high, low, 255).astype(np.uint8)


CUTS, TIMES = _times()


def times_drawn(ids: np.ndarray, seed: int, number: int) -> np.ndarray:
    """How often the rows of some ids are drawn for tree ``number``."""
    out = np.empty(len(ids), np.uint8)
    for a, h in B._hashed(ids, seed + 11, number):
        part = TIMES[h >> np.uint64(48)]
        left = np.flatnonzero(part == 255)
        part[left] = np.searchsorted(CUTS, h[left], side="right")
        out[a:a + len(h)] = part
    return out


def drawn(rows: B.Rows, fit: Forest, number: int) -> np.ndarray:
    """(vectors, 2): how often rows of each label are drawn for tree ``number``."""
    return rows.outside_sums(rows.drawn(("forest", fit.seed), number, lambda ids: times_drawn(ids, fit.seed, number)), fit.exclude)


def subsets(fit: Forest, number: int, level: int, n_features: int) -> np.ndarray:
    """(nodes of the level, features): which features each node may use."""
    k, share = 1 << level, n_features if fit.trees == 1 else ceil(sqrt(n_features))
    order = B._shares(np.arange(k * n_features, 2 * k * n_features), fit.seed + 13, number).reshape(k, n_features).argsort(axis=1)
    allowed = np.zeros((k, n_features), bool)
    np.put_along_axis(allowed, order[:, :share], True, axis=1)
    return allowed


def _impurity(positive, n):
    """Gini impurity times rows."""
    return 2 * positive * (n - positive) / np.maximum(n, 1)


def split_level(tree: B.Tree, fit: Forest, number: int, level: int, hist: np.ndarray) -> bool:
    """Split the nodes of a level by their histogram of positive and all rows; whether any was split."""
    k, (n_features, bins) = 1 << level, hist.shape[2:]
    total = hist[:, :, 0, :].sum(axis=2)
    if level == 0:
        tree.sums[1, ::2] = total[:, 0]
    left = np.cumsum(hist, axis=3)
    right = total[:, :, None, None] - left
    gain = (_impurity(*total)[:, None, None] - _impurity(*left) - _impurity(*right)) / np.maximum(total[1], 1)[:, None, None]
    fits = subsets(fit, number, level, n_features)[:, :, None] & (np.minimum(left[1], right[1]) >= max(1, fit.min_rows))
    gain = np.where(fits, gain, 0.0).reshape(k, -1)
    best = gain.argmax(axis=1)
    rows = np.flatnonzero(gain[np.arange(k), best] > MIN_GAIN)
    f, b, at = best[rows] // bins, best[rows] % bins, k + rows
    tree.feature[at], tree.bin[at], tree.gain[at] = f, b, gain[rows, best[rows]]
    tree.sums[2 * at, ::2] = left[:, rows, f, b].T
    tree.sums[2 * at + 1, ::2] = right[:, rows, f, b].T
    return len(rows) > 0


def prune(tree: B.Tree) -> None:
    """Sibling leaves that predict the same class become their parent."""
    positive, n = tree.sums[:, 0], tree.sums[:, 2]
    says = 2 * positive > n
    for level in reversed(range(tree.depth)):
        at = np.arange(1 << level, 2 << level)
        at = at[(tree.feature[at] >= 0) & (tree.feature[2 * at] < 0) & (tree.feature[2 * at + 1] < 0)]
        tree.feature[at[says[2 * at] == says[2 * at + 1]]] = -1
    tree.value = positive / np.maximum(n, 1)


def grow_tree(rows: B.Rows, fit: Forest, number: int) -> tuple[B.Tree, np.ndarray]:
    """Tree ``number`` and the leaf of each vector."""
    counts = drawn(rows, fit, number)
    at = np.flatnonzero(counts.any(axis=1))
    sums = counts[at, 1].astype(float), counts[at].sum(axis=1).astype(float)
    tree, node = B.Tree(fit.depth), np.ones(rows.vectors, np.int64)
    for level in range(fit.depth):
        hist = rows.histogram_below(hist, tree, node[at], level, at, sums) if level else rows.histogram(node[at], 0, at, sums)
        if not split_level(tree, fit, number, level, hist):
            break
        node = rows.below(tree, node, level)
    prune(tree)
    return tree, tree.leaves()[node]


def _nodes(number: int, tree: B.Tree, thresholds: list[list[float]]) -> list[dict]:
    """The tree in the order and form in which Spark ML saves nodes."""
    out: list = []

    def add(i: int) -> int:
        place = len(out)
        out.append(None)
        positive, n, f = tree.sums[i, 0], tree.sums[i, 2], tree.feature[i]
        data = {"id": place, "prediction": float(2 * positive > n), "impurity": _impurity(positive, n) / max(n, 1),
                "impurityStats": [n - positive, positive], "rawCount": int(n)}
        if f < 0:
            data |= {"gain": -1.0, "leftChild": -1, "rightChild": -1,
                     "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        else:
            data |= {"gain": tree.gain[i], "leftChild": add(2 * i), "rightChild": add(2 * i + 1), "split": {
                "featureIndex": int(f), "leftCategoriesOrThreshold": [thresholds[f][tree.bin[i]]], "numCategories": -1}}
        out[place] = {"treeID": number, "nodeData": data}
        return place

    add(1)
    return out


NODES_ARROW = pa.schema([("treeID", pa.int32()), ("nodeData", pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
    ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))]))])


def _in_tasks(table: DataFrame, trees: int, fits: list[Forest], thresholds: list[list[float]], grow, schema: str) -> DataFrame:
    """What ``grow(rows, numbers of trees, number of the task, [(block, places of its vectors)])`` gives in tasks that share out the trees."""
    tasks, n_features = B.tasks_of(table, trees, TASK_TREES), len(thresholds)
    bins, columns = max([len(t) for t in thresholds], default=0) + 1, {c for f in fits for c, _ in f.exclude}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in B.blocks_by_number(batches):
            names = [r["block"] for r in parts]
            whole, places = B.joined(parts, n_features, columns)
            del parts
            yield from grow(B.Rows(whole, n_features, bins), range(number, trees, tasks), number, list(zip(names, places, strict=True)))

    return B.dealt_tasks(table, tasks).mapInArrow(run, schema)


def nodes(table: DataFrame, fit: Forest, thresholds: list[list[float]]) -> DataFrame:
    """The nodes of a forest's trees over a table of blocks."""
    def grow(rows: B.Rows, numbers: range, _task: int, _blocks: list) -> Iterator[pa.RecordBatch]:
        for number in numbers:
            yield pa.RecordBatch.from_pylist(_nodes(number, grow_tree(rows, fit, number)[0], thresholds), NODES_ARROW)

    return _in_tasks(table, fit.trees, [fit], thresholds, grow, B.NODE)


def held_out(table: DataFrame, fits: list[Forest], thresholds: list[list[float]]) -> DataFrame:
    """(fit, row_id, label, probability) of the rows that each forest holds out, over a table of blocks."""
    def grow(rows: B.Rows, numbers: range, task: int, blocks: list) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(fits), rows.vectors))
        for number in numbers:
            for i, fit in enumerate(fits):
                if number < fit.trees:
                    tree, leaf = grow_tree(rows, fit, number)
                    totals[i] += tree.value[leaf]
        for block, at in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{f.name}" for f in fits]), pa.array([block] * len(fits), pa.int64()),
                                              pa.array([t[at].astype("<f8").tobytes() for t in totals], pa.binary())], names=["fit", "block", "margins"])

    trees = max(f.trees for f in fits)
    tasks, named = B.tasks_of(table, trees, TASK_TREES), dict(enumerate(fits))
    scores = _in_tasks(table, trees, fits, thresholds, grow, "fit string, block long, margins binary")
    # The sums of the tasks are columns of their own, so they are added in one order.
    rows = B.held_out_rows(table, scores, [(i, {f"t{t}": B.Fit(f"{t}-{f.name}", f.exclude) for t in range(tasks)}) for i, f in named.items() if f.exclude])
    fit_of, share = (F.create_map(*[F.lit(x) for i, f in named.items() for x in (i, v(f))])[F.col("line")] for v in (lambda f: f.name, lambda f: f.trees))
    return rows.select(fit_of.alias("fit"), "row_id", "label", (X.add_all([F.col(f"t{t}") for t in range(tasks)]) / share).alias("probability"))


def as_spark_model(nodes: DataFrame, fit: Forest, n_features: int, label: str = "label", features: str = "features") -> RandomForestClassificationModel:
    """The nodes of a forest as Spark ML's model, by way of its saved form; tasks write the nodes."""
    spark, path = nodes.sparkSession, shared_path(nodes.sparkSession, f"forest-{fit.name}")
    common = {"featuresCol": features, "labelCol": label, "maxDepth": fit.depth, "minInstancesPerNode": fit.min_rows, "seed": fit.seed}
    defaults = {"cacheNodeIds": False, "checkpointInterval": 10, "impurity": "gini", "leafCol": "", "maxBins": B.MAX_BINS, "maxMemoryInMB": 256,
                "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0, "predictionCol": "prediction", "probabilityCol": "probability",
                "rawPredictionCol": "rawPrediction"}

    def described(kind: str, uid: str, params: dict, more: dict, extra: dict) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
                           "paramMap": params, "defaultParamMap": defaults | more} | extra)

    whole = described("RandomForestClassificationModel", f"forest_{fit.name}", common | {"numTrees": fit.trees},
                      {"bootstrap": True, "featureSubsetStrategy": "auto", "subsamplingRate": 1.0},
                      {"numFeatures": n_features, "numClasses": 2, "numTrees": fit.trees})
    each = [(t, described("DecisionTreeClassificationModel", f"tree_{t}", common, {}, {}), 1.0) for t in range(fit.trees)]
    nodes.write.parquet(f"{path}/data")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)
