"""Boosted trees for many fits at once, from shared gradient histograms (M1-M3, M5, M8).

Cross-validation and stacking need the same three classifiers on many subsets of one training table: out-of-fold fits,
folds of the recall estimate, inner folds of the stacked model.  All of them run over one table of *blocks*: packed
rows of bin codes (at most ``MAX_BINS`` per feature), label, fold numbers and row ids.  A level of all trees of all fits
is one aggregate: every block adds up first and second derivatives per (fit, node, feature, bin), the sums of the blocks
are merged per fit, and the best split of each node comes out of the merged histogram.  Only splits reach the
driver; they are bounded by the models.

Rows of a block with the same bin codes have the same margin in every fit, so a block keeps each distinct vector of codes
once; margins, nodes and histograms go by vectors, weighted with the rows of each label that teach the tree.  Where no two
rows are alike there are as many vectors as rows.

* Up to ``TASK_ROWS`` rows and ``TASK_VECTORS`` vectors (some 1 GB of memory of a task): a task joins all blocks to one, so its histogram is
  the whole histogram and nothing needs merging.  It grows several fits tree by tree, and rows are drawn once for those of
  one seed; the tasks run in parallel.
* Larger tables: two stages per tree level for all fits together.  The running margins stay with the blocks; they are
  persisted after every tree and checkpointed every ``CHECKPOINT_ROUNDS`` trees.

Both use the same functions and give the same trees: derivatives are rounded to 2^-20 and summed as whole numbers, so
the sums depend neither on the blocks nor on their order, and rows and features are sampled by hashes of row id, tree
and seed.  A retried task does the same work again.

Splits maximise ``S(GL, HL) + S(GR, HR) - S(G, H)`` with ``S = T(G)^2 / (H + l2)`` and ``T`` the soft threshold at l1; a
leaf gives ``-step T(G) / (H + l2)``.  ``symmetric`` fits use one split for all nodes of a level; ``max_leaves`` keeps the
splits that best-first growth would have made.  Margins start at the log odds of the fit's rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_path

MAX_BINS = 32
BLOCK_ROWS = 100_000        # rows of each of several blocks
ONE_BLOCK_ROWS = 2_000_000  # up to so many rows the table is one block
TASK_ROWS = 20_000_000      # a task holds up to so many rows (ids and cells) ...
TASK_VECTORS = 2_000_000    # ... and so many vectors, summed over the blocks
TASK_FITS = 8               # fits that grow in one task, where there are more than cores
CHECKPOINT_ROUNDS = 10
UNIT = float(1 << 20)
MIN_GAIN = 1e-9
NO_ID = -(1 << 63)          # stands for a NULL row id in a block
JOINT_BINS = 1024           # features with so few bins in all are counted in one pass


@dataclass(frozen=True)
class Fit:
    """One boosted classifier over the rows whose fold numbers avoid ``exclude`` ((fold column, value), ...).

    Held out are the rows that only the last exclusion removes; they are scored at the end.
    """
    name: str
    exclude: tuple = ()
    rounds: int = 300
    step: float = 0.05
    depth: int = 6
    min_rows: int = 1
    min_weight: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    max_leaves: int | None = None
    symmetric: bool = False
    seed: int = 42


@dataclass
class Tree:
    """A tree as a heap: node i has the children 2i and 2i + 1; ``feature`` is -1 at leaves and unused places."""
    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    sums: np.ndarray = field(init=False)    # (G, H, N) of each node
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        size = 2 << self.depth
        self.feature, self.bin = np.full(size, -1), np.zeros(size, np.int64)
        self.gain, self.sums, self.value = np.zeros(size), np.zeros((size, 3)), np.zeros(size)

    def place(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` levels."""
        node, rows = np.ones(len(codes), np.int64), np.arange(len(codes))
        for _ in range(levels):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + (codes[rows, f] > self.bin[node]), node)
        return node

    def leaves(self) -> np.ndarray:
        """The leaf that each node lies in or below."""
        leaf = np.arange(len(self.feature))
        for level in range(1, self.depth + 1):
            nodes = np.arange(1 << level, 2 << level)
            above = leaf[nodes >> 1]
            leaf[nodes] = np.where(self.feature[above] < 0, above, nodes)
        return leaf


# ---- bins and blocks ------------------------------------------------------------------------------------

def fit_bins(df: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[list[float]]:
    """Ascending thresholds per feature: quantiles of its values, at most ``max_bins`` - 1 of them (one aggregate)."""
    points = [i / max_bins for i in range(max_bins + 1)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), points, 10_000).alias(c) for c in features]).first()
    return [sorted(set(row[c] or []))[:-1][:max_bins - 1] for c in features]


BLOCK = "block long, n int, vectors int, codes binary, cell binary, folds binary, fold_group binary, row_id binary"
BLOCK_KINDS = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5)


def _distinct(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a table of small whole numbers from -1 on, and the place of each row among them."""
    first, place = np.zeros(min(1, len(table)), np.int64), np.zeros(len(table), np.int64)
    for column in table.T.astype(np.int64):
        _, first, place = np.unique(place * 512 + column + 1, return_index=True, return_inverse=True)
    return table[first], place


def blocks(df: DataFrame, features: list[str], thresholds: list[list[float]], label: str, folds: list[str], row_id: str,
           rows: int | None = None) -> DataFrame:
    """``df`` as packed blocks of at most ``rows`` rows, written to shared storage.

    By default a table of up to ``ONE_BLOCK_ROWS`` rows is one block, a larger one has blocks of ``BLOCK_ROWS``.  Rows are
    dealt by ranges of their codes, so that rows with the same codes meet in a block.
    """
    n = df.count()
    rows = rows or (ONE_BLOCK_ROWS if n <= ONE_BLOCK_ROWS else BLOCK_ROWS)
    wanted = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("int").alias("y"),
                       *[F.col(c).cast("int").alias(f"f{i}") for i, c in enumerate(folds)], F.coalesce(F.col(row_id).cast("long"), F.lit(NO_ID)).alias("id"))
    coded = [f"x{i}" for i in range(len(features))]
    kept = ["y", *(f"f{i}" for i in range(len(folds))), "id"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = dict(zip(batch.schema.names, batch.columns, strict=True))
            codes = [np.searchsorted(t, at[c].to_numpy(zero_copy_only=False), side="left").astype(np.int16) for c, t in zip(coded, thresholds, strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, codes), *[at[c] for c in kept]], names=[*coded, *kept])

    wanted = wanted.mapInArrow(code, ", ".join([*[f"{c} smallint" for c in coded], *[f"{c} int" for c in kept[:-1]], "id long"]))
    wanted = wanted.repartition(1) if n <= rows else wanted.repartitionByRange(-(-n // rows), *coded, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        kept, number = [], TaskContext.get().partitionId() << 32

        def packed(table: pa.Table, number: int) -> pa.RecordBatch:
            at = {n: table.column(n).to_numpy() for n in table.column_names}
            codes = np.stack([at[c] for c in coded], axis=1)
            held = np.stack([at[f"f{i}"] for i in range(len(folds))], axis=1) if folds else np.zeros((table.num_rows, 0))
            codes, place = _distinct(codes)
            groups, group = _distinct(held)
            cell = place * 2 + at["y"].astype(np.int64)
            order = np.argsort(cell * len(groups) + group, kind="stable")  # rows of a vector, label and group of folds lie together
            row = {"block": number, "n": table.num_rows, "vectors": len(codes), "codes": codes.astype(np.uint8).tobytes(),
                   "cell": cell[order].astype("<u4").tobytes(), "folds": groups.astype(np.int8).tobytes(),
                   "fold_group": group[order].astype("<u2").tobytes(), "row_id": at["id"][order].astype("<i8").tobytes()}
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), BLOCK_KINDS, strict=True)], names=list(row))

        for batch in batches:
            kept.append(batch)
            while sum(b.num_rows for b in kept) >= rows:
                table = pa.Table.from_batches(kept)
                yield packed(table.slice(0, rows), number)
                number, kept = number + 1, table.slice(rows).to_batches()
        if sum(b.num_rows for b in kept):
            yield packed(pa.Table.from_batches(kept), number)

    path = shared_path(df.sparkSession, "boosting-blocks")
    wanted.mapInArrow(run, BLOCK).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def block_rows(batch: pa.RecordBatch) -> list[dict]:
    """The blocks of a batch; their bytes are not copied."""
    columns = [c.to_pylist() if pa.types.is_integer(c.type) else [v.as_buffer() for v in c] for c in batch.columns]
    return [dict(zip(batch.schema.names, values, strict=True)) for values in zip(*columns, strict=True)]


def joined(parts: list[dict], n_features: int, columns: set[int] | None = None) -> tuple[dict, list[np.ndarray]]:
    """Blocks as one block, and where the vectors of each of them are in it.  Of the fold numbers only ``columns`` are kept."""
    def folds_of(row: dict) -> np.ndarray:
        groups = np.frombuffer(row["fold_group"], "<u2")
        table = np.frombuffer(row["folds"], np.int8).reshape(int(groups.max()) + 1, -1).copy()
        if columns is not None:
            table[:, [c for c in range(table.shape[1]) if c not in columns]] = 0
        return table

    if len(parts) == 1 and columns is None:
        return parts[0], [np.arange(parts[0]["vectors"])]
    codes, place = _distinct(np.concatenate([np.frombuffer(r["codes"], np.uint8).reshape(r["vectors"], n_features) for r in parts]))
    places = np.split(place, np.cumsum([r["vectors"] for r in parts])[:-1])
    tables = list(map(folds_of, parts))
    folds, group = _distinct(np.concatenate(tables))
    groups = np.split(group, np.cumsum([len(t) for t in tables])[:-1])

    def cells(row: dict, at: np.ndarray) -> np.ndarray:
        cell = np.frombuffer(row["cell"], "<u4")
        return (at.astype("<u4") * 2)[cell >> 1] + (cell & 1)

    return {"n": sum(r["n"] for r in parts), "vectors": len(codes), "codes": codes.tobytes(),
            "cell": np.concatenate([cells(r, at) for r, at in zip(parts, places, strict=True)]), "folds": folds.astype(np.int8).tobytes(),
            "fold_group": np.concatenate([g.astype("<u2")[np.frombuffer(r["fold_group"], "<u2")] for r, g in zip(parts, groups, strict=True)]),
            "row_id": np.concatenate([np.frombuffer(r["row_id"], "<i8") for r in parts])}, places


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves half of the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _shares(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number from 0 to 1 per key, by hash of key, seed and tree."""
    salt = _mix(np.array([seed * 1_000_003 + tree + 1], np.uint64))
    out = np.empty(len(keys))
    for a in range(0, len(keys), 1 << 15):  # parts that stay in the processor's cache
        out[a:a + (1 << 15)] = _mix(keys[a:a + (1 << 15)].astype(np.uint64) + salt)
    return out / float(1 << 64)


def _cut(share: float) -> int:
    """The least 64-bit hash whose share, as :func:`_shares` rounds it, is not below ``share``."""
    low, high = 0, 1 << 64
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if float(middle) < share * float(1 << 64) else (low, middle)
    return low


def _hashed(keys: np.ndarray, seed: int, tree: int) -> Iterator[tuple[int, np.ndarray]]:
    """The hashes that :func:`_shares` divides, in parts: (start, hashes); a part is overwritten by the next."""
    salt = _mix(np.array([seed * 1_000_003 + tree + 1], np.uint64))[0]
    x, t = np.empty(1 << 14, np.uint64), np.empty(1 << 14, np.uint64)
    for a in range(0, len(keys), len(x)):
        n = min(len(x), len(keys) - a)
        h, s = x[:n], t[:n]
        np.add(keys[a:a + n], salt, out=h)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
            np.right_shift(h, np.uint64(shift), out=s)
            np.bitwise_xor(h, s, out=h)
            if factor:
                np.multiply(h, np.uint64(factor), out=h)
        yield a, h


def drawn_below(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """``_shares(keys, seed, tree) < share``."""
    out, cut = np.ones(len(keys), bool), _cut(share)
    for a, h in _hashed(keys, seed, tree) if cut < 1 << 64 else ():
        np.less(h, np.uint64(cut), out=out[a:a + len(h)])
    return out


class Rows:
    """The rows of a block, unpacked: distinct vectors of codes, and the vector, label, folds and id of each row.

    Rows of a block are in order of vector and label, those of joined blocks in that order within each of them.
    """

    def __init__(self, row: dict, n_features: int, bins: int):
        self.n, self.vectors, self.bins, self.n_features = row["n"], row["vectors"], bins, n_features
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, n_features or 1)
        self.cell = np.frombuffer(row["cell"], "<u4")
        self.group = np.frombuffer(row["fold_group"], "<u2")
        self.folds = np.frombuffer(row["folds"], np.int8).reshape(int(self.group.max()) + 1, -1)
        self.row_id = np.frombuffer(row["row_id"], "<i8")
        self._drawn: dict = {}
        self._outside: tuple = (None, None)

    @cached_property
    def joint(self) -> list[tuple[list[int], list[int], np.ndarray]]:
        """Groups of features that are counted together: (features, their bins, joint bin of each vector)."""
        groups: list = []
        for f, bins in enumerate((self.codes.max(axis=0).astype(int) + 1).tolist()):
            if groups and prod(groups[-1][1]) * bins <= JOINT_BINS:
                groups[-1][0].append(f)
                groups[-1][1].append(bins)
            else:
                groups.append(([f], [bins]))
        return [(fs, bins, np.ravel_multi_index([self.codes[:, f] for f in fs], bins)) for fs, bins in groups]

    @cached_property
    def _dealt(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Ids of the rows by (group of folds, vector, label), where the rows of each such end, and which these are if not all are listed."""
        key = self.group.astype(np.int64) * (2 * self.vectors) + self.cell
        order = np.argsort(key, kind="stable")
        ids, key, size = self.row_id[order].astype(np.uint64), key[order], len(self.folds) * 2 * self.vectors
        if size <= 4 * self.n + 1_000_000:
            return ids, np.searchsorted(key, np.arange(size), side="right"), None
        last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        return ids, last + 1, key[last]

    def drawn(self, kind, number: int, draw) -> np.ndarray:
        """Sums of what ``draw`` gives for the ids of the rows, by (group of folds, vector, label); the last of each kind is kept."""
        if kind not in self._drawn or self._drawn[kind][0] != number:  # fits share their draws
            self._drawn.pop(kind, None)
            ids, ends, _ = self._dealt
            upto = np.cumsum(draw(ids), dtype=np.int64 if self.n > 1 << 26 else np.int32)[ends - 1]
            upto[ends == 0] = 0
            self._drawn[kind] = number, np.diff(upto, prepend=upto.dtype.type(0))
        return self._drawn[kind][1]

    def outside_sums(self, drawn: np.ndarray, exclude: tuple) -> np.ndarray:
        """(vectors, 2): the sums of the rows outside ``exclude`` by vector and label."""
        keep, size, at = self._groups_outside(exclude), 2 * self.vectors, self._dealt[2]
        if at is not None:
            here = keep[at // size]
            return np.bincount(at[here] % size, drawn[here], size).astype(np.int64).reshape(-1, 2)
        out = np.zeros(size, drawn.dtype)
        for g in np.flatnonzero(keep):
            out += drawn[g * size:(g + 1) * size]
        return out.reshape(-1, 2)

    @property
    def label(self) -> np.ndarray:
        return (self.cell & 1).astype(float)

    def by_row(self, values: np.ndarray) -> np.ndarray:
        """The values of the vectors, for each row."""
        return values[self.cell >> 1]

    def below(self, tree: Tree, node: np.ndarray, level: int) -> np.ndarray:
        """The node of each vector one level down, from its node at ``level`` or above."""
        f = tree.feature[node]
        return np.where((f >= 0) & (node >= 1 << level), 2 * node + (self.codes.ravel()[self._first + f] > tree.bin[node]), node)

    @cached_property
    def _first(self) -> np.ndarray:
        return np.arange(self.vectors) * self.n_features

    def _groups_outside(self, exclude: tuple) -> np.ndarray:
        keep = np.ones(len(self.folds), bool)
        for column, value in exclude:
            keep &= self.folds[:, column] != value
        return keep

    def outside(self, exclude: tuple) -> np.ndarray:
        if self._outside[0] != exclude:
            self._outside = exclude, self._groups_outside(exclude)[self.group]
        return self._outside[1]

    def held_out(self, fit: Fit) -> np.ndarray:
        if not fit.exclude:
            return np.zeros(self.n, bool)
        column, value = fit.exclude[-1]
        return (self._groups_outside(fit.exclude[:-1]) & (self.folds[:, column] == value))[self.group]

    def counts(self, fit: Fit, number: int) -> np.ndarray:
        """(vectors, 2): how many rows of each label teach tree ``number``."""
        if fit.row_share < 1:
            drawn = self.drawn((fit.seed, fit.row_share), number, lambda ids: drawn_below(ids, fit.seed, number, fit.row_share))
        else:
            drawn = self.drawn("all", 0, lambda ids: np.ones(len(ids), bool))
        return self.outside_sums(drawn, fit.exclude)

    @staticmethod
    def derivatives(margin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of G, H and rows of each vector; whole numbers."""
        p = 1 / (1 + np.exp(-margin))
        n = counts.sum(axis=1).astype(float)
        return counts[:, 0] * np.rint(p * UNIT) + counts[:, 1] * np.rint((p - 1.0) * UNIT), n * np.rint(p * (1 - p) * UNIT), n

    def histogram(self, node: np.ndarray, level: int, at: np.ndarray, sums: tuple) -> np.ndarray:
        """(sums, nodes of the level, features, bins) sums, as G, H and rows, of the vectors ``at``; whole numbers."""
        k = 1 << level
        live = np.flatnonzero(node >= k)  # vectors in leaves further up are done
        if len(live) < len(node):
            node, at, sums = node[live], at[live], tuple(v[live] for v in sums)
        out = np.zeros((len(sums), k, self.n_features, self.bins))
        for features, bins, joint in self.joint:
            cell = (node - k) * prod(bins) + joint[at]
            for i, v in enumerate(sums):
                counted = np.bincount(cell, v, k * prod(bins)).reshape(k, *bins)
                for j, f in enumerate(features):
                    out[i, :, f, :bins[j]] = counted.sum(axis=tuple(a + 1 for a in range(len(bins)) if a != j))
        return out

    def histogram_below(self, above: np.ndarray, tree: Tree, node: np.ndarray, level: int, at: np.ndarray, sums: tuple) -> np.ndarray:
        """The same, where ``above`` is that of the level above: only the child with fewer rows is counted, the other is the rest."""
        k = 1 << level
        split = np.flatnonzero(tree.feature[k // 2:k] >= 0)
        left, right = 2 * split, 2 * split + 1
        less = tree.sums[k + left, 2] <= tree.sums[k + right, 2]
        small, large = np.where(less, left, right), np.where(less, right, left)
        counted = np.zeros(2 * k, bool)
        counted[k + small] = True
        here = np.flatnonzero(counted[node])
        out = self.histogram(node[here], level, at[here], tuple(v[here] for v in sums))
        out[:, large] = above[:, split] - out[:, small]
        return out


# ---- splits ---------------------------------------------------------------------------------------------

def _score(g, h, fit: Fit):
    return np.square(np.maximum(np.abs(g) - fit.l1, 0)) / (h + fit.l2 + 1e-12)


def columns_of(fit: Fit, number: int, n_features: int) -> np.ndarray:
    """Which features tree ``number`` may use."""
    allowed = np.ones(n_features, bool)
    if fit.column_share < 1:
        allowed[np.argsort(_shares(np.arange(n_features), fit.seed + 7, number))[max(1, int(fit.column_share * n_features)):]] = False
    return allowed


def grow_level(tree: Tree, fit: Fit, number: int, level: int, hist: np.ndarray) -> bool:
    """Split the nodes of a level by their merged histogram; whether any was split."""
    k = 1 << level
    n_features, bins = hist.shape[2:]
    total = hist[:, :, 0, :].sum(axis=2) / np.array([UNIT, UNIT, 1.0])[:, None]
    left = np.cumsum(hist, axis=3) / np.array([UNIT, UNIT, 1.0])[:, None, None, None]
    right = total[:, :, None, None] - left
    nodes = np.arange(k, 2 * k)
    if level == 0:
        tree.sums[1] = total[:, 0]
    gain = _score(left[0], left[1], fit) + _score(right[0], right[1], fit) - _score(total[0], total[1], fit)[:, None, None]
    allowed = columns_of(fit, number, n_features)[None, :, None]
    both = (left[2] > 0) & (right[2] > 0)
    if fit.symmetric:
        summed = np.where(both & allowed, gain, 0.0).sum(axis=0).ravel()
        best = np.full(k, int(summed.argmax()))
        split = (total[2] > 0) & (summed[best] > MIN_GAIN)
    else:
        fits = both & allowed & (left[2] >= fit.min_rows) & (right[2] >= fit.min_rows) & (
            left[1] >= fit.min_weight) & (right[1] >= fit.min_weight)
        gain = np.where(fits, gain, -np.inf)
        best = gain.reshape(k, -1).argmax(axis=1)
        split = gain.reshape(k, -1)[np.arange(k), best] > MIN_GAIN
    f, b = best // bins, best % bins
    rows = np.flatnonzero(split)
    if not len(rows):
        return False
    at = nodes[rows]
    tree.feature[at], tree.bin[at] = f[rows], b[rows]
    tree.gain[at] = gain[rows, f[rows], b[rows]] if not fit.symmetric else np.where(
        both[rows, f[rows], b[rows]], gain[rows, f[rows], b[rows]], 0.0)
    tree.sums[2 * at] = left[:, rows, f[rows], b[rows]].T
    tree.sums[2 * at + 1] = right[:, rows, f[rows], b[rows]].T
    # A side without rows is never entered: the split sends all to the other one.
    tree.bin[at[tree.sums[2 * at, 2] == 0]] = -1
    tree.bin[at[tree.sums[2 * at + 1, 2] == 0]] = bins
    return True


def finish(tree: Tree, fit: Fit, start: float = 0.0) -> None:
    """Leaf values; ``start`` is added to all of them (the first tree carries the starting margin)."""
    if fit.max_leaves:
        order, leaves, opened = [(-tree.gain[1], 1)] if tree.feature[1] >= 0 else [], 1, set()
        while order and leaves < fit.max_leaves:
            _, node = heapq.heappop(order)
            opened.add(node)
            leaves += 1
            for child in (2 * node, 2 * node + 1):
                if child < len(tree.feature) and tree.feature[child] >= 0:
                    heapq.heappush(order, (-tree.gain[child], child))
        closed = [n for n in np.flatnonzero(tree.feature >= 0).tolist() if n not in opened]
        tree.feature[closed] = -1
    g, h, _ = tree.sums.T
    tree.value = -fit.step * np.sign(g) * np.maximum(np.abs(g) - fit.l1, 0) / (h + fit.l2 + 1e-12) + start


def log_odds(n: float, positive: float) -> float:
    p = min(max(positive / n, 1e-6), 1 - 1e-6) if n else 0.5
    return float(np.log(p / (1 - p)))


TREES = ("fit string, tree int, feature array<int>, bin array<int>, gain array<double>, cover array<double>, value array<double>, "
         "row_id array<long>, margin array<double>, block long, margins binary")
TREES_ARROW = pa.schema([("fit", pa.string()), ("tree", pa.int32()), ("feature", pa.list_(pa.int32())), ("bin", pa.list_(pa.int32())),
                         *((c, pa.list_(pa.float64())) for c in ("gain", "cover", "value")), ("row_id", pa.list_(pa.int64())),
                         ("margin", pa.list_(pa.float64())), ("block", pa.int64()), ("margins", pa.binary())])
ROWS_AT_ONCE = 1 << 16


def _tree_row(fit: Fit, number: int, tree: Tree) -> dict:
    return {"fit": fit.name, "tree": number, "feature": tree.feature.tolist(), "bin": tree.bin.tolist(), "gain": tree.gain.tolist(),
            "cover": tree.sums[:, 2].tolist(), "value": tree.value.tolist()}


def _score_rows(fit: Fit, rows: Rows, margin: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that the fit holds out with their margins, in parts."""
    held = np.flatnonzero(rows.held_out(fit))
    for start in range(0, len(held), ROWS_AT_ONCE):
        at = held[start:start + ROWS_AT_ONCE]
        yield pa.RecordBatch.from_pylist([{"fit": fit.name, "tree": -1, "row_id": rows.row_id[at], "margin": margin[rows.cell[at] >> 1]}], TREES_ARROW)


def _score_vectors(fit: Fit, block: int, margin: np.ndarray) -> pa.RecordBatch:
    """The margins of a block's vectors, if the fit holds out rows."""
    made = [{"fit": fit.name, "tree": -1, "block": block, "margins": margin.astype("<f8").tobytes()}] if fit.exclude else []
    return pa.RecordBatch.from_pylist(made, TREES_ARROW)


# ---- a task that holds the whole table ------------------------------------------------------------------

class Growing:
    """One fit over a block that holds the whole table, tree by tree."""

    def __init__(self, rows: Rows, fit: Fit):
        self.rows, self.fit, self.taught = rows, fit, None
        whole = Fit(fit.name, fit.exclude)
        negative, positive = rows.counts(whole, 0).sum(axis=0).tolist()
        self.start = log_odds(negative + positive, positive)
        self.margin = np.full(rows.vectors, self.start)

    def tree(self, number: int) -> dict:
        rows, fit = self.rows, self.fit
        if self.taught is None or fit.row_share < 1:
            counts = rows.counts(fit, number)
            self.at = np.flatnonzero(counts.any(axis=1))
            self.taught = counts[self.at]
        at, tree = self.at, Tree(fit.depth)
        sums = rows.derivatives(self.margin[at], self.taught)
        node, hist = np.ones(rows.vectors, np.int64), rows.histogram(np.ones(len(at), np.int64), 0, at, sums)
        for level in range(fit.depth):
            if level:
                hist = rows.histogram_below(hist, tree, node[at], level, at, sums)
            if not grow_level(tree, fit, number, level, hist):
                break
            node = rows.below(tree, node, level)
        finish(tree, fit)
        self.margin += tree.value[tree.leaves()[node]]
        if number == 0:
            tree.value = tree.value + self.start
        return _tree_row(fit, number, tree)


def grow_together(rows: Rows, fits: list[Fit]) -> Iterator[dict | Growing]:
    """All trees of some fits over a block that holds the whole table, tree by tree as fits share their draws; then the grown fits."""
    growing = [Growing(rows, f) for f in fits]
    for number in range(max(f.rounds for f in fits)):
        for g in growing:
            if number < g.fit.rounds:
                yield g.tree(number)
    yield from growing


def dealt_tasks(table: DataFrame, tasks: int) -> DataFrame:
    """All blocks for each of some tasks, which are told their ``number``."""
    numbered = table.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return numbered.repartitionById(tasks, F.col("number"))


def tasks_of(table: DataFrame, parts: int, at_once: int) -> int:
    """How many tasks share out ``parts``: at most ``at_once`` each, and as many tasks as cores while there are parts."""
    cores = max(1, table.sparkSession.sparkContext.defaultParallelism)
    return min(parts, cores * -(-parts // (cores * at_once)))


def blocks_by_number(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The blocks that :func:`dealt_tasks` sent to a task, in order."""
    kept: dict[int, list[dict]] = {}
    for batch in batches:
        for row in block_rows(batch):
            kept.setdefault(row["number"], []).append(row)
    for number in sorted(kept):
        yield number, sorted(kept.pop(number), key=lambda r: r["block"])


def _grow_in_tasks(table: DataFrame, fits: list[Fit], n_features: int, bins: int, by_vector: bool) -> DataFrame:
    tasks = tasks_of(table, len(fits), TASK_FITS)
    columns = {c for f in fits for c, _ in f.exclude}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in blocks_by_number(batches):
            names = [r["block"] for r in parts]
            whole, places = joined(parts, n_features, columns)
            del parts
            rows, made = Rows(whole, n_features, bins), []
            for row in grow_together(rows, fits[number::tasks]):
                if isinstance(row, dict):
                    made.append(row)
                    if len(made) < 50:
                        continue
                yield pa.RecordBatch.from_pylist(made, TREES_ARROW)
                made = []
                if isinstance(row, Growing):
                    yield from ((_score_vectors(row.fit, b, row.margin[at]) for b, at in zip(names, places, strict=True)) if by_vector else
                                _score_rows(row.fit, rows, row.margin))

    return dealt_tasks(table, tasks).mapInArrow(run, TREES)


# ---- tables beyond a task: a job per tree level ---------------------------------------------------------

def _unpacked(batch: pa.RecordBatch, n_features: int, bins: int, n_fits: int) -> Iterator[tuple[dict, Rows, np.ndarray]]:
    for row in batch.to_pylist():
        rows = Rows(row, n_features, bins)
        yield row, rows, np.frombuffer(row["margins"], "<f8").reshape(n_fits, rows.vectors)


def _level_job(state: DataFrame, fits: list[Fit], trees: list[Tree], growing: list[int], number: int, level: int,
               n_features: int, bins: int) -> list[tuple[int, Tree]]:
    """One level of all growing trees: histograms per block, merged and split per fit."""
    shared = state.sparkSession.sparkContext.broadcast(trees)  # bounded by the models

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, rows, margins in _unpacked(batch, n_features, bins, len(fits)):
                for i in growing:
                    counts = rows.counts(fits[i], number)
                    at = np.flatnonzero(counts.any(axis=1))
                    node = shared.value[i].place(rows.codes[at], level)
                    hist = rows.histogram(node, level, at, rows.derivatives(margins[i][at], counts[at])).astype(np.int64)
                    total[i] = total[i] + hist if i in total else hist
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                             names=["fit", "hist"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hist = np.frombuffer(packed, np.int64).reshape(3, 1 << level, n_features, bins)
                total[i] = total[i] + hist if i in total else hist
        for i, hist in total.items():
            tree = shared.value[i]
            if grow_level(tree, fits[i], number, level, hist.astype(float)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], names=["fit", "tree"])

    import pickle
    merged = state.mapInArrow(add_up, "fit int, hist binary").repartition(len(growing), "fit").mapInArrow(split, "fit int, tree binary")
    done = [(r["fit"], pickle.loads(bytes(r["tree"]))) for r in merged.collect()]
    shared.unpersist()
    return done


STATE = BLOCK + ", margins binary"


def _grow_in_jobs(table: DataFrame, fits: list[Fit], n_features: int, bins: int, by_vector: bool) -> DataFrame:
    spark = table.sparkSession

    def as_state(frame: DataFrame, change) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in STATE.split(", ")]
            kinds = (*BLOCK_KINDS, pa.binary())
            for batch in batches:
                for row in batch.to_pylist():
                    row["margins"] = change(row, Rows(row, n_features, bins)).astype("<f8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds, strict=True)], names=names)
        return frame.mapInArrow(run, STATE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = Rows(row, n_features, bins)
                masks = [rows.outside(f.exclude) for f in fits]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), pa.array([int(m.sum()) for m in masks], pa.int64()),
                                                  pa.array([int(rows.label[m].sum()) for m in masks], pa.int64())], names=["fit", "n", "positive"])

    sizes = {r["fit"]: (r["n"], r["p"]) for r in table.mapInArrow(count, "fit int, n long, positive long").groupBy("fit").agg(
        F.sum("n").alias("n"), F.sum("positive").alias("p")).collect()}
    start = np.array([log_odds(*sizes[i]) for i in range(len(fits))])
    state = cut_lineage(as_state(table, lambda row, rows: np.repeat(start[:, None], rows.vectors, axis=1)))
    rounds, grown = max(f.rounds for f in fits), []
    for number in range(rounds):
        trees = [Tree(f.depth) for f in fits]
        growing = [i for i, f in enumerate(fits) if number < f.rounds]
        live = growing
        for level in range(max(f.depth for f in fits)):
            live = [i for i in live if level < fits[i].depth]
            if live:
                done = dict(_level_job(state, fits, trees, live, number, level, n_features, bins))
                trees = [done.get(i, t) for i, t in enumerate(trees)]
                live = sorted(done)
        for i in growing:
            finish(trees[i], fits[i])
        applied = {i: trees[i] for i in growing}

        def add(row, rows, applied=applied):
            margins = np.frombuffer(row["margins"], "<f8").reshape(len(fits), rows.vectors).copy()
            for i, tree in applied.items():
                margins[i] += tree.value[tree.place(rows.codes, fits[i].depth)]
            return margins

        last, state = state, as_state(state, add)
        state = cut_lineage(state) if (number + 1) % CHECKPOINT_ROUNDS == 0 or number + 1 == rounds else state.persist()
        state.count()
        last.unpersist()
        for i in growing:
            if number == 0:
                trees[i].value = trees[i].value + start[i]
            grown.append(_tree_row(fits[i], number, trees[i]))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, rows, margins in _unpacked(batch, n_features, bins, len(fits)):
                for f, m in zip(fits, margins, strict=True):
                    yield from [_score_vectors(f, row["block"], m)] if by_vector else _score_rows(f, rows, m)

    trees = spark.createDataFrame(pa.Table.from_pylist(grown, TREES_ARROW))  # bounded by the models
    return trees.unionByName(state.mapInArrow(scores, TREES))


def in_task(table: DataFrame) -> bool:
    """Whether a task can hold all ``blocks`` of a table."""
    size = table.agg(F.sum("n").alias("n"), F.sum("vectors").alias("vectors")).first()
    return (size["n"] or 0) <= max(TASK_ROWS, ONE_BLOCK_ROWS) and (size["vectors"] or 0) <= max(TASK_VECTORS, ONE_BLOCK_ROWS)


def grow(table: DataFrame, fits: list[Fit], thresholds: list[list[float]], by_vector: bool = False) -> DataFrame:
    """Trees and held-out margins of all ``fits`` over a table of ``blocks``.

    One row per (fit, tree) with the tree as heap arrays, and rows with tree -1 that hold held-out row ids and their
    margins, or ``by_vector`` the margins of a block's vectors for :func:`held_out_rows`.  A fit without rows, or with rows of
    one class, has trees that are single leaves.
    """
    if len({f.name for f in fits}) < len(fits):
        raise ValueError("fits need distinct names")
    bins = max([len(t) for t in thresholds], default=0) + 1
    if table.count() == 0:
        raise ValueError("no rows to train on")
    return (_grow_in_tasks if in_task(table) else _grow_in_jobs)(table, fits, len(thresholds), bins, by_vector)


def held_out_rows(table: DataFrame, scores: DataFrame, lines: list[tuple[int, dict[str, Fit]]]) -> DataFrame:
    """(line, row_id, fold, label, one column per name) of held-out rows, from the ``margins`` of the vectors of their blocks.

    A line is a number and fits by column that hold out the same rows; ``scores`` has (fit, block, margins), and ``fold`` is the
    first fold column.  Rows without an id have NULL.
    """
    columns = list(lines[0][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, margins = Rows(row, 0, 0), {m["fit"]: np.frombuffer(m["margins"], "<f8") for m in row["scores"]}
                for line, fits in lines:
                    held = np.flatnonzero(rows.held_out(next(iter(fits.values()))))
                    for start in range(0, len(held), ROWS_AT_ONCE):
                        at = held[start:start + ROWS_AT_ONCE]
                        ids, vector = rows.row_id[at], rows.cell[at] >> 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), line, np.int32)), pa.array(ids, mask=ids == NO_ID),
                             pa.array(rows.folds[rows.group[at], 0].astype(np.int32)), pa.array((rows.cell[at] & 1).astype(float)),
                             *[pa.array(margins[fits[c].name][vector]) for c in columns]], names=["line", "row_id", "fold", "label", *columns])

    by_block = scores.groupBy("block").agg(F.collect_list(F.struct("fit", "margins")).alias("scores"))
    return table.withColumn("codes", F.lit(b"")).join(by_block, "block").mapInArrow(
        run, ", ".join(["line int, row_id long, fold int, label double", *[f"`{c}` double" for c in columns]]))


def probability(margin: str):
    """The probability of class 1 that a margin stands for."""
    return 1 / (1 + F.exp(-F.col(margin)))


def held_out_scores(grown: DataFrame) -> DataFrame:
    """(fit, row_id, probability) of the rows that each fit held out."""
    rows = grown.where("tree = -1").select("fit", F.inline(F.arrays_zip("row_id", "margin")))
    return rows.select("fit", "row_id", probability("margin").alias("probability"))


# ---- as a Spark ML model --------------------------------------------------------------------------------

def _nodes(row, thresholds: list[list[float]]) -> list[tuple]:
    """Nodes of a heap tree in the order and form in which Spark ML saves them; splits that send all one way are skipped."""
    out: list = []

    def add(i: int) -> int:
        bins_of = row["bin"][i]
        while row["feature"][i] >= 0 and not 0 <= bins_of < len(thresholds[row["feature"][i]]):
            i = 2 * i + (bins_of < 0)
            bins_of = row["bin"][i]
        place = len(out)
        out.append(None)
        # Spark's boosted classifiers use twice the margin as log odds.
        value, cover, f = row["value"][i] / 2, row["cover"][i], row["feature"][i]
        stats = [cover, cover * value, cover * value * value]
        if f < 0:
            out[place] = (place, value, 0.0, stats, int(cover), -1.0, -1, -1, (-1, [], -1))
        else:
            left, right = add(2 * i), add(2 * i + 1)
            gain = max(row["gain"][i], 0.0) / max(cover, 1.0)
            out[place] = (place, value, 0.0, stats, int(cover), gain, left, right, (f, [thresholds[f][bins_of]], -1))
        return place

    add(1)
    return out


NODE = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
        "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


def as_spark_model(spark: SparkSession, trees: list, thresholds: list[list[float]], fit: Fit, label: str = "label",
                   features: str = "features") -> GBTClassificationModel:
    """The trees of one fit as Spark ML's boosted classifier, by way of its saved form.

    It scores, explains, saves and streams like any other one; its size is bounded by the fit's parameters.
    """
    path = shared_path(spark, f"boosted-{fit.name}")
    ordered = sorted(trees, key=lambda r: r["tree"])
    nodes = [(t, n) for t, row in enumerate(ordered) for n in _nodes(row, thresholds)]
    version, common = spark.version, {"featuresCol": features, "labelCol": label, "maxDepth": fit.depth, "seed": fit.seed}
    defaults = {"cacheNodeIds": False, "checkpointInterval": 10, "leafCol": "", "maxBins": MAX_BINS, "maxMemoryInMB": 256, "minInfoGain": 0.0,
                "minInstancesPerNode": 1, "minWeightFractionPerNode": 0.0, "predictionCol": "prediction", "impurity": "variance"}

    def described(kind: str, uid: str, params: dict, more: dict, extra: dict) -> str:
        return json.dumps({"class": kind, "timestamp": 0, "sparkVersion": version, "uid": uid, "paramMap": params,
                           "defaultParamMap": defaults | more} | extra)

    whole = described("org.apache.spark.ml.classification.GBTClassificationModel", f"boosted_{fit.name}",
                      common | {"maxIter": len(ordered), "stepSize": fit.step},
                      {"featureSubsetStrategy": "all", "lossType": "logistic", "probabilityCol": "probability",
                       "rawPredictionCol": "rawPrediction", "subsamplingRate": 1.0, "validationTol": 0.01},
                      {"numFeatures": len(thresholds), "numTrees": len(ordered)})
    each = [(t, described("org.apache.spark.ml.regression.DecisionTreeRegressionModel", f"tree_{t}", common, {}, {}), 1.0)
            for t in range(len(ordered))]
    spark.createDataFrame(nodes, NODE).coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return GBTClassificationModel.load(path)
