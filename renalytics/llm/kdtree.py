"""Exact top-k search by inner product over KD-trees per shard (operator 10).

Rows are dealt into shards by the hash of their id.  Each shard builds one KD-tree: median splits on the
widest dimension, a tight bounding box at every node.  The largest inner product that a box allows is the
sum of the larger of q*lo and q*hi, so a best-first search may stop at the first node whose bound lies
under the kth score found so far.  Blocks of queries first search one home shard; the kth score found
there travels with the block to all other shards, which skip what cannot reach it.

A cell of the search is one shard and one block, both of bounded size.  Equal vectors of a shard are one
point that keeps its k+1 smallest ids, which no top k can need more of, so a vector that a third of
the rows share costs one comparison.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from renalytics.session import cut_lineage

SCALE = 256
SHARD_ROWS = 8192
BLOCK_QUERIES = 512
LEAF = 64


class Tree:
    """KD-tree over integer points held in leaf order; node i covers points[start[i]:stop[i]]."""

    def __init__(self, points, ids):
        import numpy as np
        self.points, self.ids = points, ids
        order = np.arange(len(points))
        self.start, self.stop, self.left, self.lo, self.hi = [], [], [], [], []
        todo = [(0, len(points))]
        while todo:  # nodes are numbered as they are taken from the queue; children follow each other
            a, b = todo.pop(0)
            part = points[order[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            self.start.append(a)
            self.stop.append(b)
            self.lo.append(lo)
            self.hi.append(hi)
            if b - a <= LEAF:
                self.left.append(-1)
                continue
            widest, middle = int(np.argmax(hi - lo)), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, widest], middle)]
            self.left.append(len(self.start) + len(todo))
            todo += [(a, a + middle), (a + middle, b)]
        self.points, self.ids = points[order], [ids[i] for i in order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, queries):
        """Largest inner product that each node's box allows, as (queries, nodes)."""
        import numpy as np
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T

    def search(self, query, own: int, bounds, k: int, floor: float) -> list[tuple[int, int]]:
        """(score, id) of the best k ids but ``own`` that score ``floor`` or more, ties to smaller ids."""
        import numpy as np
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top
        nodes = [(-bounds[0], 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            least = best[0][0] if len(best) == k else floor
            if -bound < least:
                break  # an equal bound may still hold a smaller id
            child = self.left[node]
            if child >= 0:
                for c in (child, child + 1):
                    if bounds[c] >= least:
                        heapq.heappush(nodes, (-bounds[c], c))
                continue
            a, b = self.start[node], self.stop[node]
            scores = self.points[a:b] @ query
            for i in np.flatnonzero(scores >= least):
                score = int(scores[i])
                for other in self.ids[a + i]:
                    if other == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -other))
                    elif (score, -other) > best[0]:
                        heapq.heapreplace(best, (score, -other))
        return [(s, -i) for s, i in best]


def _exact(points):
    """float64 where every inner product is exact in it (BLAS), else int64."""
    import numpy as np
    most = np.abs(points).max(initial=0)
    return points.astype(np.float64) if float(most) ** 2 * max(1, points.shape[1]) < 2 ** 52 else points


def _collapse(vectors, ids, k: int):
    """Distinct vectors, each with its k+1 smallest ids."""
    import numpy as np
    distinct, at = np.unique(vectors, axis=0, return_inverse=True) if vectors.shape[1] else (vectors[:1], np.zeros(len(ids), int))
    order = np.lexsort((ids, at.ravel()))
    groups = np.split(ids[order], np.flatnonzero(np.diff(at.ravel()[order])) + 1)
    return distinct, [g[:k + 1].tolist() for g in groups]


def _matrix(column, dim: int):
    import numpy as np
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(rows.flatten()).astype(np.int64).reshape(len(rows), dim)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim): floor(256 x) of each usable vector; a repeated id stands once, with its smallest vector."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return (usable.groupBy(F.col(id_col).cast("long").alias("id"))
            .agg(F.min(F.transform(v, lambda x: F.floor(x * SCALE).cast("long"))).alias("v"))
            .withColumn("dim", F.size("v")))


def _shards(vectors: DataFrame, shards: int, k: int) -> DataFrame:
    """(dim, shard, points, ids): one row per shard with its distinct vectors and their ids."""

    def pack(table: pa.Table) -> pa.Table:
        import numpy as np
        dim = table.column("dim")[0].as_py()
        ids = np.asarray(table.column("id").combine_chunks())
        points, groups = _collapse(_matrix(table.column("v"), dim), ids, k)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                         "points": pa.array([points.ravel().tolist()], pa.list_(pa.int64())),
                         "ids": pa.array([groups], pa.list_(pa.list_(pa.int64())))})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(
        pack, "dim int, shard int, points array<long>, ids array<array<long>>")


CELL = "home int, dim int, query_ids array<long>, queries array<long>, floors array<double>"
HIT = "query_id long, vec_id long, score long"


def _search_cells(cells: DataFrame, k: int) -> DataFrame:
    """Each cell's block with the kth score of every query so far, and its hits."""
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()),
             pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))]
    names = ["home", "dim", "query_ids", "queries", "floors", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        known: tuple = (None, None)
        for batch in batches:
            for cell in range(batch.num_rows):
                get = {c: batch.column(c)[cell] for c in batch.schema.names}
                dim, shard = get["dim"].as_py(), get["shard"].as_py()
                if known[0] != (dim, shard):
                    groups = get["ids"].as_py()
                    points = np.asarray(get["points"].values).reshape(len(groups), dim)
                    known = ((dim, shard), Tree(_exact(points), groups))
                tree = known[1]
                owners = get["query_ids"].as_py()
                queries = np.asarray(get["queries"].values).reshape(len(owners), dim)
                queries = queries.astype(tree.points.dtype) if _exact(queries).dtype == np.float64 else queries
                floors, bounds, hits = get["floors"].as_py(), tree.bounds(queries), []
                for i, own in enumerate(owners):
                    found = tree.search(queries[i], own, bounds[i], k, floors[i])
                    if len(found) == k:
                        floors[i] = max(floors[i], float(min(s for s, _ in found)))
                    hits += [{"query_id": own, "vec_id": v, "score": s} for s, v in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], kind) for v, kind in zip(
                        (get["home"].as_py(), dim, owners, get["queries"].as_py(), floors, hits), kinds, strict=True)],
                    names=names)

    columns = ["home", "dim", "query_ids", "queries", "floors", "shard", "points", "ids"]
    return cells.select(*columns).mapInArrow(
        run, f"{CELL}, hits array<struct<query_id: long, vec_id: long, score: long>>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", shard_rows: int = SHARD_ROWS,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` rows of largest integer inner product for every row that ``is_query`` marks.

    ``is_query`` is a condition on a column ``id``.  Returns query_id, rank, vec_id, score; ties go to the
    smaller id; a query with fewer candidates has fewer rows.  Vectors that are null or hold a null or
    non-finite component, and null ids, take no part; a repeated id counts once, with its smallest vector;
    vectors are compared with those of their own length; other columns are not read; an empty table
    gives an empty result.  Scores must fit a long.
    """
    usable = cut_lineage(integer_vectors(vectors, id_col, vector_col))
    rows = usable.count()
    shards = max(1, -(-rows // shard_rows))
    trees = cut_lineage(_shards(usable, shards, k))
    queries = usable.where(is_query)
    blocks = max(1, -(-queries.count() // block_queries))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    packed = (queries.withColumn("block", block).groupBy("dim", "block")
              .agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("q"))
              .select(F.pmod("block", F.lit(shards)).cast("int").alias("home"), "dim",
                      F.col("q.id").alias("query_ids"), F.flatten("q.v").alias("queries"),
                      F.transform("q", lambda _: F.lit(float("-inf"))).alias("floors")))
    at_home = cut_lineage(_search_cells(
        packed.withColumn("shard", F.col("home")).join(trees, ["dim", "shard"]), k))
    # A home shard may hold no vector of the block's length; such blocks go on without a floor.
    went = at_home.select("home", "dim", "query_ids", "queries", "floors")
    stayed = packed.join(trees.select("dim", F.col("shard").alias("home")), ["dim", "home"], "left_anti")
    others = went.unionByName(stayed.select(went.columns)).withColumn(
        "shard", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))))
    elsewhere = _search_cells(others.join(trees, ["dim", "shard"]), k)
    hits = at_home.select("hits").unionAll(elsewhere.select("hits")).select(F.inline("hits"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
