"""Prefix trie of conversations (operator 12).

A conversation is the sequence of its turns; equal sequences of first turns are one trie node.  Conversations are sorted
by their turns and dealt into ranges ("shards") of about equal size; the id breaks ties, so a group of copies of any
size is spread over shards.  Inside a shard the longest common prefix (LCP) of each row with the one before is known,
and a sparse table gives the smallest LCP of any run of rows in two look-ups.  Every candidate prefix, the first ``d``
turns of row ``i`` where it differs from the row before, then binary-searches the left and the right end of the rows
that share it, each on its own.  The two ends are the members of the node.

A node whose interval touches neither end of its shard is complete there ("closed").  The others ("open") are the
prefixes of the shard's first and last row; their partial sums are added up by key over shards, and the totals flow
back to the shards for their subtree sums.  Only open nodes and ids of copies cross shards: at most two conversations'
worth of nodes a shard.

Turns enter the sort as 16-byte digests, made before any shuffle, so no text is moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renalytics.session import shared_path

DIGEST = 16
SHARD_TURNS = 200_000     # about so many turns in a shard
CHUNK_IDS = 4_096         # ids of copies in one row
BORROWED = 20             # contract: conversation c begins with turns of c - c % 20
BORROWED_TURNS = 4        # as many as crc32(c) % 4
BLANKS = " \t\n\x0b\x0c\r"


def conversations_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                     text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id`` and ``turns``, an array of (key, words) in order.

    Turns are ordered by turn number, null first, ties by role and then by digest.  Null role or text
    is empty.  ``key`` is a 16-byte digest of role and text, ``words`` the number of the text's non-blank runs.  Rows
    without a conversation id take no part; repeated rows are repeated turns.  A conversation's
    digests must fit in a row (20 bytes a turn).
    """
    role, text = (F.coalesce(turns[c], F.lit("")) for c in (role_col, text_col))
    inner = F.btrim(text, F.lit(BLANKS))
    n_words = F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+")))
    # The role's length keeps ("ab", "c") and ("a", "bc") apart.
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    one = turns.where(turns[conv_col].isNotNull()).select(
        turns[conv_col].cast("long").alias("conv_id"),
        F.struct(turns[turn_col].alias("turn"), role.alias("role"), key.alias("key"), n_words.cast("int").alias("words")).alias("t"))
    ordered = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["key"], t["words"])).alias("turns"))


def rebuilt(conversations: DataFrame, step: int = BORROWED, most: int = BORROWED_TURNS) -> DataFrame:
    """Conversations whose first h = crc32(id) % ``most`` turns are those of conversation id - id % ``step``.

    All of its turns if it has fewer, none if there is no such conversation; the own turns after the
    first h follow, if any.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % step
    lent = conversations.where(F.col("conv_id") % step == 0).select(
        F.col("conv_id").alias("base_id"), F.slice("turns", 1, most - 1).alias("lent"))
    joined = conversations.withColumn("base_id", base).withColumn("h", h).join(lent, "base_id", "left")
    first = F.slice(F.coalesce("lent", F.array().cast(joined.schema["turns"].dataType)), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(first, own).alias("turns"))


# ---- one shard ------------------------------------------------------------------------------------------

def sparse_table(values):
    """Row j holds the minimum of the 2^j values from each place on."""
    import numpy as np
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last[:-half], last[half:]))
    return levels


def range_min(levels, lo, hi):
    """Minimum of values[lo:hi] for arrays of ends with lo < hi."""
    import numpy as np
    span = hi - lo
    power = np.frexp(span)[1] - 1
    out = np.empty(len(lo), levels[0].dtype)
    for p in np.unique(power):
        at = np.flatnonzero(power == p)
        row = levels[p]
        out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(p))])
    return out


def extents(lcp, rows, depths):
    """(left, right): first and one past the last row that share the first ``depths`` turns of ``rows``.

    ``lcp[i]`` is the common prefix of rows i - 1 and i; ``lcp[0]`` is unused.  Each end is found by its own
    binary search over range minima.
    """
    import numpy as np
    n = len(lcp)
    levels = sparse_table(lcp)
    # Left: the smallest l with min(lcp[l + 1 .. row]) >= depth.
    lo, hi = np.zeros(len(rows), np.int64), rows.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) // 2
        shared = range_min(levels, mid + 1, rows[open_] + 1) >= depths[open_]
        hi[open_] = np.where(shared, mid, hi[open_])
        lo[open_] = np.where(shared, lo[open_], mid + 1)
    left = lo
    # Right: the largest r with min(lcp[row + 1 .. r]) >= depth.
    lo, hi = rows.copy(), np.full(len(rows), n - 1, np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_] + 1) // 2
        shared = range_min(levels, rows[open_] + 1, mid + 1) >= depths[open_]
        lo[open_] = np.where(shared, mid, lo[open_])
        hi[open_] = np.where(shared, hi[open_], mid - 1)
    return left, lo + 1


def common_prefixes(keys: list[bytes]):
    """LCP in turns of each key with the one before; 0 for the first."""
    import numpy as np
    out = np.zeros(len(keys), np.int64)
    for i in range(1, len(keys)):
        a, b = keys[i - 1], keys[i]
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            out[i] = n // DIGEST
        elif n:
            x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
            out[i] = int(np.argmax(x != y)) // DIGEST
    return out


def node_key(key: bytes, depth: int) -> bytes:
    """Name of an open node across shards."""
    return hashlib.sha256(b"%d:" % depth + key[:depth * DIGEST]).digest()


def join_ids(ids) -> str:
    return ",".join(map(str, ids))


class Shard:
    """The nodes of one sorted range of conversations."""

    def __init__(self, ids, keys: list[bytes], words: list):
        import numpy as np
        self.ids, self.keys = np.asarray(ids, np.int64), keys
        n = len(keys)
        lens = np.array([len(k) // DIGEST for k in keys], np.int64)
        lcp = common_prefixes(keys)
        # Candidates: the root, and what each row has beyond the prefix it shares with the row before.
        fresh = lens - lcp
        row = np.repeat(np.arange(n), fresh)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(fresh) - fresh, fresh) + np.repeat(lcp, fresh) + 1
        self.row, self.depth = np.concatenate([[0], row]), np.concatenate([[0], depth])
        self.left, self.right = extents(lcp, self.row, self.depth)
        flat = np.concatenate([np.asarray(w, np.int64) for w in words]) if len(row) or any(map(len, words)) else np.zeros(0, np.int64)
        at = np.cumsum(lens) - lens
        self.words = np.zeros(len(self.row), np.int64)
        self.words[1:] = flat[at[self.row[1:]] + self.depth[1:] - 1]
        self.members = self.right - self.left
        self.smallest = self._smallest()
        # Nodes of a depth start at different rows, so (depth, left) names a node; its parent is the last node one
        # level up that starts at or before it.
        order = np.lexsort((self.left, self.depth))
        code = self.depth[order] * (n + 1) + self.left[order]
        find = np.searchsorted(code, (self.depth - 1) * (n + 1) + self.left, side="right") - 1
        self.parent = np.where(self.depth > 0, order[np.maximum(find, 0)], -1)
        self.open = (self.left == 0) | (self.right == n)
        # Rows that end at a node come first in its interval: the end group of node v is [left, left + ends).
        ends = lens[self.left] == self.depth
        same = np.zeros(len(self.row), np.int64)
        if ends.any():
            stop = np.minimum(self._run_end(lens, lcp)[self.left], self.right)
            same = np.where(ends, stop - self.left, 0)
        self.ends = same
        self.is_open_child = self.open & (self.depth > 0)
        self._subtrees()

    @staticmethod
    def _run_end(lens, lcp):
        """One past the last row equal to row i, for rows that start a run of equal ones."""
        import numpy as np
        n = len(lens)
        starts = np.ones(n, bool)
        starts[1:] = ~((lcp[1:] == lens[1:]) & (lens[1:] == lens[:-1]))
        begin = np.flatnonzero(starts)
        stop = np.append(begin[1:], n)
        return np.repeat(stop, stop - begin)

    def _smallest(self):
        """Smallest id of each node's rows, from a sparse table over the ids."""
        return range_min(sparse_table(self.ids), self.left, self.right)

    def _subtrees(self):
        """Counts over closed nodes; what hangs off an open node is summed at that node."""
        import numpy as np
        m = len(self.row)
        self.children, self.leaves, self.saved = (np.zeros(m, np.int64) for _ in range(3))
        for d in range(int(self.depth.max(initial=0)), -1, -1):
            at = np.flatnonzero(self.depth == d)
            closed = at[~self.open[at]]
            self.leaves[closed] += self.children[closed] == 0
            self.saved[closed] += (self.members[closed] - 1) * self.words[closed]
            if d:
                up = self.parent[closed]
                np.add.at(self.children, up, 1)
                np.add.at(self.leaves, up, self.leaves[closed])
                np.add.at(self.saved, up, self.saved[closed])


NODE = ("kind string, shard long, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, words long, open_child boolean, ends binary, n_ids long, ids string")


def _shard_rows(number: int, shard: Shard) -> Iterator[dict]:
    """Closed nodes, partial sums of open ones, and the ids of end groups of open nodes in chunks."""
    keys, ids = shard.keys, shard.ids
    has_open_child = set(shard.parent[shard.is_open_child].tolist())
    names: dict[int, bytes] = {}

    def name(v: int) -> bytes:
        if v not in names:
            names[v] = node_key(keys[shard.row[v]], int(shard.depth[v]))
        return names[v]

    for v in range(len(shard.row)):
        left, count, up = int(shard.left[v]), int(shard.ends[v]), int(shard.parent[v])
        made = {"shard": number, "conv_id": int(shard.smallest[v]), "depth": int(shard.depth[v]),
                "n_convs": int(shard.members[v]), "n_children": int(shard.children[v]), "n_leaves": int(shard.leaves[v]),
                "saved_tokens": int(shard.saved[v]), "words": int(shard.words[v])}
        if up >= 0:
            made["parent"] = name(up) if shard.open[up] else None
            made["parent_conv_id"] = None if shard.open[up] else int(shard.smallest[up])
        if not shard.open[v]:
            digest = hashlib.sha256(join_ids(ids[left:left + count].tolist()).encode()).digest()
            yield made | {"kind": "closed", "ends": digest}
            continue
        yield made | {"kind": "open", "node": name(v), "open_child": v in has_open_child}
        for a in range(left, left + count, CHUNK_IDS):
            part = ids[a:min(a + CHUNK_IDS, left + count)].tolist()
            yield {"kind": "ids", "shard": number, "node": name(v), "conv_id": part[0], "n_ids": len(part), "ids": join_ids(part)}


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    part: list[dict] = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def _arrow(spark_schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in spark_schema.split(", ")])


def _sorted_shards(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, words) in ranges of (key, conv_id), each sorted."""
    n_turns = conversations.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    parts = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n_turns > SHARD_TURNS else 1,
                -(-n_turns // SHARD_TURNS))
    flat = conversations.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("key"),
                                F.transform("turns", lambda t: t["words"]).alias("words"))
    return flat.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")


def _merge_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each open node, from chunks sorted by (node, first id); streams, holding one chunk."""
    node, digest = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((node, digest.digest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.binary()) for i in (0, 1)], names=["node", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.digest()], pa.binary())], names=["node", "ends"])


def _open_subtrees(rows: pa.Table) -> pa.Table:
    """Subtree sums over the open nodes of one shard: at most the prefixes of two conversations."""
    table = rows.sort_by([("depth", "descending")]).to_pydict()
    n = len(table["node"])
    place = {k: i for i, k in enumerate(table["node"])}
    children, leaves, saved = table["n_children"], table["n_leaves"], table["saved_tokens"]
    for i in range(n):
        if table["owner"][i]:  # a node that several shards hold is counted in one of them
            leaves[i] += table["childless"][i]
            saved[i] += (table["total"][i] - 1) * table["words"][i]
        up = place.get(table["parent"][i])
        if up is not None:
            children[up] += table["owner"][i]
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    return pa.table({"node": pa.array(table["node"], pa.binary()), "n_children": pa.array(children, pa.int64()),
                     "n_leaves": pa.array(leaves, pa.int64()), "saved_tokens": pa.array(saved, pa.int64())})


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``conversations`` (conv_id, turns), root included.

    Per node, long: ``conv_id`` the smallest member; ``depth``; ``parent_conv_id``; ``n_convs`` members; ``n_children``;
    ``n_leaves`` and ``saved_tokens`` over its subtree; and ``ends_sha256`` of the ids that end at it.  A table
    without conversations has no node.  Ids are distinct; see ``conversations_of``.
    """
    spark = conversations.sparkSession
    schema = _arrow(NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        ids, keys, words = [], [], []
        for b in batches:
            ids.extend(b.column("conv_id").to_pylist())
            keys.extend(b.column("key").to_pylist())
            words.extend(b.column("words").to_pylist())
        if ids:
            yield from _batches(_shard_rows(TaskContext.get().partitionId(), Shard(ids, keys, words)), schema)

    path = shared_path(spark, "prefix-trie")
    whole = shared_path(spark, "prefix-trie-rows")
    conversations.write.parquet(whole)
    _sorted_shards(spark.read.parquet(whole)).mapInArrow(run, NODE).write.partitionBy("kind").parquet(path)
    made = spark.read.schema(NODE).parquet(path)
    opened = made.where("kind = 'open'")
    # Totals of open nodes over shards; the first shard that holds one owns it.
    totals = opened.groupBy("node").agg(
        F.sum("n_convs").alias("total"), F.min("conv_id").alias("smallest"), F.min("shard").alias("owner_shard"),
        ((F.sum("n_children") == 0) & ~F.bool_or("open_child")).alias("childless"))
    per_shard = opened.join(totals, "node").select(
        "shard", "node", "parent", "depth", "n_children", "n_leaves", "saved_tokens", "words", "total", "smallest",
        (F.col("shard") == F.col("owner_shard")).cast("int").alias("owner"), F.col("childless").cast("int").alias("childless"))
    open_path = shared_path(spark, "prefix-trie-open")
    per_shard.write.parquet(open_path)
    per_shard = spark.read.parquet(open_path)
    sums = (per_shard.groupBy("shard").applyInArrow(
        _open_subtrees, "node binary, n_children long, n_leaves long, saved_tokens long")
        .groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]))
    ends = (made.where("kind = 'ids'").select("node", "conv_id", "ids").repartition("node")
            .sortWithinPartitions("node", "conv_id").mapInArrow(_merge_ids, "node binary, ends binary"))
    owned = per_shard.where("owner = 1").select("node", "parent", "depth", F.col("smallest").alias("conv_id"), F.col("total").alias("n_convs"))
    names = owned.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = F.lit(hashlib.sha256(b"").digest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    tops = (owned.join(names, "parent", "left").join(sums, "node").join(ends, "node", "left")
            .select(*columns, F.coalesce("ends", empty).alias("ends")))
    # A closed node under an open one takes its parent's id from its own shard's row of that parent.
    parents = per_shard.select("shard", F.col("node").alias("parent"), F.col("smallest").alias("found"))
    closed = made.where("kind = 'closed'").join(parents, ["shard", "parent"], "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "found")).select(*columns, "ends")
    return tops.unionByName(closed).select(*columns, F.lower(F.hex("ends")).alias("ends_sha256"))
