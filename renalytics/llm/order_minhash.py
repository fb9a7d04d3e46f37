"""Near-duplicate classes by Order MinHash (operator 3).

A text's k-mers are its runs of ``K`` words, each labelled with its occurrence number.  A sketch is the
``PICKED`` k-mers of smallest hash, kept in text order, so it agrees for texts that share k-mers in the same
order: it follows edit similarity and not only the set of k-mers.  ``SKETCHES`` independent sketches make
texts with similarity 0.8 meet in some bucket but for three to eight pairs in a million, where the longer one has
more than ``FEW`` k-mers.  Shorter texts draw so many of their k-mers that more pairs would miss each other;
they need no bucket, as all of them go through the exact prefix filter below.

Similarity is c / (a + b - c), with a and b the k-mer counts of the two texts and c the most k-mers that an
alignment of the two sequences can match in order; a k-mer may match any equal one, whatever its occurrence
number.  The k-mers that a similar pair leaves out are few, so the alignment looks at the band that they allow.
The common labelled k-mers bound c from above and save the alignment of most pairs.

Equal texts are one node.  In each bucket every node is compared with the bucket's centre, the node with
the most company over all its buckets (the original of a group of edited copies, say), so pairs grow with
the members and not with their square.  Members of buckets that still hold different classes after that, and
all texts of up to ``FEW`` k-mers, are matched by an exact prefix filter over their k-mers (see
``_prefix_pairs``), which leaves no link open.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renalytics.llm.common import free_name, slices
from renalytics.session import cut_lineage, shared_path

K = 5
SKETCHES = 24
PICKED = 4
SIMILARITY = 0.8
FEW = 25                # k-mers up to which a text needs no bucket
MEMO_WORDS = 300_000
MAX_CELLS = 1 << 24     # bounds the broadcast table of k-mer counts: 32 MiB
SEGMENT_CELLS = 1 << 16

WORDS = re.compile(r"\w+")


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest
        value = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_MEMO = _WordHash()


def words_of(text: str) -> list[str]:
    """Lower-case words; a text without any has its blank-separated runs instead."""
    return WORDS.findall(text.lower()) or text.split()


def _mix(x):
    import numpy as np
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(words: list[str]):
    """64-bit hashes of the k-mers in text order; a text of fewer than K words is one k-mer."""
    import numpy as np
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))
    if len(_MEMO) > MEMO_WORDS:
        _MEMO.clear()
    k = min(K, len(own))
    total = np.zeros(len(own) - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + own[j:len(own) - k + 1 + j]
    return _mix(total)


def occurrences(hashes):
    """Occurrence number of each value among equal ones, in order."""
    import numpy as np
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts = np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))
    out = np.empty(len(ranked), np.int64)
    out[order] = np.arange(len(ranked)) - starts
    return out


def sketch_keys(hashes) -> list[int]:
    """Bucket keys of a k-mer sequence: one signed 64-bit number per sketch."""
    import numpy as np
    if not len(hashes):
        return []
    labelled = _mix(hashes + occurrences(hashes).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    seeds = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))
    drawn = _mix(labelled[None, :] ^ seeds[:, None])
    n = min(PICKED, len(hashes))
    least = np.argpartition(drawn, n - 1, axis=1)[:, :n] if n < len(hashes) else np.tile(np.arange(n), (SKETCHES, 1))
    in_order = hashes[np.sort(least, axis=1)]
    key = seeds.copy()
    for j in range(n):
        key = _mix(key * np.uint64(3) + in_order[:, j])
    return key.view(np.int64).tolist()


def _in_order(a, b, needed: int) -> int:
    """Length of the longest common subsequence of two sequences; 0 where it stays under ``needed``.

    Bit-parallel over rows of the alignment, a zero bit for each place of ``b`` that gains a match.  Matches
    that leave more than len(a) - needed of ``a`` or len(b) - needed of ``b`` out lie outside the band.
    """
    import numpy as np
    back, ahead = len(a) - needed, len(b) - needed
    if back < 0 or ahead < 0:
        return 0
    low = high = found = open_ = 0
    for i in range(len(a)):
        first, last = max(0, i - back), min(len(b), i + ahead + 1)
        open_ |= ((1 << (last - high)) - 1) << (high - low)
        if first > low:  # columns that leave the band keep their matches
            found += first - low - (open_ & ((1 << (first - low)) - 1)).bit_count()
            open_ >>= first - low
        low, high = first, last
        hits = int.from_bytes(np.packbits(b[low:high] == a[i], bitorder="little").tobytes(), "little") & open_
        if hits:
            open_ = ((open_ + hits) | (open_ - hits)) & ((1 << (high - low)) - 1)
        if i % 64 == 63 and found + high - low - open_.bit_count() + len(a) - i - 1 < needed:
            return 0
    found += high - low - open_.bit_count()
    return found if found >= needed else 0


def similarity(a, b, least: float = SIMILARITY) -> float:
    """Similarity of two k-mer sequences by banded alignment; 0 where it does not reach ``least``."""
    import numpy as np
    if not len(a) or not len(b):
        return 0.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    la, lb = (_mix(x.astype(np.uint64) + occurrences(x).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) for x in (a, b))
    _, at_a, at_b = np.intersect1d(la, lb, assume_unique=False, return_indices=True)
    needed = math.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9)
    matched = len(at_a)  # no alignment matches more
    if matched < needed:
        return 0.0
    chain = at_b[np.argsort(at_a)]
    if not np.all(chain[1:] > chain[:-1]):  # equal k-mers may match at other occurrences
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[:short] != b[:short])
        head = int(differ[0]) if len(differ) else short
        differ = np.flatnonzero(a[len(a) - short + head:][::-1] != b[len(b) - short + head:][::-1])
        tail = int(differ[0]) if len(differ) else short - head
        matched = head + tail + _in_order(a[head:len(a) - tail], b[head:len(b) - tail], needed - head - tail)
    return matched / (len(a) + len(b) - matched) if matched >= needed else 0.0


def _sketched(docs: DataFrame) -> DataFrame:
    """(id, digest, n, keys, kmers) of each row with a text; digest is that of the word sequence."""
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for batch in (part for whole in batches for part in slices(whole, ["text"])):
            rows = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(t)
                hashes = kmers(words)
                digest = hashlib.blake2b("\x1f".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                rows.append((i, digest, len(hashes), sketch_keys(hashes), hashes.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)],
                names=["id", "digest", "n", "keys", "kmers"])

    return docs.mapInArrow(run, "id long, digest binary, n int, keys array<long>, kmers binary")


def labelled_kmers(stored: bytes):
    """64-bit hashes of the occurrence-labelled k-mers of a stored sequence."""
    import numpy as np
    hashes = np.frombuffer(stored, np.uint32)
    return _mix(hashes.astype(np.uint64) + occurrences(hashes).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _cell_counts(rest: DataFrame, cells: int):
    """How many labelled k-mers of all rows fall into each of ``cells`` cells, as uint16 up to 65535.

    Partitions send the counts of the cells that they meet; the merged table is collected, and
    ``cells`` bounds it.
    """
    import numpy as np
    step = min(cells, SEGMENT_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(labelled_kmers(k) & np.uint64(cells - 1)).astype(np.int64)
                 for batch in batches for k in batch.column("kmers").to_pylist()]
        if not found:
            return
        at, times = np.unique(np.concatenate(found), return_counts=True)
        cuts = np.searchsorted(at, np.arange(0, cells + 1, step))
        rows = [(s, (at[a:b] - s * step).astype("<u4").tobytes(), np.minimum(times[a:b], 65535).astype("<u2").tobytes())
                for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
            names=["segment", "at", "times"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for at, times in zip(table.column("at").to_pylist(), table.column("times").to_pylist(), strict=True):
            total[np.frombuffer(at, "<u4")] += np.frombuffer(times, "<u2")
        return pa.table({"segment": pa.array([table.column("segment")[0].as_py()], pa.int32()),
                         "counts": pa.array([np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())})

    merged = (rest.select("kmers").mapInArrow(count, "segment int, at binary, times binary")
              .groupBy("segment").applyInArrow(merge, "segment int, counts binary"))
    counts = np.zeros(cells, "<u2")
    for row in merged.toLocalIterator():
        counts[row["segment"] * step:(row["segment"] + 1) * step] = np.frombuffer(row["counts"], "<u2")
    return counts


def _prefix_pairs(rest: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of different classes among ``rest`` (node, label, n, kmers) that can be similar.

    With the labelled k-mers of all texts in one order, two texts whose common k-mers make up the share
    ``least`` have one in common among the first n - ceil(least * n) + 1 of each, and the places
    of the first common one bound how many can follow.  This loses no pair, whatever the order; the
    order by rarity, from a table of approximate counts, makes the first ones of an edited or unrelated
    text its own, so groups with a shared passage or a common ancestor yield few pairs.
    """
    size = rest.agg(F.sum("n")).first()[0] or 1
    cells = min(MAX_CELLS, max(1 << 16, 1 << (4 * size - 1).bit_length()))
    shared = rest.sparkSession.sparkContext.broadcast(_cell_counts(rest, cells))  # 32 MiB at most
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["token", "node", "label", "n", "place"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        counts = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for node, label, k in zip(*(batch.column(c).to_pylist() for c in ("node", "label", "kmers")), strict=True):
                hashes = labelled_kmers(k)
                n, times = len(hashes), counts[hashes & np.uint64(cells - 1)]
                order = np.lexsort((hashes, times))[:n - math.ceil(least * n - 1e-9) + 1]
                for place in np.flatnonzero(times[order] > 1).tolist():  # a single one has no partner
                    rows.append((int(hashes[order[place]].view(np.int64)), node, label, n, place))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    first = cut_lineage(rest.select("node", "label", "kmers").mapInArrow(
        prefixes, "token long, node long, label long, n int, place int"))
    one, two = (first.select("token", *[F.col(c).alias(f"{c}_{side}") for c in names[1:]]) for side in "ab")
    can_follow = 1 + F.least(F.col("n_a") - F.col("place_a") - 1, F.col("n_b") - F.col("place_b") - 1)
    needed = F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - 1e-6
    return (one.join(two, (one["token"] == two["token"]) & (F.col("node_a") < F.col("node_b"))
                     & (F.col("label_a") != F.col("label_b")) & (can_follow >= needed))
            .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())


def _verified(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """The (a, b) among ``pairs`` whose texts are similar; each pair carries two k-mer sequences to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            hit = [i for i in range(batch.num_rows) if similarity(
                np.frombuffer(batch.column("kmers_a")[i].as_buffer(), np.uint32),
                np.frombuffer(batch.column("kmers_b")[i].as_buffer(), np.uint32), least) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hit], pa.int64()),
                                              pa.array([b[i] for i in hit], pa.int64())], names=["a", "b"])

    joined = (pairs.join(sequences.select(F.col("node").alias("b"), F.col("kmers").alias("kmers_b")), "b")
              .join(sequences.select(F.col("node").alias("a"), F.col("kmers").alias("kmers_a")), "a"))
    return joined.select("a", "b", "kmers_a", "kmers_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of ``links`` (a, b).

    Rounds of smallest neighbouring label followed by a jump to the label's label; each round is
    checkpointed.  Nodes without links do not occur.
    """
    both = cut_lineage(links.union(links.select("b", "a")).distinct().toDF("node", "other"))
    labels = cut_lineage(both.groupBy("node").agg(F.min("other").alias("least"))
                         .select("node", F.least("node", "least").alias("label")))
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("label").alias("offered"))
        offers = both.join(of_other, "other").groupBy("node").agg(F.min("offered").alias("offered"))
        nearer = labels.join(offers, "node").select("node", F.least("label", "offered").alias("near"), "label")
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        stepped = cut_lineage(nearer.join(jump, "near").select("node", F.least("near", "far").alias("label"),
                                                               F.col("label").alias("was")))
        changed = stepped.where("label != was").limit(1).count()
        labels = stepped.select("node", "label")
        if not changed:
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) for each distinct id: the smallest id of the document's near-duplicate class.

    Classes are the connected components of the pairs with similarity ``least`` or more.  Texts with equal
    words are one class, empty ones included; a null text is alone; a text of fewer than five words
    is one k-mer.  Repeated rows of an id are one document, all their texts in its class; null ids are left
    out; other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null")
    place = shared_path(spark, "order-minhash")
    _sketched(rows.where("text is not null")).write.parquet(place)
    table = spark.read.parquet(place)

    # One node per text, named after its smallest id.
    texts = table.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"))
    nodes = table.select(F.col("id").alias("node"), "digest", "keys").join(texts, ["node", "digest"])
    keyed = cut_lineage(nodes.where("n > 0").select("node", "keys"))
    met = keyed.select("node", F.explode("keys").alias("key"))
    # Aggregates are cut before they are joined, so that the join shuffles both sides and can split hot keys.
    crowded = cut_lineage(met.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    met = cut_lineage(met.join(crowded, "key"))
    company = met.groupBy("node").agg(F.sum("members").alias("company"))
    centres = cut_lineage(met.join(company, "node").groupBy("key")
                          .agg(F.max(F.struct("company", (-F.col("node")).alias("rank"))).alias("best"))
                          .select("key", (-F.col("best.rank")).alias("a")))
    pairs = cut_lineage(met.join(centres, "key").where("a != node").select("a", F.col("node").alias("b")).distinct())

    # The k-mer sequences of all nodes with company or few k-mers, shuffled once and cut: every later step reads these.
    known = (texts.select(F.col("node").alias("id"), "digest", "n")
             .join(company.select(F.col("node").alias("id"), "company"), "id", "left")
             .where(F.col("company").isNotNull() | F.col("n").between(1, FEW)).drop("company"))
    sequences = cut_lineage(table.select("id", "digest", "kmers").join(known, ["id", "digest"])
                            .select(F.col("id").alias("node"), "n", "kmers"))
    links = cut_lineage(_verified(pairs, sequences, least))
    labels = components(links)

    # What the centres leave open: nodes of a bucket that holds several classes, and short texts without a bucket.
    labelled = met.select("key", "node").join(labels, "node", "left").select(
        "key", "node", F.coalesce("label", "node").alias("label"))
    mixed = cut_lineage(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                        .where("low != high").select("key"))
    few = sequences.where(F.col("n") <= FEW).select("node").join(labels, "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"))
    left = labelled.join(mixed, "key").select("node", "label").union(few).distinct()
    rest = cut_lineage(sequences.join(left, "node").select("node", "label", "n", "kmers"))
    more = cut_lineage(_verified(_prefix_pairs(rest, least), rest, least))
    if more.limit(1).count():
        labels = components(labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
                            .union(more))

    # Ids with several texts tie the classes of those texts together.
    named = table.select("id", "digest").distinct().join(texts.select("digest", "node"), "digest")
    named = named.join(labels, "node", "left").select("id", F.coalesce("label", "node").alias("label"))
    several = named.groupBy("id").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    ties = cut_lineage(several.where("a != b").select("a", "b"))
    if ties.limit(1).count():
        merged = components(ties.union(named.select(F.col("label").alias("a"), F.col("label").alias("b"))))
        named = named.join(merged.toDF("label", "root"), "label").select("id", F.col("root").alias("label"))
    found = named.groupBy("id").agg(F.min("label").alias("label"))
    ids = rows.select("id").distinct()
    return (ids.join(found, "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce("label", "id").alias("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id; null ids stay."""
    class_id, key = free_name(docs, "class_id"), free_name(docs, "class_doc")
    found = classes(docs, id_col, text_col).where(f"{id_col} = class_id")
    kept = found.select(F.col(id_col).alias(key), F.col("class_id").alias(class_id))
    marked = docs.join(kept, docs[id_col] == kept[key], "left")
    return marked.where(F.col(class_id).isNotNull() | F.col(id_col).isNull()).select(*docs.columns)
