"""Repeated lines across documents (operator 8).

Pass 1 hashes every line key into a once-seen Bloom filter and, where its bits were set already
by another document, into a twice-seen one.  Partitions fill their own filters; the shuffle carries
only set bit positions by filter segment, and a bit set in two partitions' once-seen filters counts as
seen twice.  Pass 2 probes the merged twice-seen filter: a key that passes is a suspected repeat, and
only suspects are shuffled, as 128-bit BLAKE2 digests, for the exact confirmation and the choice of
the first document.  A Bloom filter has no false negatives, so the result does not depend on its
size; false positives only add rows to the confirmation.

The merged filter is broadcast.  Its size follows the number of lines up to ``MAX_FILTER_BITS``
(32 MiB); beyond that more keys are suspected, nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renalytics.llm.common import free_name
from renalytics.session import cut_lineage

BLANKS = b" \t\n\x0b\x0c\r"
MIN_KEY = 10                 # code points
BITS_PER_LINE = 8
MAX_FILTER_BITS = 1 << 28
SEGMENT_BITS = 1 << 16


def line_keys(text: str) -> tuple[list[bytes], list[bytes]]:
    """(lines, keys) as UTF-8: blanks stripped at both ends, A-Z lowered (bytes.lower is ASCII only)."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [x.strip(BLANKS).lower() for x in lines]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least


def positions(hashes, bits: int):
    """The two filter bits of each 64-bit hash, as an array (n, 2)."""
    import numpy as np
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32) ^ hashes >> np.uint64(7)) & mask], axis=1)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _partial_filters(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """Per partition and segment: the bit positions set once and set twice, as uint16 arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_64_intdigest
        seen = []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys: dict[int, set] = {}
            for i, t in zip(ids, texts, strict=True):
                if t:  # repeated rows of an id are one document
                    keys.setdefault(i, set()).update(xxh3_64_intdigest(k) for k in line_keys(t)[1] if long_enough(k, least))
            found = [np.fromiter(k, np.uint64, len(k)) for k in keys.values()]
            if found:
                seen.append(np.concatenate(found))
        if not seen:
            return
        hashes, counts = np.unique(np.concatenate(seen), return_counts=True)
        once = np.unique(positions(hashes, bits))
        # A bit that two different keys share in this partition is set twice as well.
        flat, times = np.unique(positions(hashes, bits), return_counts=True)
        twice = np.union1d(np.unique(positions(hashes[counts > 1], bits)), flat[times > 1])
        rows = []
        cuts = [np.searchsorted(a, np.arange(0, bits + 1, SEGMENT_BITS, dtype=np.uint64)) for a in (once, twice)]
        for s in range(max(1, bits // SEGMENT_BITS)):
            part = [a[c[s]:c[s + 1]] % np.uint64(SEGMENT_BITS) for a, c in zip((once, twice), cuts, strict=True)]
            if len(part[0]):
                rows.append((s, *(p.astype("<u2").tobytes() for p in part)))
        columns = zip(*rows, strict=True) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)],
            names=["segment", "once", "twice"])

    return docs.mapInArrow(run, "segment int, once binary, twice binary")


def _merge_segment(rows: pa.Table) -> pa.Table:
    """The twice-seen bits of one segment over all partitions."""
    import numpy as np
    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for a, b in zip(rows.column("once").to_pylist(), rows.column("twice").to_pylist(), strict=True):
        at = np.frombuffer(a, "<u2")
        twice[at[once[at]]] = True
        once[at] = True
        twice[np.frombuffer(b, "<u2")] = True
    return pa.table({"segment": pa.array([rows.column("segment")[0].as_py()], pa.int32()),
                     "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())})


def twice_seen_filter(docs: DataFrame, least: int = MIN_KEY) -> tuple[bytes, int]:
    """(filter, bits): the merged twice-seen filter over two columns id and text; at most 32 MiB."""
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    lines = docs.agg(F.sum(breaks + 1)).first()[0] or 1
    bits = min(MAX_FILTER_BITS, max(SEGMENT_BITS, 1 << (BITS_PER_LINE * lines - 1).bit_length()))
    merged = (_partial_filters(docs, bits, least).groupBy("segment")
              .applyInArrow(_merge_segment, "segment int, bits binary"))
    filter_bytes = bytearray(bits // 8)
    for row in merged.toLocalIterator():
        start = row["segment"] * (SEGMENT_BITS // 8)
        filter_bytes[start:start + SEGMENT_BITS // 8] = row["bits"]
    return bytes(filter_bytes), bits


def _suspects(docs: DataFrame, shared, bits: int, least: int) -> DataFrame:
    """(id, key digest) of the keys that the twice-seen filter holds, once per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_64_intdigest
        twice = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    own = list({k for k in line_keys(t)[1] if long_enough(k, least)})
                    ids.extend([i] * len(own))
                    keys.extend(own)
            if not keys:
                continue
            at = positions(np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)
            hit = np.flatnonzero((twice[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).all(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[j] for j in hit], pa.int64()), pa.array([_digest(keys[j]) for j in hit], pa.binary())],
                names=["id", "key"])

    return docs.mapInArrow(run, "id long, key binary")


def repeated_keys(docs: DataFrame, least: int = MIN_KEY) -> DataFrame:
    """(id, drops): per document the digests of the keys that an earlier document holds."""
    spark = docs.sparkSession
    filter_bytes, bits = twice_seen_filter(docs, least)
    shared = spark.sparkContext.broadcast(filter_bytes)
    suspects = _suspects(docs, shared, bits, least)
    # Cut, so that the join shuffles both sides itself and can split the partition of a very common line.
    first = cut_lineage(suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                        .where("first < last").select("key", "first"))
    return (suspects.join(first, "key").where("id > first")
            .groupBy("id").agg(F.collect_set("key").alias("drops")))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        least: int = MIN_KEY) -> DataFrame:
    """``docs`` without lines that a document with a smaller id holds; adds n_lines and n_dropped.

    A line's key is the line stripped of ASCII blanks at both ends with A-Z lowered.  Keys of at least
    ``least`` code points in two documents or more lose all their lines but those of the smallest id.
    Null and empty texts are one empty line (null stays null).  Rows with a null id neither lose lines
    nor count as holders; repeated rows of an id are one document and lose the same keys.  An empty
    table gives an empty one.  Input columns named n_lines or n_dropped are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null")
    drops = repeated_keys(narrow, least)
    key, listed = free_name(docs, "drop_id"), free_name(docs, "drops")
    joined = docs.select(*keep, docs[id_col].cast("long").alias(key)).join(
        drops.select(F.col("id").alias(key), F.col("drops").alias(listed)), key, "left").select(*keep, listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, dropped = [], [], []
            for t, d in zip(batch.column(text_col).to_pylist(), batch.column(listed).to_pylist(), strict=True):
                if not d:
                    texts.append(t)
                    totals.append((t or "").count("\n") + 1)
                    dropped.append(0)
                    continue
                gone = set(d)
                lines, keys = line_keys(t or "")
                kept = [x for x, k in zip(lines, keys, strict=True) if not (len(k) >= least and _digest(k) in gone)]
                texts.append(None if t is None else b"\n".join(kept).decode("utf-8", "surrogatepass"))
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            made = {text_col: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(
                [made.get(c, batch.column(c)) for c in keep] + [pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())],
                names=[*keep, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_lines long, n_dropped long"
    return joined.mapInArrow(run, schema)
