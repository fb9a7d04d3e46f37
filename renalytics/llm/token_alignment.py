"""Alignment of two tokenizers over the same bytes (operator 11).

Both tokenizers write a text as tokens whose bytes, joined, are the text (with one blank in front).  Where a token of A
and a token of B end at the same byte, the text is cut; what lies between two cuts is a group, and every A token of a
group is linked to every B token of it.  The common ends come from a galloping intersection: each end of the shorter
list is sought in the longer one by doubling steps from the last hit and a binary search inside the last step.  The
ranks of a common end in both lists cut the groups; their differences are the numbers of overlapping tokens.

A text is cut before single blanks that follow a non-blank character.  No pretoken of A and no vocabulary piece of B
reaches over such a place (checked when the files are loaded), so each distinct chunk is encoded and aligned once while
the worker's bounded memo holds it; elsewhere a whole text is one chunk.  Whole texts are aligned.

Corpus counts (in how many documents is an id pair linked) are exact.  Documents are packed into blocks of
about ``BLOCK_LINKS`` (document, id pair) entries: each block names its pairs once, documents hold positions in that
list.  Only the pairs of blocks, already added up inside, are shuffled for the counts, and the counts go back to the
blocks, not to the occurrences.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from renalytics.llm.common import slices, tokenizer_path
from renalytics.session import shared_path

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
MEMO_ENTRIES = 200_000    # chunks of a worker's memo; what was used last is kept
MEMO_CHARS = 30_000_000   # characters of its chunks and groups
MEMO_CHUNK = 64           # longer chunks are forgotten first
LEARN_CHUNKS = 5_000      # chunks that are aligned at once
BIG_GROUP = 4_096         # links from which a group is counted by distinct ids
BLOCK_LINKS = 1_000_000   # (document, pair) entries from which a block is closed
BLANK = "▁"          # how piece vocabularies write a blank
CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
NO_CUT = re.compile(r"\s(?= )| \Z")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
# Fixed value: how the public byte-level pre-tokeniser cuts a text.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def gallop(ends, targets, start, stop):
    """For each target the first place in ``start <= place < stop`` whose end is not below it, else ``stop``.

    ``ends`` ascends strictly.  All targets go in step: doubling strides from ``start`` until an end is not below the
    target, then a binary search inside the last stride.
    """
    import numpy as np
    lo, hi, step = start.copy(), start.copy(), 1
    live = np.arange(len(targets))
    while len(live):
        live = live[hi[live] < stop[live]]
        live = live[ends[hi[live]] < targets[live]]
        lo[live] = hi[live] + 1
        hi[live] += step
        step *= 2
    hi = np.minimum(hi, stop)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        below = ends[mid] < targets[live]
        lo[live] = np.where(below, mid + 1, lo[live])
        hi[live] = np.where(below, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def common_ends(a_ends, b_ends, a_counts, b_counts):
    """Places (in a, in b) of the ends that both lists hold, for many chunks whose lists follow one another.

    In each chunk the shorter list drives the search in the longer one.
    """
    import numpy as np
    first = {"a": np.cumsum(a_counts) - a_counts, "b": np.cumsum(b_counts) - b_counts}
    found = []
    for mine, other, ends, counts, others, drives in (("a", "b", a_ends, a_counts, b_counts, a_counts <= b_counts),
                                                      ("b", "a", b_ends, b_counts, a_counts, a_counts > b_counts)):
        chunk = np.repeat(np.arange(len(counts)), counts)
        own = np.flatnonzero(drives[chunk])
        chunk = chunk[own]
        sought = b_ends if mine == "a" else a_ends
        stop = first[other][chunk] + others[chunk]
        at = gallop(sought, ends[own], first[other][chunk], stop)
        hit = np.flatnonzero(at < stop)
        hit = hit[sought[at[hit]] == ends[own[hit]]]
        found.append((own[hit], at[hit]) if mine == "a" else (at[hit], own[hit]))
    a, b = (np.concatenate(side) for side in zip(*found, strict=True))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def spread(starts, sizes):
    """The places start, start + 1, .. of each run, one run after the other."""
    import numpy as np
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class Aligner:
    """The two tokenizers and the memo of aligned chunks.

    The memo has one row per chunk: token, group and link counts, the written groups, and a run of ``codes`` (A id << 32 |
    B id) with the number of links of each (``times``).  Rows of chunks that a tokenizer does not give back have
    ``groups`` None.
    """

    COUNTS = ("n_a", "n_b", "n_groups", "n_links", "first", "n_codes", "used")

    def __init__(self, path_a: str, path_b: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = self._letters(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = b"".join(letters[c] if c in letters else c.encode() for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes.fromhex(m[1]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(BLANK, " ").encode() for p in pieces]
        self.quick = self._by_rank(path_a)
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        self.written = [[str(i) for i in range(len(side))] for side in (self.a_bytes, self.b_bytes)]
        # Cutting before a blank is right if no piece holds a blank behind another character.
        self.cuts = not any(x != BLANK and y == BLANK for p in pieces for x, y in zip(p, p[1:], strict=False))
        self.clock = 0
        self._empty()

    @staticmethod
    def _letters(level) -> dict[str, bytes]:
        """How the byte-level alphabet writes each byte, read off characters that hold all bytes of UTF-8.

        The other bytes (C0, C1, F5 to FF) are in no text but have entries; the alphabet writes them as the characters of
        their numbers.
        """
        out = {}
        for c in map(chr, [*range(0x800), *range(0x800, 0x10000, 0x400), *range(0x10000, 0x110000, 0x4000)]):
            if not 0xD800 <= ord(c) < 0xE000:
                for letter, byte in zip(level.pre_tokenize_str(c)[0][0], c.encode(), strict=True):
                    out[letter] = bytes([byte])
        known = set(out.values())
        return out | {chr(x): bytes([x]) for x in range(256) if bytes([x]) not in known}

    def _by_rank(self, path: str):
        """A's file for the tiktoken library, which encodes short chunks faster; None where ids are not merge ranks."""
        import json

        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, pre = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        if not plain or merged != sorted(merged) or len(vocab) - len(merged) < 256 or merged[0] < 256:
            return None
        special = {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {self.a_bytes[i]: i for i in vocab.values() if i not in special}
        return tiktoken.Encoding("a", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _a_ids(self, chunks: list[str]) -> list[list[int]]:
        if self.quick is not None and max(map(len, chunks)) <= MEMO_CHUNK:
            return list(map(self.quick, chunks))
        return [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]

    def _empty(self) -> None:
        import numpy as np
        self.rows: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.table = {c: np.zeros(0, np.int64) for c in self.COUNTS}
        self.codes, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.weight = 0

    def chunks(self, text: str) -> list[str]:
        """Parts of blank + text that both tokenizers encode on their own."""
        whole = " " + text
        if not self.cuts:
            return [whole]
        if NO_CUT.search(whole):
            return CUT.split(whole)
        return [" " + w for w in text.split(" ")]

    def look_up(self, chunks: list[str]):
        """Memo rows of chunks, each of which begins with a blank (B adds that one itself)."""
        import numpy as np
        if len(self.rows) > MEMO_ENTRIES or self.weight > MEMO_CHARS:
            self._forget()
        self.clock += 1
        new = [c for c in dict.fromkeys(chunks) if c not in self.rows]
        for part in ([c for c in new if len(c) <= MEMO_CHUNK], [c for c in new if len(c) > MEMO_CHUNK]):
            for start in range(0, len(part), LEARN_CHUNKS):
                self._learn(part[start:start + LEARN_CHUNKS])
        rows = np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))
        self.table["used"][rows] = self.clock
        return rows

    def _forget(self) -> None:
        """Keep the rows used last, half of what fits, and no long chunk."""
        import numpy as np
        names = list(self.rows)
        short = np.array([len(c) <= MEMO_CHUNK for c in names])
        latest = np.argsort(-np.where(short, self.table["used"], -1), kind="stable")[:MEMO_ENTRIES // 2]
        stay = np.sort(latest[short[latest]])
        first, n_codes = self.table["first"][stay], self.table["n_codes"][stay]
        at = spread(first, n_codes)
        groups, table, codes, times = self.groups, self.table, self.codes[at], self.times[at]
        self._empty()
        self.rows = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.groups = [groups[i] for i in stay.tolist()]
        self.table = {c: v[stay] for c, v in table.items()}
        self.table["first"] = np.cumsum(n_codes) - n_codes
        self.codes, self.times = codes, times
        self.weight = sum(len(c) for c in self.rows) + sum(len(g or "") for g in self.groups)

    def _learn(self, chunks: list[str]) -> None:
        from itertools import chain

        import numpy as np
        bytes_of = [c.encode("utf-8", "surrogatepass") for c in chunks]
        sides = [self._a_ids(chunks), self.b.encode([c[1:] for c in chunks], num_threads=1)]
        want = np.fromiter(map(len, bytes_of), np.int64, len(chunks))
        counts = [np.fromiter(map(len, side), np.int64, len(chunks)) for side in sides]
        flat = [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(sides, counts, strict=True)]
        ends = [np.cumsum(sizes[ids]) for sizes, ids in zip(self.sizes, flat, strict=True)]
        whole = b"".join(bytes_of)
        given_back = all(
            np.array_equal(np.append(0, end)[np.cumsum(n)], np.cumsum(want)) and b"".join(map(strings.__getitem__, ids.tolist())) == whole
            for end, n, strings, ids in zip(ends, counts, (self.a_bytes, self.b_bytes), flat, strict=True))
        if not given_back:
            if len(chunks) > 1:  # find the chunks that are not
                half = len(chunks) // 2
                self._learn(chunks[:half])
                self._learn(chunks[half:])
            else:
                self._add(chunks, [None], {c: np.zeros(1, np.int64) for c in self.COUNTS}, flat[0][:0], flat[0][:0])
            return
        (n_a, n_b), (a_ids, b_ids) = counts, flat
        a_at, b_at = common_ends(*ends, n_a, n_b)
        a_from, b_from = np.append(0, a_at[:-1] + 1), np.append(0, b_at[:-1] + 1)
        a_over, b_over = a_at + 1 - a_from, b_at + 1 - b_from  # overlap: differences of ranks
        links = a_over * b_over
        chunk = np.repeat(np.arange(len(chunks)), n_a)[a_at]
        n_groups = np.bincount(chunk, minlength=len(chunks))
        until = np.append(0, np.cumsum(links))[np.append(0, np.cumsum(n_groups))]

        big = np.flatnonzero(links > BIG_GROUP)
        small = np.where(links > BIG_GROUP, 0, links)
        group = np.repeat(np.arange(len(links)), small)
        k = spread(np.zeros(len(small), np.int64), small)
        codes = a_ids[a_from[group] + k // b_over[group]] << 32 | b_ids[b_from[group] + k % b_over[group]]
        times, of = np.ones(len(codes), np.int64), chunk[group]
        for g in big.tolist():  # distinct ids of a large group: at most the vocabularies, however long it is
            x, m = np.unique(a_ids[a_from[g]:a_at[g] + 1], return_counts=True)
            y, n = np.unique(b_ids[b_from[g]:b_at[g] + 1], return_counts=True)
            codes = np.append(codes, (x[:, None] << 32 | y[None, :]).ravel())
            times = np.append(times, (m[:, None] * n[None, :]).ravel())
            of = np.append(of, np.full(len(x) * len(y), chunk[g]))
        if len(big):
            order = np.argsort(of, kind="stable")
            codes, times, of = codes[order], times[order], of[order]
        n_codes = np.bincount(of, minlength=len(chunks))
        self._add(chunks, self._groups(a_ids, b_ids, a_from, a_at, b_from, b_at, n_groups), {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.diff(until), "first": np.cumsum(n_codes) - n_codes,
            "n_codes": n_codes, "used": np.full(len(chunks), self.clock)}, codes, times)

    def _groups(self, a_ids, b_ids, a_from, a_at, b_from, b_at, n_groups) -> list[str]:
        """The written groups of each chunk."""
        a, b = ([names[i] for i in ids.tolist()] for names, ids in zip(self.written, (a_ids, b_ids), strict=True))
        made = [f"{a[i] if i == i1 else ','.join(a[i:i1 + 1])}|{b[j] if j == j1 else ','.join(b[j:j1 + 1])}"
                for i, i1, j, j1 in zip(a_from.tolist(), a_at.tolist(), b_from.tolist(), b_at.tolist(), strict=True)]
        out, at = [], 0
        for n in n_groups.tolist():
            out.append(made[at] if n == 1 else ";".join(made[at:at + n]))
            at += n
        return out

    def _add(self, chunks, groups, counts, codes, times) -> None:
        import numpy as np
        start = len(self.rows)
        self.rows.update(zip(chunks, range(start, start + len(chunks)), strict=True))
        self.groups.extend(groups)
        counts["first"] = counts["first"] + len(self.codes)
        self.table = {c: np.concatenate([self.table[c], counts[c]]) for c in self.COUNTS}
        self.codes, self.times = np.concatenate([self.codes, codes]), np.concatenate([self.times, times])
        self.weight += sum(map(len, chunks)) + sum(len(g or "") for g in groups)

    def documents(self, texts: list[str | None]) -> dict:
        """Counts, digests and pairs of whole texts: one entry per text, and its pairs as (document, code, links)."""
        import numpy as np
        parts = [self.chunks(t) if t else [] for t in texts]
        rows = self.look_up([c for p in parts for c in p])
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        starts = np.append(0, ends[:-1])
        written, whole = [], np.ones(len(texts), bool)
        for d, (i, j) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            groups = [self.groups[r] for r in rows[i:j].tolist()]
            whole[d] = i < j and None not in groups
            written.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if whole[d] else "")
        doc = np.repeat(np.arange(len(texts)), ends - starts)
        made = {"groups_sha256": written}
        for c in ("n_a", "n_b", "n_groups", "n_links"):
            until = np.append(0, np.cumsum(self.table[c][rows]))
            made[c] = np.where(whole, until[ends] - until[starts], 0)
        doc, rows = doc[whole[doc]], rows[whole[doc]]
        held, k = np.unique(doc * len(self.rows) + rows, return_counts=True)
        doc, rows = np.divmod(held, max(1, len(self.rows)))
        n_codes = self.table["n_codes"][rows]
        at = spread(self.table["first"][rows], n_codes)
        codes, place = np.unique(self.codes[at], return_inverse=True)
        pair = np.repeat(doc, n_codes) * len(codes) + place
        links = self.times[at] * np.repeat(k, n_codes)
        order = np.argsort(pair, kind="stable")
        pair, links = pair[order], links[order]
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[:len(pair)])
        doc, place = np.divmod(pair[new], max(1, len(codes)))
        return made | {"codes": codes, "doc": doc, "place": place, "links": np.add.reduceat(links, new) if len(new) else links}


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def packed(values) -> tuple[bytes, int]:
    """Whole numbers as bytes, as narrow as they go, and the bytes of each."""
    import numpy as np
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return values.astype(f"<u{width}").tobytes(), width


def block_row(number: int, parts: list[tuple]) -> dict:
    """Documents (ids, ``Aligner.documents``) as one row: their columns as arrays, their pairs by place in the block's codes."""
    import numpy as np
    codes = np.unique(np.concatenate([p["codes"] for _, p in parts]))
    places = [np.searchsorted(codes, p["codes"])[p["place"]] for _, p in parts]
    docs = np.zeros(len(codes), np.int64)
    for p in places:
        docs += np.bincount(p, minlength=len(codes))
    out = {"block": number, "codes": codes, "code_docs": docs, "doc_id": [i for ids, _ in parts for i in ids],
           "groups_sha256": [x for _, p in parts for x in p["groups_sha256"]],
           "n_pairs": np.concatenate([np.bincount(p["doc"], minlength=len(ids)) for ids, p in parts])}
    for c in ("n_a", "n_b", "n_groups", "n_links"):
        out[c] = np.concatenate([p[c] for _, p in parts])
    out["places"], out["places_width"] = packed(np.concatenate(places))
    out["times"], out["times_width"] = packed(np.concatenate([p["links"] for _, p in parts]))
    return out


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_a: str = TOKENIZER_A,
          tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """Blocks of aligned documents, written to shared storage and read back.

    A is a byte-level BPE file of the tokenizers library, B a sentencepiece model that adds a blank in front.
    Each row is a block: ``codes`` (A id << 32 | B id) of its distinct linked pairs, ``code_docs`` in how many of its
    documents each is linked, and per document its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and
    its pairs (``places`` in ``codes``) with the number of links of each (``times``).  Null and empty texts, and texts
    that a tokenizer does not give back byte by byte, have no tokens.  Repeated rows stay repeated and count each.
    """
    path_a, path_b = tokenizer_path(tokenizer_a), tokenizer_path(tokenizer_b)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"block long, codes array<long>, code_docs array<long>, doc_id array<{id_type}>, groups_sha256 array<string>, "
              "n_pairs array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
              "places binary, places_width int, times binary, times_width int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        both, number, parts, links = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, [], 0

        def finished(id_kind) -> pa.RecordBatch:
            kinds = {"block": pa.int64(), "doc_id": pa.list_(id_kind), "groups_sha256": pa.list_(pa.string()), "places": pa.binary(),
                     "places_width": pa.int32(), "times": pa.binary(), "times_width": pa.int32()}
            row = block_row(number, parts)
            return pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.list_(pa.int64()))) for c in row], names=list(row))

        id_kind = None
        for whole in batches:
            id_kind = whole.schema.field("id").type
            for batch in slices(whole, ["text"]):
                found = both.documents(batch.column("text").to_pylist())
                parts.append((batch.column("id").to_pylist(), found))
                links += len(found["place"])
                if links >= BLOCK_LINKS:
                    yield finished(id_kind)
                    parts, links, number = [], 0, number + 1
        if parts:
            yield finished(id_kind)

    path = shared_path(docs.sparkSession, "token-alignment")
    made = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    made.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(code, a, count, best): in how many documents of the corpus an id pair is linked; best of its A id, ties included."""
    counts = (blocks.select(F.inline(F.arrays_zip("codes", "code_docs"))).groupBy(F.col("codes").alias("code"))
              .agg(F.sum("code_docs").alias("count")))
    # An A id has at most as many pairs as B has ids.
    a = F.shiftright("code", 32)
    return counts.withColumn("a", a).withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def link_counts(blocks: DataFrame) -> DataFrame:
    """One row per aligned document with ``n_best`` (links whose pair is the best of its A id) and ``count_sum`` over links."""
    id_type = blocks.schema["doc_id"].dataType.elementType.simpleString()
    used = blocks.select("block", F.posexplode("codes").alias("at", "code"))
    found = used.join(pair_counts(blocks), "code").select(F.col("block").alias("of"), "at", "count", "best")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np
        n_codes = right.num_rows
        count, best = np.zeros(n_codes, np.int64), np.zeros(n_codes, bool)
        at = right.column("at").to_numpy()
        count[at] = right.column("count").to_numpy()
        best[at] = right.column("best").to_numpy(zero_copy_only=False)
        out = []
        for i in range(left.num_rows):
            row = left.slice(i, 1)
            value = {c: row.column(c)[0] for c in row.column_names}
            places, times = (np.frombuffer(value[c].as_py(), f"<u{value[f'{c}_width'].as_py()}").astype(np.int64) for c in ("places", "times"))
            n_pairs = np.asarray(value["n_pairs"].values)
            owner = np.repeat(np.arange(len(n_pairs)), n_pairs)
            n_best, total = np.zeros(len(n_pairs), np.int64), np.zeros(len(n_pairs), np.int64)
            np.add.at(n_best, owner, np.where(best[places], times, 0))
            np.add.at(total, owner, count[places] * times)
            out.append(pa.table([*(value[c].values for c in columns), pa.array(n_best), pa.array(total)],
                                names=[*columns, "n_best", "count_sum"]))
        return pa.concat_tables(out) if out else None

    narrow = blocks.select("block", *columns, "n_pairs", "places", "places_width", "times", "times_width")
    schema = (f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return narrow.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(finish, schema)
