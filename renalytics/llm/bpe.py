"""BPE encoding and decoding (operator 6).

Encoding runs a priority queue of merge ranks over a doubly linked list of symbols.  A merge
leaves stale entries in the queue; they are recognised by their rank, which names one pair, and
skipped.  Decoding concatenates the vocabulary strings of the ids.

A text is cut at blanks, tabs and line ends into chunks where the vocabulary marks word ends: the
tokenizer's normaliser and pre-tokeniser then drop those characters as separators, so chunks are
independent and each distinct chunk is encoded once while the (bounded) memo holds it; a task ends with an empty
memo, so that idle Python workers do not keep it beside later stages.  With other vocabularies a whole text is one chunk.  Whole texts are
encoded; memory is bounded by the memo and one Arrow batch.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from renalytics.llm.common import DEFAULT_TOKENIZER, free_name, slices, tokenizer_path

MEMO_ENTRIES = 400_000  # chunks kept per Python worker
MEMO_CHUNK = 64         # longer chunks are encoded each time
TAIL = ".,!?;:$*&#%|"   # marks that never join a letter into one piece


def merge_symbols(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Apply merges in order of rank, leftmost first among equals, until none applies.

    ``merges`` maps a pair (left << 17 | right) to (rank << 17 | merged).  Queue entries are
    (rank << 24 | place); an entry is stale when the pair now at its place has another rank.
    """
    n = len(symbols)
    find = merges.get
    queue = []
    for i in range(n - 1):
        m = find(symbols[i] << 17 | symbols[i + 1])
        if m is not None:
            queue.append((m >> 17) << 24 | i)
    if not queue:
        return symbols
    heapq.heapify(queue)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    while queue:
        entry = heapq.heappop(queue)
        i = entry & 0xFFFFFF
        j = right[i]
        if symbols[i] < 0 or j >= n:
            continue
        m = find(symbols[i] << 17 | symbols[j])
        if m is None or m >> 17 != entry >> 24:
            continue
        merged = symbols[i] = m & 0x1FFFF
        symbols[j] = -1
        after = right[i] = right[j]
        if after < n:
            left[after] = i
            m = find(merged << 17 | symbols[after])
            if m is not None:
                heapq.heappush(queue, (m >> 17) << 24 | i)
        before = left[i]
        if before >= 0:
            m = find(symbols[before] << 17 | merged)
            if m is not None:
                heapq.heappush(queue, (m >> 17) << 24 | before)
    return [x for x in symbols if x >= 0]


class ByteLetters(dict):
    """Memo letter -> its UTF-8 bytes as the byte-level alphabet writes them."""

    def __missing__(self, letter: str) -> str:
        from tokenizers import pre_tokenizers
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(letter)[0][0]
        self[letter] = written
        return written


def simple_letters(word: str) -> bool:
    """Letters only, all with a simple lower case and normal form (below U+0130)."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0130")


class BpeCodec(dict):
    """Codec of one tokenizer file; as a dict it is the memo chunk -> ids (little-endian uint32)."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids = dict(model["vocab"])
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {self.ids[a] << 17 | self.ids[b]: rank << 17 | self.ids[a + b]
                       for rank, (a, b) in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # Text to pieces is the file's own normaliser and pre-tokeniser; merging is done here.
        loaded = Tokenizer.from_file(path)
        self.normalise = loaded.normalizer.normalize_str if loaded.normalizer else str
        self.pieces = loaded.pre_tokenizer.pre_tokenize_str
        strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.letters: dict[str, list[int]] = {}
        self.byte_letters = ByteLetters()

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, written in the vocabulary's alphabet."""
        known = self.ids
        symbols = [known[c] for c in piece[:-1] if c in known]
        last = known.get(piece[-1] + self.suffix)
        return merge_symbols(symbols + [last] if last is not None else symbols, self.merges)

    def encode_letters(self, word: str) -> list[int]:
        """Ids of a lower-case run of simple letters, which is one pre-token."""
        ids = self.letters.get(word)
        if ids is None:
            piece = word if word.isascii() else "".join(map(self.byte_letters.__getitem__, word))
            ids = self.encode_piece(piece)
            if len(word) <= MEMO_CHUNK:
                self.letters[word] = ids
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        start, n = 0, len(chunk)
        while start < n:
            hit, token = n, ""
            for content in self.special:
                at = chunk.find(content, start)
                if 0 <= at < hit or at == hit and len(content) > len(token):
                    hit, token = at, content
            for piece, _ in self.pieces(self.normalise(chunk[start:hit])):
                out.extend(self.encode_piece(piece))
            if token:
                out.append(self.special[token])
            start = hit + len(token)
        return out

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(TAIL) if self.suffix else ""
        if simple_letters(core):
            ids = array("I", self.encode_letters(core.lower())).tobytes()
            if len(core) < len(chunk):
                ids += self[chunk[len(core):]]
        else:
            ids = array("I", self.encode_chunk(chunk)).tobytes()
        if len(chunk) <= MEMO_CHUNK:
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if not self.suffix:
            return self[text]
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        ids = b"".join(map(self.__getitem__, chunks))
        if len(self) > MEMO_ENTRIES:
            self.forget()
        return ids

    def forget(self) -> None:
        """Empty the memos."""
        self.clear()
        self.letters.clear()

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings of the ids, joined as the library does for a file without a decoder."""
        import numpy as np
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER,
                     ids_col: str = "token_ids", digests: bool = False) -> DataFrame:
    """Every row of ``docs`` with the ids of its whole text.

    Adds ``ids_col`` (binary, little-endian uint32) and ``n_tokens`` long; with ``digests``, instead
    of the ids, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (of the decoded text), and the text
    itself is left out.  A null or empty text has no ids and decodes to "".  Other columns pass through,
    repeated rows stay repeated, an empty table gives an empty one.  An input column with the
    name of an added one is replaced.
    """
    path = tokenizer_path(tokenizer)
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else [ids_col, "n_tokens"]
    keep = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    source = free_name(docs, "source_text")
    frame = docs.withColumn(source, docs[text_col]).select(*keep, source)
    if digests:
        keep = [c for c in keep if c != text_col]
        frame = frame.select(*keep, source)
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    kinds = {"n_tokens": "bigint", ids_col: "binary"} | {a: "string" for a in added[1:] if digests}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + "".join(f", `{a}` {kinds[a]}" for a in added)
    schema = schema.removeprefix(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        try:
            for batch in (part for whole in batches for part in slices(whole, [source])):
                made = [bpe.encode(t) for t in batch.column(source).to_pylist()]
                n = pa.array([len(b) // 4 for b in made], pa.int64())
                if digests:
                    extra = [n, pa.array([hashlib.sha256(b).hexdigest() for b in made], pa.string()),
                             pa.array([hashlib.sha256(bpe.decode(b).encode()).hexdigest() for b in made], pa.string())]
                else:
                    extra = [pa.array(made, pa.binary()), n]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + extra, names=keep + added)
        finally:
            bpe.forget()

    return frame.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ids_col: str = "token_ids", tokenizer: str = DEFAULT_TOKENIZER,
                     text_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``text_col``, the decoded text of ``ids_col``; null ids decode to ""."""
    path = tokenizer_path(tokenizer)
    keep = [c for c in encoded.columns if c.lower() != text_col.lower()]
    types = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{text_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            texts = [bpe.decode(b or b"") for b in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())],
                                             names=[*keep, text_col])

    return encoded.select(*keep).mapInArrow(run, schema)
