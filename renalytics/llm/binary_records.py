"""Token-id output as length-delimited binary records with an offset index (operator 1).

A record file is a sequence of frames, all numbers little-endian:

    length  uint64   bytes of the payload
    check   uint32   masked checksum of the 8 length bytes
    payload          doc_id int64, id width uint8 (2 or 4), null-id flag uint8, ids
    check   uint32   masked checksum of the payload
    end     0x0A     left by the line writer, so that a file can be resynchronised by eye

A masked checksum is crc32 rotated right by 15 bits plus a constant, so that a checksum stored
inside checked data does not weaken it.  Files are written by Spark's own committer (a retried or
speculated task never leaves a half file) to any file system that Spark reaches.  The offset
index is a Parquet table: file, byte offset, frame length, doc_id, token counts; a shuffled read
takes any frames in any order from it.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from renalytics.llm.bpe import TAIL, ByteLetters, simple_letters
from renalytics.llm.common import DEFAULT_TOKENIZER, slices, tokenizer_path
from renalytics.session import shared_path

MASK_DELTA = 0xA282EAD8  # fixed value of the masking rule
MEMO_ENTRIES = 400_000
MEMO_CHUNK = 64


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, width: int, ids: bytes) -> bytes:
    payload = struct.pack("<qBB", doc_id or 0, width, doc_id is None) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def parse(buffer: bytes, offset: int = 0) -> tuple[int | None, int, bytes, int]:
    """(doc_id, width, ids, end) of the frame at ``offset``; ValueError when a checksum differs."""
    head = buffer[offset:offset + 8]
    if len(head) < 8 or masked(head) != struct.unpack_from("<I", buffer, offset + 8)[0]:
        raise ValueError(f"bad frame header at byte {offset}")
    start, n = offset + 12, struct.unpack("<Q", head)[0]
    payload = buffer[start:start + n]
    if len(payload) < n or masked(payload) != struct.unpack_from("<I", buffer, start + n)[0]:
        raise ValueError(f"bad frame payload at byte {start}")
    doc_id, width, null = struct.unpack_from("<qBB", payload)
    return (None if null else doc_id), width, payload[10:], start + n + 4


class ChunkIds(dict):
    """Memo chunk -> ids of the tokenizers library, in the file's id width.

    Where the vocabulary marks word ends, the tokenizer drops blanks, tabs and line ends as separators, so
    a text's ids are those of its chunks one after another, and a chunk of letters with a tail of marks
    is the letters' ids followed by the tail's.  New runs of letters are encoded many at a time as one
    string: every word closes with its only id that carries the word-end suffix, which gives the cuts.
    Only letters whose lower case and normal form are simple (below U+0130) take that way; everything
    else goes through the whole tokenizer.  With other vocabularies whole texts are encoded.
    """

    def __init__(self, path: str):
        import numpy as np
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) <= 0xFFFF else 4
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.words = Tokenizer.from_file(path)
        self.words.no_truncation()
        self.words.no_padding()
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.byte_letters = ByteLetters()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = bool(self.suffix) and token.endswith(self.suffix)

    def _library(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in found]

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case runs of letters."""
        import numpy as np
        out = {}
        for start in range(0, len(words), 2000):
            part = words[start:start + 2000]
            joined = " ".join([w if w.isascii() else "".join(map(self.byte_letters.__getitem__, w)) for w in part])
            ids = np.array(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, f"<u{self.width}")
            raw, at = ids.tobytes(), 0
            for word, end in zip(part, ((np.flatnonzero(self.closes[ids]) + 1) * self.width).tolist(), strict=True):
                out[word] = raw[at:end]
                at = end
        return out

    def _learn(self, chunks: list[str]) -> None:
        cut, rest = [], []
        for chunk in chunks:
            core = chunk.rstrip(TAIL)
            if simple_letters(core):
                cut.append((chunk, core.lower(), chunk[len(core):]))
            else:
                rest.append(chunk)
        rest = list({*rest, *(tail for _, _, tail in cut)}.difference(self))
        self.update(zip(rest, self._library(rest), strict=True))
        letters = self._letters(list({core for _, core, _ in cut}))
        for chunk, core, tail in cut:
            self[chunk] = letters[core] + self[tail]

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; null is empty."""
        if not self.suffix:
            return self._library([t or "" for t in texts])
        cut = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = list(set().union(*cut).difference(self))
        self._learn(new)
        made = [b"".join(map(self.__getitem__, chunks)) for chunks in cut]
        if len(self) > MEMO_ENTRIES:
            self.clear()
        else:
            for chunk in new:
                if len(chunk) > MEMO_CHUNK:
                    del self[chunk]
        return made


_MEMOS: dict[str, ChunkIds] = {}


def write_records(docs: DataFrame, path: str, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 1,
                  id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Encode whole texts and write them to ``path`` as record files in ascending ``id_col`` order.

    File names ascend with the ids.  One shuffle by id range; ``files`` defaults to the number of input
    partitions.  A null or empty text is a record holding only ``end_id``; null ids come first; repeated
    ids stay repeated, ordered by text; other columns are not read; an empty table writes no records.
    """
    place = tokenizer_path(tokenizer)
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    files = files or max(1, narrow.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if place not in _MEMOS:
            _MEMOS[place] = ChunkIds(place)
        memo = _MEMOS[place]
        end = struct.pack("<H" if memo.width == 2 else "<I", end_id)
        for batch in (part for whole in batches for part in slices(whole, ["text"])):
            made = memo.texts(batch.column("text").to_pylist())
            frames = [frame(i, memo.width, b + end) for i, b in zip(batch.column("id").to_pylist(), made, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    (narrow.repartitionByRange(files, "id").sortWithinPartitions("id", "text")
     .mapInArrow(run, "frame binary").select(F.col("frame").cast("string"))
     .write.mode("error").text(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every frame of the record files: file, seq, offset, n_bytes, doc_id, n_tokens, ids_crc32.

    Both checksums of each frame are verified.  ``ids_crc32`` is the crc32 of the ids as little-endian
    unsigned 32-bit integers.  A task holds one file at a time.
    """
    schema = ("file string, seq long, offset long, n_bytes long, doc_id long, n_tokens long, "
              "file_start long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                buffer, offset, seq, tokens = memoryview(content.as_buffer()), 0, 0, 0
                rows = []
                while offset < len(buffer):
                    doc_id, width, ids, end = parse(buffer, offset)
                    values = np.frombuffer(ids, f"<u{width}").astype("<u4")
                    rows.append((name, seq, offset, end - offset, doc_id, len(values), tokens,
                                 zlib.crc32(values.tobytes())))
                    tokens += len(values)
                    offset, seq = end + 1, seq + 1
                columns = zip(*rows, strict=True) if rows else [[]] * 8
                kinds = [pa.string(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                                 names=[p.split()[0] for p in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Write the offset index of the record files at ``path`` as a Parquet table."""
    read_records(spark, path).write.mode("error").parquet(index_path)


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    """The offset index with ``start``, the number of ids of all records before each one.

    A running sum over the files (one row each, with their totals) is added to each record's own place
    in its file.
    """
    index = spark.read.parquet(index_path)
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("before"))
    return index.join(files, "file").withColumn("start", F.col("before") + F.col("file_start")).drop("before")


def read_at(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Ids of the records that ``index`` names, in a shuffled read: file, seq, doc_id, token_ids (uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for batch in batches:
            rows = []
            for name, content, wanted in zip(*(batch.column(i) for i in range(3)), strict=True):
                buffer = memoryview(content.as_buffer())
                for w in wanted.as_py():
                    doc_id, width, ids, _ = parse(buffer, w["offset"])
                    rows.append((name.as_py(), w["seq"], doc_id, np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["file", "seq", "doc_id", "token_ids"])

    wanted = index.groupBy("file").agg(F.collect_list(F.struct("seq", "offset")).alias("wanted"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return (files.join(wanted, "file").select("file", "content", "wanted")
            .mapInArrow(run, "file string, seq long, doc_id long, token_ids binary"))


def token_records(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to record files and their index in the shared folder; the index as read back."""
    spark = docs.sparkSession
    place = shared_path(spark, "token-records")
    write_records(docs, f"{place}/records", tokenizer, end_id)
    write_index(spark, f"{place}/records", f"{place}/index")
    return read_index(spark, f"{place}/index")
