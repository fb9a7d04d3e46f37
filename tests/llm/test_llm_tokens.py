"""Operators 1 and 6: record files, offset index, BPE against the tokenizers library."""

import hashlib
import os
import random
import struct
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from renalytics.llm import binary_records, bpe
from renalytics.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens string, token_ids string, Frame int"
TEXTS = ["", None, " \n\t ", "Hello, worlds it's 42", "x<|endoftext|>y <|startoftext|>", "NAÏVE Éa! ΣΑΣ İ ǅ ﬁ",
         "é a b\x85c\x1cd", "don't can't I'LL 'sx ''s", "日本語 テキスト 😀👍🏽", "word " * 30_000, "a" * 5_000,
         "«q». (x), [y]: {z}| $$$### a.b.c", "\x00 \x07", "word,word, Word word."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", "t", i) for i, t in enumerate(TEXTS)] + [(None, "no id", "n", "t", 1), (3, TEXTS[3], "n", "t", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_library(library):
    codec = bpe.BpeCodec(PATH)
    rng = random.Random(1)
    alphabet = "abcdeéßñ ABC.,!?'1 \n\t$-«"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == expected(library, t)
        assert codec.decode(ids) == library.decode(expected(library, t), skip_special_tokens=False)


def test_merge_order_and_stale_entries():
    a, b, c, ab, bc, abab = range(6)
    merges = {a << 17 | b: 1 << 17 | ab, b << 17 | c: 0 << 17 | bc, ab << 17 | ab: 2 << 17 | abab}
    assert bpe.merge_symbols([a, b, c], merges) == [a, bc]  # the lower rank wins, (a, b) goes stale
    assert bpe.merge_symbols([a, b, a, b, a], merges) == [abab, a]
    assert bpe.merge_symbols([a, a, a], {a << 17 | a: ab}) == [ab, a]  # leftmost first
    assert bpe.merge_symbols([c], merges) == [c] and bpe.merge_symbols([], merges) == []


def test_encode_documents(spark, docs, library):
    out = bpe.encode_documents(docs)
    assert out.columns == ["doc_id", "text", "Frame", "token_ids", "n_tokens"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == expected(library, r.text) and r.n_tokens == len(r.token_ids) // 4
    digests = {r.doc_id: r for r in bpe.encode_documents(docs.select("doc_id", "text"), digests=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = np.array(expected(library, t), "<u4").tobytes()
        assert digests[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        text = library.decode(expected(library, t), skip_special_tokens=False)
        assert digests[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    decoded = bpe.decode_documents(out, text_col="back").where("doc_id = 3").first()
    assert decoded.back == library.decode(expected(library, TEXTS[3]), skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_records_round_trip(spark, docs, name):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path(name))
    place = tempfile.mkdtemp(prefix="renalytics-records-")
    binary_records.write_records(docs, f"{place}/records", tokenizer=name, files=4)
    binary_records.write_index(spark, f"{place}/records", f"{place}/index")
    index = binary_records.read_index(spark, f"{place}/index")
    rows = index.orderBy("file", "seq").collect()
    ids = [r.doc_id for r in rows]
    assert ids == [None] + sorted([*range(len(TEXTS)), 3])
    start = 0
    for r in rows:
        want = [*library.encode(("no id" if r.doc_id is None else TEXTS[r.doc_id]) or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens) == (start, len(want))
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    some = index.where("doc_id % 2 = 0")
    read = binary_records.read_at(spark, f"{place}/records", some).collect()
    assert len(read) == some.count()
    for r in read:
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == [*library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1]


def test_frames_detect_damage():
    good = binary_records.frame(7, 2, struct.pack("<3H", 5, 6, 7))
    assert binary_records.parse(good)[:3] == (7, 2, struct.pack("<3H", 5, 6, 7))
    assert binary_records.parse(b"xx" + good, 2)[3] == len(good) + 2
    for at in (0, 9, 13, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            binary_records.parse(bytes(bad))


def test_empty_table(spark, docs):
    assert binary_records.token_records(docs.where(F.lit(False))).count() == 0
    assert os.path.exists(PATH)


def test_tasks_leave_no_memo_behind(spark, docs):
    """Python workers are used again by later stages; what a task has remembered must not stay with them."""
    assert bpe.encode_documents(docs).count() == len(TEXTS) + 2

    def left(batches):
        import pyarrow as pa
        for _ in batches:
            held = [len(c) + len(c.letters) for c in bpe._CODECS.values()]
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int32()), pa.array([sum(held)], pa.int64())], names=["codecs", "held"])

    found = spark.range(64).repartition(8).mapInArrow(left, "codecs int, held long").collect()
    assert any(r["codecs"] for r in found) and all(r["held"] == 0 for r in found)
