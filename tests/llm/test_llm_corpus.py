"""Operators 3, 4, 5, 8 and 10 and the pipeline against brute force, with odd input."""

import collections
import hashlib
import itertools
import math
import random
import tempfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from renalytics.llm import kdtree, line_dedup, mixing, order_minhash, queries, syncmers

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, label string, class_id string, n_lines string, epoch string, bucket int"


def frame(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x", 1) for i, t, s in rows], SCHEMA).repartition(3)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


# ---- near duplicates ------------------------------------------------------------------------------------

def brute_classes(texts):
    grams = {i: order_minhash.kmers(order_minhash.words_of(t)) for i, t in texts.items() if t is not None}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(grams), 2):
        same = order_minhash.words_of(texts[a]) == order_minhash.words_of(texts[b])
        if same or order_minhash.similarity(grams[a], grams[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicate_classes(spark):
    rng = random.Random(5)
    texts, n = {}, 0
    for group in range(12):  # originals, copies and copies of copies with a few edits each
        base = sentence(rng, 60 + 10 * group).split()
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 1)] = [sentence(rng, 1)]
            texts[n] = " ".join(copy)
            n += 1
            if rng.random() < 0.3:
                base = copy
    passage = sentence(rng, 55)
    for _ in range(25):  # a shared passage is not a near copy
        texts[n] = f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}"
        n += 1
    for t in ("", "", None, None, "one two", "One two!", "$$$ ###", "w " * 20_000, "w " * 19_000, sentence(rng, 30_000)):
        texts[n] = t
        n += 1
    rows = [(i, t, "s") for i, t in texts.items()] + [(None, "one two", "s"), (3, texts[3], "s")]
    got = order_minhash.classes(frame(spark, rows)).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.class_id for r in got} == brute_classes(texts)
    kept = order_minhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert collections.Counter(ids)[None] == 1 and {i for i in ids if i is not None} == set(brute_classes(texts).values())
    assert order_minhash.classes(frame(spark, rows).limit(0)).count() == 0


def test_ids_with_two_texts_tie_classes(spark):
    rng = random.Random(6)
    a, b = sentence(rng, 40), sentence(rng, 40)
    got = order_minhash.classes(frame(spark, [(5, a, "s"), (5, b, "s"), (2, a, "s"), (7, b, "s"), (9, a, "s")])).collect()
    assert {r.doc_id: r.class_id for r in got} == {2: 2, 5: 2, 7: 2, 9: 2}


def test_alignment_needs_order_and_band():
    words = [f"w{i}" for i in range(100)]
    a = order_minhash.kmers(words)
    assert order_minhash.similarity(a, a) == 1.0
    one = order_minhash.kmers([*words[:50], "new", *words[51:]])
    assert order_minhash.similarity(a, one) == pytest.approx(91 / (96 + 96 - 91))
    assert order_minhash.similarity(a, order_minhash.kmers(words[50:] + words[:50])) == 0.0
    assert order_minhash.similarity(a, order_minhash.kmers(words[:50])) == 0.0


def plain_similarity(a, b):
    """By the longest common subsequence of the k-mers, without band, labels or bits."""
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1] / (len(a) + len(b) - row[-1])


def test_alignment_of_texts_that_repeat_themselves():
    rng = random.Random(21)
    linked = crossed = 0
    for _ in range(150):
        lines = [sentence(rng, rng.randint(3, 12)).split() for _ in range(rng.randint(1, 6))]
        a = [w for _ in range(rng.randint(4, 20)) for w in rng.choice(lines)]
        b = list(a)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice([["new"], [], [rng.choice(a)]])
        one, two = (order_minhash.kmers(x) for x in (a, b))
        want = plain_similarity(one.tolist(), two.tolist())
        assert order_minhash.similarity(one, two) == pytest.approx(want if want >= 0.8 else 0.0)
        assert order_minhash.similarity(two, one) == pytest.approx(want if want >= 0.8 else 0.0)
        linked += want >= 0.8
        crossed += want >= 0.8 and len(set(one.tolist())) < 0.7 * len(one)
    assert linked > 50 and crossed > 20


def test_short_texts_need_no_bucket(spark):
    rng = random.Random(22)
    texts, n = {}, 0
    while n < 6:  # texts of 8 and 9 words that share 4 of 5 k-mers and yet no sketch
        long = sentence(rng, 9)
        one, two = (order_minhash.kmers(long.split()[:k]) for k in (8, 9))
        if not set(order_minhash.sketch_keys(one)) & set(order_minhash.sketch_keys(two)):
            texts |= {n: " ".join(long.split()[:8]), n + 1: long}
            n += 2
    got = order_minhash.classes(frame(spark, [(i, t, "s") for i, t in texts.items()])).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i in texts}


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    rng = random.Random(2)
    rng.shuffle(links)
    got = {r.node: r.label for r in order_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200, 300: 300}


# ---- fingerprints ---------------------------------------------------------------------------------------

def brute_syncmers(spark, words):
    """Positions of the closed syncmers, with Spark's hash read back."""
    inner = [r[0] for r in spark.createDataFrame([(i, words[i], words[i + 1]) for i in range(len(words) - 1)], "i int, a string, b string")
             .orderBy("i").select(F.xxhash64("a", "b")).collect()]
    w = syncmers.K - syncmers.S + 1
    return [i for i in range(len(inner) - w + 1) if min(inner[i:i + w]) in (inner[i], inner[i + w - 1])]


def test_syncmer_positions(spark):
    words = sentence(random.Random(8), 80).split()
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    anchors = df.select(syncmers.closed_syncmers(syncmers.symbols(F.col("text")))).first()[0]
    assert [a & 0xFFFFFF for a in anchors] == brute_syncmers(spark, words)


def test_edited_likeness(spark):
    rng = random.Random(9)
    rows = [(i * 7 - 300, sentence(rng, rng.choice([0, 1, 3, 40, 200])) + rng.choice(["", " é😀\n", "　"]), "s") for i in range(1300)]
    rows += [(0, None, "s"), (20_000, sentence(rng, 20_000), "s"), (None, "null id", "s"), (7, "again", "s"), (7, "again", "s")]
    got = syncmers.edited_likeness(frame(spark, rows).select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    texts = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = collections.Counter()
    for (i, t), (_, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        cut = len(t) // 4
        want[i, len(t), hashlib.sha256((t[:len(t) - cut] + following[:cut]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 600]
    assert np.mean([r.near_edited for r in long]) > 0.5 and np.mean([r.near_next for r in long]) < 0.05
    prints = collections.defaultdict(set)
    for r in syncmers.fingerprints(frame(spark, rows)).collect():
        prints[r.doc_id].add(r.fingerprint)
    assert prints[7] == prints[7] and len(prints[7]) <= 3 and prints[0] == {""} | prints[0]
    single = syncmers.edited_likeness(frame(spark, [(1, "abcdefgh", "s")]).select("doc_id", "text")).first()
    assert single.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert syncmers.edited_likeness(frame(spark, []).select("doc_id", "text")).count() == 0


def test_sketches_with_a_common_head(spark):
    """Sketches that share the work on their head equal those of the whole texts, also at the seam and for short texts."""
    rng = random.Random(14)
    heads = ["", " ", "a", "abcdefg", "abcdefgh", "a b\n😀", *("".join(rng.choice("ab é😀\n") for _ in range(n)) for n in range(40)), sentence(rng, 90)]
    tails = ["", "\t", "h", "hijklmn", sentence(rng, 3), sentence(rng, 60)]
    df = spark.createDataFrame([(h, a, b) for h in heads for a, b in zip(tails, tails[1:] + tails[:1], strict=True)], "h string, a string, b string")
    got = syncmers.sketches(df, "h", {"x": F.col("a"), "y": F.col("b")})
    assert got.columns == ["h", "a", "b", "x", "y"] and got.count() == len(heads) * len(tails)
    assert got.where((F.col("x") != syncmers.sketch(F.concat("h", "a"))) | (F.col("y") != syncmers.sketch(F.concat("h", "b")))).count() == 0


def test_texts_without_blanks_go_by_characters(spark):
    rng = random.Random(12)
    long = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    rows = [(1, long, "s"), (2, long[:200] + "新" + long[200:], "s"), (3, long[::-1], "s")]
    got = {r.doc_id: r.sketch for r in frame(spark, rows).select("doc_id", syncmers.sketch(F.col("text")).alias("sketch")).collect()}
    df = spark.createDataFrame([(got[1], got[2], got[3])], "a array<long>, b array<long>, c array<long>")
    near, far = df.select(syncmers.likeness(F.col("a"), F.col("b")), syncmers.likeness(F.col("a"), F.col("c"))).first()
    assert near > 0.85 and far < 0.1


def test_short_and_mixed_texts_have_likeness(spark):
    rng = random.Random(13)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    rows = [(i, sentence(rng, 5 + i % 2), "s") for i in range(100)]  # five or six words
    rows += [(1000, han, "s"), (1001, sentence(rng, 100), "s")]  # without blanks, edited by a text with many
    got = {r.doc_id: r for r in syncmers.edited_likeness(frame(spark, rows).select("doc_id", "text")).collect()}
    short = [got[i] for i in range(99)]
    assert np.mean([r.near_edited > 0 for r in short]) > 0.9 and np.mean([r.near_edited for r in short]) > 0.3
    assert np.mean([r.near_next for r in short]) < 0.05
    assert got[1000].near_edited > 0.4


def test_fingerprints_stay_native(spark):
    plan = queries.QUERIES["op4_closed_syncmers"](spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# ---- mixing ---------------------------------------------------------------------------------------------

def source_rows(rng):
    sizes = {"hot": 700, "b": 120, "c": 40, None: 25, "": 8}
    texts = [(s, sentence(rng, rng.randint(0, 30))) for s, n in sizes.items() for _ in range(n)]
    rows = [(i, t, s) for i, (s, t) in enumerate(texts)]
    return rows + [(None, None, "c"), (5, rows[5][1], "hot"), (90_000, sentence(rng, 5000), "b")]


def test_exponent_meets_targets(spark):
    tokens = {"a": 9000, "b": 700, "c": 200, "d": 40}
    sources = spark.createDataFrame([(k, v) for k, v in tokens.items()], "source string, tokens long")
    p = np.array(list(tokens.values())) / sum(tokens.values())

    def entropy(a):
        w = p ** a / (p ** a).sum()
        return -(w * np.log(w)).sum()

    a = mixing.exponent(sources, 0.8, None)
    assert entropy(a) == pytest.approx(0.8 * math.log(4), abs=1e-6)
    a = mixing.exponent(sources, 0.99, 3.0)  # the repetition limit wins
    assert (p.max() / p.min()) ** (1 - a) == pytest.approx(3.0, abs=1e-6)
    assert mixing.exponent(sources, 0.05, None) == 1.0 and mixing.exponent(sources, None, 1e9) == 1.0
    assert mixing.exponent(sources.limit(1), 0.9, 2.0) == 1.0 and mixing.exponent(sources.limit(0), 0.9, 2.0) == 1.0


def test_mix_realises_weights(spark):
    rows = source_rows(random.Random(4))
    docs = frame(spark, rows)
    table = {r.source: r for r in mixing.weights(docs, target_entropy=0.95, max_epochs=6.0).collect()}
    assert len(table) == 5 and sum(r.weight for r in table.values()) == pytest.approx(1)
    mixed = mixing.slots(mixing.mix(docs, target_entropy=0.95, max_epochs=6.0, block_tokens=2000))
    got = mixed.collect()
    tokens = collections.Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    for s, r in table.items():
        longest = 5001 if s == "b" else 31
        assert r.epochs >= 1 - 1e-9 and r.epochs <= 6 + 1e-6
        assert 0 <= tokens[s] - r.epochs * r.tokens <= longest  # the last document may cross the end
    per_epoch = collections.Counter((r.source, r.epoch) for r in got)
    for s, r in table.items():
        assert per_epoch[s, 0] == r.docs  # nothing is left out
    assert {r.doc_id for r in got} == {i for i, _, _ in rows}
    for (s, e), _ in per_epoch.items():  # places follow one another without gaps, each epoch in its own order
        own = sorted((r.start, r.n_tokens) for r in got if (r.source, r.epoch) == (s, e))
        assert own[0][0] == e * table[s].tokens
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(own))
    orders = [[r.doc_id for r in sorted(got, key=lambda r: r.start) if r.source is None and r.epoch == e] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]
    blocks = collections.defaultdict(list)
    for r in got:
        blocks[r.block].append(r.slot)
        assert r.block == math.floor(r.start / (table[r.source].weight * 2000))
    assert all(sorted(b) == list(range(len(b))) for b in blocks.values())


def test_mix_budget_and_empty(spark):
    docs = frame(spark, source_rows(random.Random(4)))
    few = mixing.mix(docs, target_entropy=None, max_epochs=None, total_tokens=3000).collect()
    assert 2900 < sum(r.n_tokens for r in few) < 3000 + 5001 + 4 * 31 and {r.epoch for r in few} == {0}
    assert mixing.mix(docs.limit(0)).count() == 0


# ---- lines ----------------------------------------------------------------------------------------------

def brute_lines(rows, least=10):
    first = {}
    holders = collections.defaultdict(set)
    for i, t, _ in rows:
        if i is not None:
            for k in line_dedup.line_keys(t or "")[1]:
                if len(k.decode()) >= least:
                    holders[k].add(i)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = []
    for i, t, _ in rows:
        lines, keys = line_dedup.line_keys(t or "")
        kept = [x for x, k in zip(lines, keys, strict=True) if i is None or first.get(k, i) == i]
        out.append((i, None if t is None else b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1 << 28, 1 << 16])
def test_line_dedup(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "MAX_FILTER_BITS", bits)
    monkeypatch.setattr(line_dedup, "SEGMENT_BITS", min(bits, line_dedup.SEGMENT_BITS))
    rng = random.Random(3)
    lines = [sentence(rng, rng.randint(1, 5)) for _ in range(60)] + ["ÀÉÎÕÜàéîõü", "ÀÉÎÕÜàéîõ", "tab\tinside line", "", "   "]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t\x0b"]) + rng.choice([str, str.upper])(rng.choice(lines)) + rng.choice(["", "\r", " "])
                          for _ in range(rng.randint(0, 8))), "s") for i in range(150)]
    rows += [(500, None, "s"), (501, "", "s"), (None, lines[0] * 3, "s"), (502, lines[0] * 3, "s"), (3, rows[3][1], "s"),
             (600, "\n".join(["a very common long line"] * 5000), "s"), (601, "A very common long line ", "s"), (602, "x" * 300_000, "s")]
    got = line_dedup.drop_repeated_lines(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "source", "label", "class_id", "epoch", "bucket", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute_lines(rows)
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0


# ---- top k ----------------------------------------------------------------------------------------------

def brute_top(vectors, is_query, k):
    out = []
    for q, v in vectors.items():
        if is_query(q):
            scores = sorted((-int(np.dot(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_exact(spark):
    rng = np.random.default_rng(1)
    vectors = {i: (rng.integers(-6, 7, 5) / 8).tolist() for i in range(900)}
    vectors |= {i: [0.5, 0.25, 0.0, 0.0, 0.0] for i in range(1000, 1300)}  # a common vector: ties
    vectors |= {2000: [1.0, 2.0], 2050: [1.0, -1.0], 2100: [float("nan")] * 5, 2150: None, 2200: [None] * 5, 2250: [float("inf")] * 5, 2300: []}
    rows = [(i, v, 1) for i, v in vectors.items()] + [(None, [1.0] * 5, 1), (0, vectors[0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int").repartition(4)
    usable = {i: np.floor(np.array(v) * 256).astype(int) for i, v in vectors.items()
              if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    got = kdtree.top_k(df, F.col("id") % 50 == 0, k=5, shard_rows=150, block_queries=7).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(usable, lambda i: i % 50 == 0, 5)
    few = kdtree.top_k(df.where("vec_id < 3"), F.col("id") >= 0, k=5).collect()
    assert len(few) == 6
    assert kdtree.top_k(df.limit(0), F.col("id") >= 0).count() == 0


def test_box_bounds_hold():
    rng = np.random.default_rng(4)
    points = rng.integers(-9, 9, (500, 4))
    tree = kdtree.Tree(points.astype(float), [[i] for i in range(500)])
    queries_ = rng.integers(-9, 9, (20, 4)).astype(float)
    bounds = tree.bounds(queries_)
    for node, (a, b) in enumerate(zip(tree.start, tree.stop, strict=True)):
        assert (bounds[:, node] >= (queries_ @ tree.points[a:b].T).max(axis=1)).all()


# ---- SQL twins and the pipeline -------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twin(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_pipeline_stages(spark):
    """Each stage by its own brute force: what it must drop goes, everything else stays as it was."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1)).withColumn("block", F.lit("b"))
    place, kept = tempfile.mkdtemp(prefix="renalytics-pipeline-"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns) and (name == "bpe" or out.columns == docs.columns)
        out.write.parquet(f"{place}/{name}")
        before, docs = docs, spark.read.parquet(f"{place}/{name}")
        kept.append((name, before.collect(), docs.collect()))
    stages = {name: (a, b) for name, a, b in kept}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in stages["toxicity"][0]} - {r.doc_id for r in stages["toxicity"][1]}
    assert len(gone & toxic) >= 0.6 * len(toxic) and len(gone) < 0.25 * len(stages["toxicity"][0])
    a, b = stages["line_dedup"]
    assert sorted((r.doc_id, r.text) for r in b) == sorted((i, t) for i, t, _, _ in brute_lines([(r.doc_id, r.text, 0) for r in a]))
    a, b = stages["near_dedup"]
    assert {r.doc_id for r in b} == set(brute_classes({r.doc_id: r.text for r in a}).values())
    a, b = stages["mixing"]
    assert {r.doc_id for r in a} == {r.doc_id for r in b} and max(collections.Counter(r.doc_id for r in b).values()) <= 2
    assert len(stages["bpe"][1]) == len(b)


def test_pipeline_rejects_what_operator_2_predicts(spark, monkeypatch):
    from renalytics.llm import toxicity
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for score, kept in ((0.35, 0), (0.25, 20)):
        model = toxicity.ToxicityModel({}, {}, (math.log(score / (1 - score)), 0.0, 0.0, 0.0))
        monkeypatch.setattr(toxicity, "train", lambda *_, model=model: model)
        assert corpus_pipeline.reject_toxic(spark, docs, SF).count() == kept


def test_registered():
    names = E.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
