"""Operators 11, 12 and 13 against brute force, with odd input."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from renalytics.llm import prefix_trie, quality_rules, token_alignment

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- token alignment ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def both():
    return token_alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """Independent tokens with their bytes: A's letters by the published rule, B's by piece."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    letter = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def a_bytes(i):
        return bytes(letter[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    return lambda t: ([(i, a_bytes(i)) for i in a.encode(" " + t, add_special_tokens=False).ids],
                      [(i, b_bytes(i)) for i in b.encode(t)])


def brute_groups(plain, text):
    if not text:
        return []
    a, b = plain(text)
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    ends = [[len(b"".join(x for _, x in side[:n + 1])) for n in range(len(side))] for side in (a, b)]
    groups, i0, j0 = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        i, j = bisect.bisect_right(ends[0], e), bisect.bisect_right(ends[1], e)
        groups.append(([x for x, _ in a[i0:i]], [x for x, _ in b[j0:j]]))
        i0, j0 = i, j
    return groups


def brute_alignment(plain, rows):
    found, docs = {}, collections.Counter()
    for i, t in rows:
        groups = brute_groups(plain, t)
        links = collections.Counter((x, y) for p, q in groups for x in p for y in q)
        docs.update(links.keys())
        found[i] = (groups, links)
    top = collections.defaultdict(int)
    for (x, _y), n in docs.items():
        top[x] = max(top[x], n)
    return {i: (sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(links.values()),
                sum(n for (x, y), n in links.items() if docs[x, y] == top[x]), sum(n * docs[p] for p, n in links.items()),
                hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g).encode()).hexdigest() if g else "")
            for i, (g, links) in found.items()}


ODD = ["", None, " ", "  ", "\n", "a", "a ", " a", "a  b", "a   b\n\n c \n d", "x\t y  z　 w", "▁", "a▁b c", "<|endoftext|> b",
       "<s> </s> <unk> <0x0A>", "naïve façade 東京 東京 ひらがな", "\U0001f600\U0001f468‍\U0001f469 é", "a\x1c b\x85 c",
       "don't it's WE'LL", "a" * 300, " " * 90 + "x" + " " * 90, "１２３ 45 6789 3.14", "tail \n", "ﬁ ﬀ Å", "\x00 \x01"]


def test_every_short_chunk_gets_the_ids_of_the_library(both):
    """Entries of bytes that no text holds (C0, C1, F5 to FF) must not stand for the characters of these numbers."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    assert both.quick is not None and sorted(b for b in both.a_bytes if len(b) == 1) == [bytes([x]) for x in range(256)]
    for pattern in (" {0}", " a{0}b", " {0}1{0}'s", " .{0}."):
        chunks = [pattern.format(chr(c)) for c in range(0x3000) if chr(c) not in "{}"]
        for chunk, want in zip(chunks, a.encode_batch(chunks, add_special_tokens=False), strict=True):
            assert both._a_ids([chunk])[0] == want.ids, chunk


def test_texts_with_characters_of_unused_bytes(spark, plain):
    rows = list(enumerate(["À la carte, où? ÷ þing ÿ ù", "ÀÁ õ÷ù ý", "plain", "À bientôt, Álvaro"]))
    got = token_alignment.link_counts(token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
            for r in got} == brute_alignment(plain, rows)


def test_gallop_finds_common_ends():
    import numpy as np
    rng = random.Random(3)
    for _ in range(60):
        chunks = [tuple(sorted(rng.sample(range(60), rng.randint(1, 40))) for _ in range(2)) for _ in range(rng.randint(1, 6))]
        sides = [np.array([100 * c + x for c, pair in enumerate(chunks) for x in pair[s]]) for s in (0, 1)]
        counts = [np.array([len(pair[s]) for pair in chunks]) for s in (0, 1)]
        a, b = token_alignment.common_ends(*sides, *counts)
        both = sorted(set(sides[0].tolist()) & set(sides[1].tolist()))
        assert sides[0][a].tolist() == sides[1][b].tolist() == both


def test_chunks_align_as_whole_texts(both, plain):
    rng = random.Random(8)
    alphabet = [" ", " ", " ", "\n", "\t", "\r", " ", " ", "\x1c", "a", "the", "Étion", "'s", "'", "語", "1", ".", "▁", "é", "́"]
    texts = [t for t in ODD if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    found = both.documents(texts)
    for t, digest in zip(texts, found["groups_sha256"], strict=True):
        assert "".join(both.chunks(t)) == " " + t
        groups = brute_groups(plain, t)
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        assert digest == (hashlib.sha256(written.encode()).hexdigest() if groups else ""), repr(t)


def test_alignment_against_brute_force(spark, plain, monkeypatch):
    rng = random.Random(1)
    words = ["the", "quick", "Überraschung", "naïve", "tokenization", "x1", "foo\n", "東京都", "...", "isn't"]
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows += [(500, "the quick the quick")] * 1
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, codes string, block int").repartition(3)
    want = brute_alignment(plain, rows)
    for big, parts in ((token_alignment.BIG_GROUP, 3), (1, 40)):  # few blocks and many; groups by occurrence and by distinct ids
        monkeypatch.setattr(token_alignment, "BIG_GROUP", big)
        got = token_alignment.link_counts(token_alignment.align(docs.repartition(parts))).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                for r in got} == want


def test_alignment_of_null_ids_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = token_alignment.link_counts(token_alignment.align(docs)).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], r["count_sum"]) for r in got) == [
        ("1", 2, 6), ("1", 2, 6), ("None", 0, 0), ("None", 2, 6)]
    assert token_alignment.link_counts(token_alignment.align(docs.where("false"))).count() == 0
    assert token_alignment.link_counts(token_alignment.align(docs.select("doc_id", F.lit("").alias("text")))).count() == 4


def test_memo_forgets_without_changing_results(both, monkeypatch):
    texts = [f"w{i % 9} common word{i % 4} " + "long" * (30 * (i % 3)) for i in range(40)] + ["", "▁", "isn't 東京都"]
    want = [both.documents([t]) for t in texts]
    monkeypatch.setattr(token_alignment, "MEMO_ENTRIES", 6)
    for t, w in zip(texts, want, strict=True):
        got = both.documents([t])
        assert len(both.rows) <= 12
        for c, v in w.items():
            assert list(got[c]) == list(v)


# ---- prefix trie ----------------------------------------------------------------------------------------

def brute_trie(turns):
    """Nodes by the contract, from rows (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(rows)] for c, rows in own.items()}
    made = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + rows[h:]  # SQL's remainder
    members = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in convs if len(made[c]) == len(node))
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, turns, **changes):
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, depth string").repartition(3)
    made = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations_of(frame)))
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
                   for r in made.collect()), key=str)


def talk(rng, n):
    """Conversations over few texts, so that prefixes repeat, with large groups of copies."""
    rows = []
    for c in range(n):
        length = 4 if c % 3 == 0 else rng.randint(0, 6)
        for t in range(length):
            words = 1 if c % 3 == 0 else rng.randint(0, 3)
            rows.append((c, t if rng.random() < 0.95 or c % 3 == 0 else None, "user" if t % 2 == 0 else None, "ja " * words or None))
    # one row for each null turn at most, so that ties do not decide
    seen, out = set(), []
    for r in rows:
        if r[:2] not in seen:
            seen.add(r[:2])
            out.append(r)
    return out


@pytest.mark.parametrize("shard_turns", [200_000, 60, 7])
def test_trie_against_brute_force(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    turns = talk(random.Random(shard_turns), 90)
    turns += [(None, 0, "user", "lost"), (-7, 1, "user", "ja"), (1000, 1, "ab", "c"), (1020, 1, "a", "bc"), (1040, 1, "a", "bc")]
    assert trie_rows(spark, turns) == brute_trie(turns)


def test_trie_of_copies_only_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 10)
    turns = [(c, t, "user", f"turn {t}") for c in range(0, 60) for t in range(3)]
    assert trie_rows(spark, turns) == brute_trie(turns)
    assert trie_rows(spark, []) == []


def test_extents_by_range_minima():
    import numpy as np
    rng = np.random.default_rng(4)
    for n in (1, 2, 9, 40):
        lcp = rng.integers(0, 4, n)
        lcp[0] = 0
        rows, depths = rng.integers(0, n, 60), rng.integers(0, 4, 60)
        left, right = prefix_trie.extents(lcp, rows, depths)
        for r, d, lo, hi in zip(rows, depths, left, right, strict=True):
            a = b = r
            while a > 0 and lcp[a] >= d:
                a -= 1
            while b + 1 < n and lcp[b + 1] >= d:
                b += 1
            assert (lo, hi) == (a, b + 1)


# ---- quality rules --------------------------------------------------------------------------------------

def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] >= 2 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_statistics_of_whole_texts(spark):
    rng = random.Random(2)
    texts = ["", None, " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "\n\n a\n a\nb \nb\n a", "#*$%&|<> x", "語  é \x0bq\x0c",
             "a\r\nb\r\n" * 3, "x " * 20_000, " ".join(rng.choice("abcdef") for _ in range(30_000)), "\U0001f600 \U0001f600"]
    texts += ["".join(rng.choice("ab \n#") for _ in range(rng.randint(0, 400))) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, made string")
    got = {r["doc_id"]: tuple(r[c] for c in (*quality_rules.BASE, "base_failed")) for r in quality_rules.measured(docs).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    from fractions import Fraction
    from math import comb
    cases = [(0, 1), (0, 66), (1, 66), (2, 200), (5, 300), (0, 0), (30, 1000), (49, 1000), (60, 1000)]
    rows = spark.createDataFrame(cases, "x long, n long").select("x", "n", quality_rules.binomial_tail(F.col("x"), F.col("n"), 0.05).alias("p"))
    p = Fraction(0.05)
    for r in rows.collect():
        want = float(sum(comb(r["n"], k) * p ** k * (1 - p) ** (r["n"] - k) for k in range(r["x"] + 1)))
        assert r["p"] == pytest.approx(want, rel=1e-9) if r["x"] < 0.05 * r["n"] else r["p"] == 1.0 >= want
    huge = spark.range(1).select(quality_rules.binomial_tail(F.lit(49_990_000), F.lit(10 ** 9), 0.05).alias("p")).first()["p"]
    assert huge == pytest.approx(0.0734, abs=2e-3)  # 1.45 standard deviations below the mean


def labelled_corpus(spark, n, share_bad, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < share_bad
        words = [("#&|" if bad and rng.random() < 0.4 else "") + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
                 for _ in range(rng.randint(60, 90))]
        docs.append((i, " ".join(words), "x", "y"))
        labels.append((i, 0 if bad else 1))
    return (spark.createDataFrame(docs, "doc_id long, text string, kept string, stratum string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels))


def test_rejects_bad_documents_within_the_limit(spark):
    docs, labels, truth = labelled_corpus(spark, 900, 0.3, 1)
    rows = quality_rules.judge(docs, labels, limit=0.05).collect()
    assert len(rows) == 900 and set(rows[0].asDict()) == {"doc_id", "stratum", *quality_rules.BASE, "base_failed", "kept"}
    kept = {r["doc_id"]: r["kept"] for r in rows}
    bad, good = ([i for i, q in truth.items() if q == v] for v in (0, 1))
    assert sum(not kept[i] for i in bad) / len(bad) > 0.95
    assert sum(not kept[i] for i in good) / len(good) <= 0.05


def test_too_few_labels_certify_nothing(spark):
    docs, labels, _ = labelled_corpus(spark, 60, 0.3, 2)
    assert all(r["kept"] for r in quality_rules.judge(docs, labels).collect())
    assert all(r["kept"] for r in quality_rules.judge(docs, labels.where("false")).collect())
    assert quality_rules.judge(docs.where("false"), labels).count() == 0


def test_each_stratum_has_its_own_level(spark):
    """In stratum b all count as good, also what looks bad, so less is rejected there; null is a stratum."""
    docs, labels, _ = labelled_corpus(spark, 1200, 0.3, 3)
    flipped = labels.withColumn("quality", F.when(F.col("doc_id") % 3 == 1, 1).otherwise(F.col("quality")))
    stratum = F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b")
    odd = labels.limit(1).select(F.lit(None).cast("long"), F.lit(0)).union(labels.limit(1).select(F.lit(5).cast("long"), F.lit(None).cast("int")))
    rows = quality_rules.judge(docs, flipped.union(odd), stratum=stratum).collect()
    lost = [sum(not r["kept"] for r in rows if r["doc_id"] % 3 == k) / 400 for k in range(3)]
    assert lost[1] <= 0.05 < min(lost[0], lost[2])


def test_false_rejections_stay_below_the_limit_over_draws(spark):
    """The certified level holds its limit: over many draws the true rate exceeds it in at most the stated share."""
    rng = random.Random(9)
    draws, rows = 200, []
    rates = [0.0, 0.01, 0.03, 0.06, 0.08, 0.1, 0.12, 0.14, 0.2, 0.25, 0.3, 0.4]  # true false rejection per level
    for d in range(draws):
        for _ in range(150):
            u = rng.random()
            rows.append((str(d), next((j for j, q in enumerate(rates) if u < q), None)))
    frame = spark.createDataFrame(rows, "stratum string, level int")
    # one stratum per draw with the whole error each: error * draws undoes the correction over strata
    got = quality_rules.certified_levels(frame, "stratum", limit=0.05, error=0.1 * draws).collect()
    wrong = sum(r["certified"] >= 3 for r in got)
    assert len(got) == draws and wrong / draws <= 0.1
    assert sum(r["certified"] >= 1 for r in got) / draws > 0.5
