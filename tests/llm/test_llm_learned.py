"""Operators 2, 7 and 9: grammar, machine, language model; held-out accuracy and odd input."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from renalytics.llm import factorisation, langid, queries, toxicity
from renalytics.llm.common import tokenizer_path

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None), (2, "", 0), (3, "   \n\n", -5), (4, "123 456 !!!", None), (4, "123 456 !!!", None),
       (None, "no id", 3), (5, "word " * 60_000, 300_000), (6, "x" * 200_000, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, n_chars long")
    return df.withColumn("score", F.lit("own")).withColumn("predicted", F.lit("own")).withColumn("lang_pred", F.lit("own"))


def test_grammar_contexts():
    model = toxicity.ToxicityModel({"idiot": 3.0, "clown": 2.0})
    symbols = [s for _, s, _ in model.matches(
        "An idiot here. You idiot! He is not an idiot; she said the idiot. I will kill you\nA kind clown said so. “The clown”")]
    assert symbols == ["insult", "insult aimed", "insult negated aimed", "insult reported aimed", "threat aimed",
                       "insult", "insult reported"]
    assert model.matches("A kind person. Nothing here, said you.") == []
    machine = toxicity.grammar()
    for word in itertools.product(toxicity.TAGS, repeat=3):  # composing equals running one after the other
        parts = [toxicity.negation(), toxicity.reported(), toxicity.aimed()]
        states, state = [p.start for p in parts], machine.start
        for tag in word:
            out = tag
            for i, p in enumerate(parts):
                states[i], out = p.step(states[i], out)
            state, written = machine.step(state, tag)
            assert written == out


def test_copies_do_not_make_insults():
    clean = [f"good day number{i} to all of them again" for i in range(60)]
    bad = [f"w{i} scum v{i}" for i in range(20)] + ["rare phrase of one copied toxic text"] * 50
    lexicon = toxicity.learn_lexicon(clean + bad, [0] * 60 + [1] * 70)
    assert "scum" in lexicon and "phrase" not in lexicon


def held_out(spark, name, label):
    truth = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.QUERIES[name](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    return rows.join(truth, "doc_id").where("held_out").select("predicted", "score", label).collect()


def test_toxicity_held_out(spark):
    rows = held_out(spark, "op2_toxicity", "toxic")
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    assert sum(r.predicted and r.toxic for r in rows) >= 0.6 * sum(r.toxic for r in rows)


def test_quality_held_out(spark):
    rows = held_out(spark, "op7_quality", "quality")
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_language_held_out(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.QUERIES["op9_language"](spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_sum_of_squares_identity():
    machine = factorisation.FactorisationMachine(3)
    rng = np.random.default_rng(3)
    machine.w[:] = rng.normal(size=machine.w.shape)
    machine.v[:] = rng.normal(size=machine.v.shape)
    dense, words = rng.normal(size=(4, 3)), [np.array(x, np.int32) for x in ([1, 9, 30], [], [5], [2, 3, 4, 5])]
    z = machine.raw(dense, np.concatenate(words), np.cumsum([len(w) for w in words]))
    for i in range(4):
        at = [0, 1, 2, *(words[i] + 3)]
        x = [*np.clip(dense[i], -4, 4), *[1 / math.sqrt(max(1, len(words[i])))] * len(words[i])]
        pairs = sum(machine.v[a] @ machine.v[b] * x[m] * x[n] for (m, a), (n, b) in itertools.combinations(enumerate(at), 2))
        assert z[i] == pytest.approx(machine.bias + sum(machine.w[a] * v for a, v in zip(at, x, strict=True)) + pairs)


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "▁ab": 5, "ba": 6}
    p = np.array([.1, .2, .3, .05, .15, .1, .1, langid.UNKNOWN])[:, None]

    def brute(word):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            head = word[:n]
            q = p[pieces[head], 0] if head in pieces else langid.UNKNOWN if n == 1 else 0
            total += q * brute(word[n:]) if q else 0
        return total

    words = ["ab", "aba", "bab", "axb", "b"]
    logs = langid.Lattice(words, pieces, 3).word_logs(p)
    assert logs[:, 0] == pytest.approx([math.log(brute("▁" + w)) for w in words])
    lattice = langid.Lattice(["abab"], pieces, 3)
    counts = lattice.expected(p, np.ones((1, 1)))[:, 0]
    assert sum(counts[i] * len(s) for s, i in pieces.items()) == pytest.approx(5)  # every character in one piece


def test_odd_rows_and_empty_tables(spark, odd):
    grammar = toxicity.ToxicityModel({"scum": 2.0})
    machine = factorisation.fit(["a b c", "d | e |"], [None, 4], [1.0, 0.0])
    language = langid.fit(tokenizer_path(langid.VOCABULARY))(["the house of the word", "la maison de la mer"], ["en", "fr"])
    for frame, n in ((odd, len(ODD)), (odd.limit(0), 0)):
        toxic = toxicity.score_documents(frame, grammar, ["doc_id", "score"]).collect()
        assert len(toxic) == n and all(0 <= r.score <= 1 for r in toxic)
        for model in (machine, None):
            quality = factorisation.score_documents(frame, model, ["doc_id", "predicted"]).collect()
            assert len(quality) == n and all(0 <= r.score <= 1 for r in quality)
        found = langid.predict_documents(frame, language, ["doc_id", "lang_pred"]).collect()
        assert len(found) == n
        assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 4)) for r in found)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    plain = odd.select("doc_id", "text", "n_chars").withColumn("lang", F.lit(None).cast("string"))
    assert toxicity.train(plain, labels).score("anything") == 0.5
    assert factorisation.train(plain, labels) is None
    assert langid.train(plain).predict(["some text"]) == (["und"], [0.0])


def test_numerals_are_no_letters_and_tiny_shares_choose_rows(spark):
    assert langid.words_of("①② ½ ² ٣ _ 12") == [] and langid.words_of("a①b ②c d½") == ["a", "b", "c", "d"]
    ids = spark.range(200_000).toDF("doc_id")
    for share in (0.5, 0.01, 0.0005):
        n = ids.where(langid.in_share("doc_id", share)).count()
        assert abs(n - share * 200_000) < 6 * (share * 200_000) ** 0.5
    assert ids.where(langid.in_share("doc_id", 1.0)).count() == 200_000
    tiny = langid.in_share("doc_id", 1500 / 10 ** 12)  # 1,500 of 10^12 texts: a threshold above the least hash
    assert ids.where(tiny | langid.in_share("doc_id", 1e-9)).count() <= 1
