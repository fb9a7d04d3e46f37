"""Toxicity by a weighted finite-state pattern grammar (operator 2).

Words become tags through a lexicon; transducers for negation, reported speech and target rewrite the
insult and threat tags of a clause by their context, and their composition is one machine over tags.
What is scored is a matched clause: the weight of its insult words plus the weight of the symbol that the
machine wrote for them (a bare, negated, reported or aimed insult or threat).  A document's score is a
logistic function of its best clause and the number of matched ones.

Insult words, the weights of the symbols and the logistic are learned from a bounded sample of
labelled texts.  A word's support is counted in distinct neighbouring words, not in documents, so copies of
one toxic text do not turn its vocabulary into insults.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renalytics.llm.common import fit_on_sample, labelled_sample, scored_columns

FIT_ROWS = 12_000      # labelled documents that a model is fitted on, about
LEAST_SUPPORT = 3
LEAST_WEIGHT = 1.5
THRESHOLD = 0.3

# Closed word classes in English, French, German and Spanish.
NEGATION = set("not no never neither nor isn't aren't wasn't don't doesn't ne pas jamais ni nicht kein keine nie niemals nunca jamás tampoco".split())
REPORT = set("said says say told tells wrote writes called claimed quoted quote dit disait écrit sagte sagt schrieb dijo dice escribió".split())
TARGET = set("you your yours yourself u he she they him her them tu te toi vous votre il elle ils elles du dich dir ihr euch sie er usted ustedes él ella ellos ellas".split())
THREAT = set("kill hurt destroy shoot stab burn beat punch hang tuer frapper brûler töten schlagen schießen matar golpear quemar".split())

WORDS = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»„]")
CLAUSES = re.compile(r"[.!?;\n\r]+")
QUOTES = set("\"“”«»„")


class Transducer:
    """Deterministic letter transducer: arcs (state, symbol) -> (state, written symbol); others pass unchanged."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))

    def states(self) -> set:
        return {self.start} | {s for s, _ in self.arcs} | {s for s, _ in self.arcs.values()}


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The machine that feeds what ``first`` writes to ``second``, over ``alphabet``."""
    arcs = {}
    for a in first.states():
        for b in second.states():
            for symbol in alphabet:
                to_a, middle = first.step(a, symbol)
                to_b, out = second.step(b, middle)
                if (to_a, to_b, out) != (a, b, symbol):
                    arcs[(a, b), symbol] = ((to_a, to_b), out)
    return Transducer(arcs, (first.start, second.start))


def negation(span: int = 3) -> Transducer:
    """A negation word marks insults and threats among the next ``span`` words."""
    arcs = {}
    for left in range(span + 1):
        arcs[left, "neg"] = (span, "neg")
        for symbol in ("word", "target", "report"):
            arcs[left, symbol] = (max(0, left - 1), symbol)
        for symbol in ("insult", "threat"):
            arcs[left, symbol] = (max(0, left - 1), f"{symbol} negated" if left else symbol)
    return Transducer(arcs)


def reported() -> Transducer:
    """After a verb of speech or an opening quote, matches are reported; a closing quote ends that."""
    arcs = {(0, "report"): (1, "report"), (0, "quote"): (2, "quote"), (1, "quote"): (2, "quote"), (2, "quote"): (0, "quote")}
    for match in ("insult", "threat", "insult negated", "threat negated"):
        arcs[1, match] = (1, f"{match} reported")
        arcs[2, match] = (2, f"{match} reported")
    return Transducer(arcs)


def aimed() -> Transducer:
    """A target word before a match, or right after it, aims it."""
    arcs = {}
    matches = [f"{m}{n}{r}" for m in ("insult", "threat") for n in ("", " negated") for r in ("", " reported")]
    arcs[0, "target"] = (1, "target")
    for m in matches:
        arcs[0, m] = (m, m)
        arcs[1, m] = (1, f"{m} aimed")
        arcs[m, "target"] = (1, f"{m} aimed")
        for other in ("word", "neg", "report", "quote"):
            arcs[m, other] = (0, other)
        for again in matches:
            arcs[m, again] = (again, again)
    return Transducer(arcs)


TAGS = ("word", "neg", "report", "quote", "target", "insult", "threat")


def grammar() -> Transducer:
    return compose(compose(negation(), reported(), TAGS), aimed(), TAGS)


class ToxicityModel:
    """Lexicon, symbol weights and logistic; scores a whole text."""

    def __init__(self, lexicon: dict[str, float], symbols: dict[str, float] | None = None,
                 logistic: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)):
        self.lexicon, self.symbols, self.logistic = lexicon, symbols or {}, logistic
        self.machine = grammar()
        self.heads = set(lexicon) | THREAT

    def tag(self, word: str) -> str:
        if word in self.lexicon:
            return "insult"
        for name, words in (("threat", THREAT), ("neg", NEGATION), ("report", REPORT), ("target", TARGET), ("quote", QUOTES)):
            if word in words:
                return name
        return "word"

    def matches(self, text: str) -> list[tuple[str, str, float]]:
        """(clause, best symbol, score) of each clause that holds an insult or threat."""
        found = []
        for clause in CLAUSES.split(text):
            words = WORDS.findall(clause.lower())
            if self.heads.isdisjoint(words):
                continue
            state, weight, best = self.machine.start, 0.0, []
            for word in words:
                tag = self.tag(word)
                if tag in ("insult", "threat"):
                    weight = self.lexicon.get(word, 1.0)
                state, out = self.machine.step(state, tag)
                if out.startswith(("insult", "threat")):
                    best.append((weight + self.symbols.get(out, 0.0), out))
            score, symbol = max(best)
            found.append((clause.strip(), symbol, score))
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        text = text or ""
        if self.heads.isdisjoint(WORDS.findall(text.lower())):
            return (0.0, 0.0, 0.0)
        scores = [s for _, _, s in self.matches(text)]
        return (1.0, max(scores), math.log(len(scores))) if scores else (0.0, 0.0, 0.0)

    def score(self, text: str | None) -> float:
        z = self.logistic[0] + sum(w * x for w, x in zip(self.logistic[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def learn_lexicon(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """Words far commoner, in distinct neighbours, in toxic texts than in others."""
    around: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
    for text, label in zip(texts, toxic, strict=True):
        before = ""
        for word in WORDS.findall(text.lower()):
            if label or word in around[1]:
                around[label][word].add(before)
            before = word
    for text, label in zip(texts, toxic, strict=True):
        if not label:  # toxic vocabulary is now complete
            before = ""
            for word in WORDS.findall(text.lower()):
                if word in around[1]:
                    around[0][word].add(before)
                before = word
    totals = [max(1, len(texts) - sum(toxic)), max(1, sum(toxic))]
    lexicon = {}
    for word, contexts in around[1].items():
        if len(contexts) >= LEAST_SUPPORT and word not in NEGATION | REPORT | TARGET | QUOTES:
            weight = math.log((len(contexts) + 0.5) / totals[1]) - math.log((len(around[0][word]) + 0.5) / totals[0])
            if weight >= LEAST_WEIGHT:
                lexicon[word] = weight
    return lexicon


def _logistic(rows: list[tuple[float, ...]], labels: list[int], ridge: float = 0.05) -> tuple[float, ...]:
    """Newton steps of a ridge logistic regression with a free constant."""
    import numpy as np
    x = np.column_stack([np.ones(len(rows)), np.array(rows, float).reshape(len(rows), -1)])
    y, w = np.array(labels, float), np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + penalty @ w), -4, 4)
    return tuple(float(v) for v in w)


def fit(texts: list[str | None], labels: list[float]) -> ToxicityModel:
    """A model of labelled texts: symbols and logistic are fitted on a third that the lexicon did not see."""
    import zlib
    rows = {t or "": int(y) for t, y in zip(texts, labels, strict=True)}  # an exact copy counts once
    held = {t: zlib.crc32(t.encode("utf-8", "surrogatepass")) % 3 == 0 for t in rows}
    part = [(t, y) for t, y in rows.items() if not held[t]]
    rest = [(t, y) for t, y in rows.items() if held[t]] or part
    trial = ToxicityModel(learn_lexicon([t for t, _ in part], [y for _, y in part]))
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for t, y in rest:
        for symbol in {s for _, s, _ in trial.matches(t)}:
            seen[symbol][y] += 1
    prior = math.log((sum(y for _, y in rest) + 1) / (sum(1 - y for _, y in rest) + 1))
    for symbol, (clean, bad) in seen.items():
        trial.symbols[symbol] = math.log((bad + 1) / (clean + 1)) - prior
    logistic = _logistic([trial.features(t) for t, _ in rest], [y for _, y in rest]) if rest else (0.0,) * 4
    return ToxicityModel(learn_lexicon(list(rows), list(rows.values())), trial.symbols, logistic)


def train(docs: DataFrame, labels_df: DataFrame, keep: Column | None = None, max_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on about ``max_rows`` labelled rows that ``keep`` admits; an empty sample gives score 0.5 to all."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels_df, "toxic", max_rows, keep)
    return fit_on_sample(sample, fit, "text", "label")


def score_documents(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with ``score`` double and ``predicted`` int (1 from ``threshold`` on).

    Whole texts are scored; a null text counts as empty; repeated rows stay; an empty table gives an
    empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of the bounded fit sample

    def score(texts):
        scores = [shared.value.score(t) for t in texts]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]

    return scored_columns(docs, score, [text_col], "score double, predicted int", keep)
