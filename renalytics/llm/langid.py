"""Language identification by segmentation-marginalised unigrams (operator 9).

Every language has a probability for each piece of a fixed public vocabulary.  The probability of a word is
the sum, over all ways to cut it into pieces, of the product of their probabilities; a forward pass gives
it without listing the segmentations.  A text's score for a language is the sum of its words' log
probabilities; the prediction is the language with the largest, its score the posterior under equal priors.

The probabilities are learned by expectation maximisation on a bounded sample of labelled texts per
language: forward and backward sums give the expected count of every piece.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renalytics.llm.common import fit_on_sample, scored_columns, tokenizer_path

FIT_ROWS = 1500          # labelled texts per language that a model is fitted on, about
VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 3
SMOOTHING = 0.05         # added to every piece's expected count
UNKNOWN = 1e-8           # probability of a character outside the vocabulary
PART = 24                # longer words are cut into parts of so many characters
WORDS_AT_ONCE = 20_000
MEMO_WORDS = 250_000
UNDETERMINED = "und"

LETTERS = re.compile(r"[^\W\d_]+")


@cache
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """(piece -> index, longest): lower-case letter pieces; a word begins with the vocabulary's mark."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            if piece == "▁" or piece.removeprefix("▁").isalpha() and piece == piece.lower():
                pieces.setdefault(piece, len(pieces))
    return pieces, max(map(len, pieces))


def words_of(text: str) -> list[str]:
    """Runs of letters, lowered and marked at their beginning, long ones in parts."""
    found = []
    runs = LETTERS.findall(text.lower())
    if not all(map(str.isalpha, runs)):  # other numerals, such as circled ones and fractions, are no letters
        runs = [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]
    for word in runs:
        if len(word) <= PART:
            found.append(word)
        else:
            found.extend(word[i:i + PART] for i in range(0, len(word), PART))
    return found


class Lattice:
    """All pieces of some words: flat arrays of word, start, end and piece, grouped by end."""

    def __init__(self, words: list[str], pieces: dict[str, int], longest: int):
        import numpy as np
        unknown = len(pieces)
        word, start, end, piece = [], [], [], []
        lookup = pieces.get
        for w, raw in enumerate(words):
            marked = "▁" + raw
            n = len(marked)
            for a in range(n):
                for b in range(a + 1, min(n, a + longest) + 1):
                    p = lookup(marked[a:b])
                    if p is not None:
                        word.append(w)
                        start.append(a)
                        end.append(b)
                        piece.append(p)
                    elif b == a + 1:
                        word.append(w)
                        start.append(a)
                        end.append(b)
                        piece.append(unknown)
        self.word, self.start = np.array(word, np.int32), np.array(start, np.int16)
        self.end, self.piece = np.array(end, np.int16), np.array(piece, np.int32)
        self.n, self.size = len(words), np.array([len(w) + 1 for w in words])
        self.most = int(self.size.max(initial=0))

    def _groups(self, keys):
        import numpy as np
        order = np.argsort(keys, kind="stable")
        cuts = np.searchsorted(keys[order], np.arange(self.most + 2))
        return [order[cuts[i]:cuts[i + 1]] for i in range(self.most + 1)]

    def _sum(self, at, values):
        import numpy as np
        out = np.zeros((self.n, values.shape[1]))
        for column in range(values.shape[1]):
            out[:, column] = np.bincount(at, weights=values[:, column], minlength=self.n)
        return out

    def forward(self, probabilities):
        """Sums over segmentations up to each place, as (place, word, language)."""
        import numpy as np
        alpha = np.zeros((self.most + 1, self.n, probabilities.shape[1]))
        alpha[0] = 1.0
        for place, arcs in enumerate(self._groups(self.end)):
            if place and len(arcs):
                w = self.word[arcs]
                alpha[place] = self._sum(w, alpha[self.start[arcs], w] * probabilities[self.piece[arcs]])
        return alpha

    def backward(self, probabilities):
        import numpy as np
        beta = np.zeros((self.most + 1, self.n, probabilities.shape[1]))
        beta[self.size, np.arange(self.n)] = 1.0
        for place, arcs in reversed(list(enumerate(self._groups(self.start)))):
            if len(arcs):
                w = self.word[arcs]
                beta[place] += self._sum(w, beta[self.end[arcs], w] * probabilities[self.piece[arcs]])
        return beta

    def word_logs(self, probabilities):
        """Log probability of every word in every language."""
        import numpy as np
        alpha = self.forward(probabilities)
        return np.log(np.maximum(alpha[self.size, np.arange(self.n)], 1e-300))

    def expected(self, probabilities, counts):
        """Expected counts of every piece, the words weighted by ``counts`` (word, language)."""
        import numpy as np
        alpha, beta = self.forward(probabilities), self.backward(probabilities)
        total = np.maximum(alpha[self.size, np.arange(self.n)], 1e-300)
        through = (alpha[self.start, self.word] * probabilities[self.piece] * beta[self.end, self.word]
                   * (counts / total)[self.word])
        return np.column_stack([np.bincount(self.piece, weights=through[:, c], minlength=len(probabilities))
                                for c in range(through.shape[1])])


class LanguageModel:
    def __init__(self, languages: list[str], probabilities, path: str):
        self.languages, self.probabilities, self.path = languages, probabilities, path
        self.memo: dict[str, int] = {}
        self.rows = None

    def __getstate__(self):
        return {**self.__dict__, "memo": {}, "rows": None}

    def _learned(self, words: list[str]):
        """Row numbers of the words in ``rows``, new words computed in blocks."""
        import numpy as np
        new = list(set(words).difference(self.memo))
        if self.rows is None or len(self.memo) + len(new) > MEMO_WORDS:
            new, self.memo = list(set(words)), {}
            self.rows = np.zeros((0, len(self.languages)), np.float32)
        pieces, longest = vocabulary(self.path)
        made = [self.rows]
        for i in range(0, len(new), WORDS_AT_ONCE):
            part = new[i:i + WORDS_AT_ONCE]
            made.append(Lattice(part, pieces, longest).word_logs(self.probabilities).astype(np.float32))
        if new:
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
            self.rows = np.concatenate(made)
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        import numpy as np
        words = [words_of(t or "") for t in texts]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        flat = [w for own in words for w in own]
        if flat:
            logs = self.rows[at] if (at := self._learned(flat)) is not None else None
            ends = np.cumsum([len(w) for w in words])
            total = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(logs, axis=0, dtype=np.float64)])
            sums = total[ends] - total[ends - [len(w) for w in words]]
            best = sums.argmax(axis=1)
            posterior = 1 / np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -700)).sum(axis=1)
            for i, own in enumerate(words):
                if own:
                    names[i], scores[i] = self.languages[best[i]], float(posterior[i])
        return names, scores


def fit(path: str):
    def run(texts: list[str | None], languages: list[str]) -> LanguageModel:
        import numpy as np
        names = sorted(set(languages))
        pieces, longest = vocabulary(path)
        counted = [Counter() for _ in names]
        for text, name in {(t or "", n) for t, n in zip(texts, languages, strict=True)}:  # exact copies count once
            counted[names.index(name)].update(words_of(text))
        words = sorted(set().union(*counted)) if counted else []
        lattices = []
        for i in range(0, len(words), WORDS_AT_ONCE):
            part = words[i:i + WORDS_AT_ONCE]
            counts = np.array([[c[w] for c in counted] for w in part], float).reshape(len(part), len(names))
            lattices.append((Lattice(part, pieces, longest), counts))
        probabilities = np.full((len(pieces) + 1, len(names)), 1 / max(1, len(pieces)))
        probabilities[-1] = UNKNOWN
        for _ in range(ROUNDS):
            expected = SMOOTHING + sum((x.expected(probabilities, c) for x, c in lattices), np.zeros_like(probabilities))
            expected[-1] = 0
            probabilities = expected / expected.sum(axis=0)
            probabilities[-1] = UNKNOWN
        return LanguageModel(names, probabilities, path)

    return run


def in_share(id_col: str, share: float) -> Column:
    """Whether the 64-bit hash of an id lies in the first ``share`` of all hashes, however small that is."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(id_col) < F.lit(int(share * 2 ** 64) - 2 ** 63)


def train(docs: DataFrame, keep: Column | None = None, max_rows: int = FIT_ROWS,
          tokenizer: str = VOCABULARY) -> LanguageModel:
    """Fit on about ``max_rows`` texts of each language in column lang that ``keep`` admits.

    Rows are chosen by the xxhash64 of doc_id, each language by its own share; rows with a null text or
    lang are not used.  The number of languages is small by nature and is collected.
    """
    usable = docs.where(F.col("lang").isNotNull()).where(keep if keep is not None else F.lit(True))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # texts are not read
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = F.when(F.col("lang") == lang, in_share("doc_id", max_rows / n)).otherwise(chosen)
    sample = usable.where(F.col("text").isNotNull()).where(chosen)
    return fit_on_sample(sample, fit(tokenizer_path(tokenizer)), "text", "lang")


def predict_documents(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred`` string and ``score`` double.

    Every word of a whole text counts.  A null text, one without a letter, or a model that learned no
    language gives ``und`` with score 0; ties go to the first language in order of name; repeated rows
    stay; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages numbers

    def score(texts):
        names, scores = shared.value.predict(texts)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return scored_columns(docs, score, [text_col], "lang_pred string, score double", keep)
