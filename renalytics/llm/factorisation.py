"""Quality classifier: a factorisation machine over words, structure and metadata (operator 7).

Features of a document are its hashed distinct words (equal values, unit length together), statistics of
its characters and words, and its metadata length column.  The machine adds low-rank interactions
between all pairs of features; with per-factor sums s and sums of squares q they are (s*s - q) / 2, so a
document is scored in time linear in its features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renalytics.llm.common import fit_on_sample, labelled_sample, scored_columns

FIT_ROWS = 8000       # labelled documents that a model is fitted on, about
BUCKETS = 1 << 15
FACTORS = 8
EPOCHS = 4
RATE = 0.05
THRESHOLD = 0.3
MEMO_WORDS = 300_000
SLICE_CHARS = 2_000_000


class WordBuckets(dict):
    """Memo word -> hash bucket."""

    def __missing__(self, word: str) -> int:
        bucket = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


_MEMO = WordBuckets()


def buckets(text: str):
    """Hash buckets of a text's distinct lower-case words."""
    import numpy as np
    words = set(text.lower().split())
    out = np.fromiter(map(_MEMO.__getitem__, words), np.int32, len(words))
    if len(_MEMO) > MEMO_WORDS:
        _MEMO.clear()
    return out


def statistics(text: str, distinct: int, n_chars: int | None) -> list[float]:
    """Structure of a text, and its metadata length (the text's own where that is null)."""
    import numpy as np
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = max(1, len(text.split()))
    upper, lower, digit = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    lines = seen[10] + 1
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    shares = [upper / n, digit / n, marks / n, seen[33] / words, seen[124] / words, seen[44] / words, seen[46] / words,
              (seen[35] + seen[36] + seen[37] + seen[38] + seen[42]) / words, (seen[60] + seen[62]) / words,
              seen[128:].sum() / n, upper / max(1, upper + lower), distinct / words, lines / words]
    long = float(n_chars) if n_chars is not None and n_chars >= 0 else float(len(text))
    return [*map(float, shares), float(np.log1p(words)), len(raw) / words, float(np.log1p(long))]


class FactorisationMachine:
    def __init__(self, dense: int):
        import numpy as np
        noise = np.random.default_rng(7)
        self.mean, self.spread = np.zeros(dense), np.ones(dense)
        self.bias = 0.0
        self.w = np.zeros(dense + BUCKETS)
        self.v = noise.normal(0, 0.02, (dense + BUCKETS, FACTORS))

    def standard(self, dense):
        import numpy as np
        return np.clip((np.asarray(dense) - self.mean) / self.spread, -4, 4)

    def raw(self, dense, words, ends):
        """Scores before the logistic; ``words`` are the buckets of all documents, ``ends`` where each ends."""
        import numpy as np
        x, d = self.standard(dense), dense.shape[1]
        sizes = np.diff(ends, prepend=0)
        value = 1 / np.sqrt(np.maximum(sizes, 1))

        def per_document(rows):
            total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
            return total[ends] - total[ends - sizes]

        v = self.v[d:][words]
        both = per_document(np.column_stack([self.w[d:][words], v, v * v]))
        linear = x @ self.w[:d] + both[:, 0] * value
        s = x @ self.v[:d] + both[:, 1:1 + FACTORS] * value[:, None]
        q = (x * x) @ (self.v[:d] ** 2) + both[:, 1 + FACTORS:] * (value ** 2)[:, None]
        return self.bias + linear + 0.5 * (s * s - q).sum(axis=1)

    def train(self, dense, words: list, labels) -> None:
        """Adagrad over the logistic loss, one document at a time, in a fixed shuffled order."""
        import numpy as np
        dense, labels = np.asarray(dense), np.asarray(labels, float)
        self.mean, self.spread = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-6)
        x_all, d = self.standard(dense), dense.shape[1]
        gw, gv, gb = np.full(len(self.w), 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        order = np.random.default_rng(11)
        for _ in range(EPOCHS):
            for i in order.permutation(len(labels)):
                at = np.concatenate([np.arange(d), words[i] + d])
                x = np.concatenate([x_all[i], np.full(len(words[i]), 1 / np.sqrt(max(1, len(words[i]))))])
                v = self.v[at]
                s = x @ v
                z = self.bias + x @ self.w[at] + 0.5 * float(s @ s - ((x[:, None] * v) ** 2).sum())
                g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[i]
                dw = g * x + 1e-4 * self.w[at]
                dv = g * (x[:, None] * s - v * (x * x)[:, None]) + 1e-3 * v
                gb += g * g
                np.add.at(gw, at, dw * dw)
                np.add.at(gv, at, dv * dv)
                self.bias -= RATE * g / np.sqrt(gb)
                np.add.at(self.w, at, -RATE * dw / np.sqrt(gw[at]))
                np.add.at(self.v, at, -RATE * dv / np.sqrt(gv[at]))


def _rows(texts: list[str | None], lengths: list[int | None]) -> Iterator[tuple[list, list]]:
    """(dense, words) of the texts in slices that bound the arrays held at once."""
    dense, words, size = [], [], 0
    for t, n in zip(texts, lengths, strict=True):
        t = t or ""
        own = buckets(t)
        dense.append(statistics(t, len(own), n))
        words.append(own)
        size += len(t)
        if size >= SLICE_CHARS:
            yield dense, words
            dense, words, size = [], [], 0
    if dense:
        yield dense, words


def fit(texts: list[str | None], lengths: list[int | None], labels: list[float]) -> FactorisationMachine | None:
    """A machine of labelled texts, exact copies counted once; None without rows."""
    rows = {t or "": (n, y) for t, n, y in zip(texts, lengths, labels, strict=True)}
    if not rows:
        return None
    dense, words = [], []
    for d, w in _rows(list(rows), [n for n, _ in rows.values()]):
        dense += d
        words += w
    machine = FactorisationMachine(len(dense[0]))
    machine.train(dense, words, [y for _, y in rows.values()])
    return machine


def train(docs: DataFrame, labels_df: DataFrame, keep: Column | None = None,
          max_rows: int = FIT_ROWS) -> FactorisationMachine | None:
    """Fit on about ``max_rows`` labelled rows that ``keep`` admits."""
    sample = labelled_sample(docs.select("doc_id", "text", "n_chars"), labels_df, "quality", max_rows, keep)
    return fit_on_sample(sample, fit, "text", "n_chars", "label")


def score_documents(docs: DataFrame, machine: FactorisationMachine | None, keep: list[str],
                    threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with ``score`` double and ``predicted`` int (1 from ``threshold`` on).

    Reads columns text and n_chars.  A null text counts as empty, a null n_chars as the text's length;
    without a machine every score is 0.5; repeated rows stay; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # fixed size: buckets x (factors + 1)

    def score(texts, lengths):
        import numpy as np
        scores = []
        for dense, words in _rows(texts, lengths):
            if shared.value is None:
                scores.append(np.full(len(dense), 0.5))
                continue
            ends = np.cumsum([len(w) for w in words])
            z = shared.value.raw(np.array(dense), np.concatenate(words), ends)
            scores.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        scores = np.concatenate(scores) if scores else np.zeros(0)
        return [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype("i4"), pa.int32())]

    return scored_columns(docs.withColumn("n_chars", F.col("n_chars").cast("long")), score, ["text", "n_chars"],
                          "score double, predicted int", keep)
