"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and adds a shallow tree over that feature's bins to its lookup table;
the strongest pairs of features then get tables of their own the same way. A score is the sum of the looked-up bins
through the logistic function. The model is fitted on at most SAMPLE labelled rows, those of smallest hash; the scoring
covers all documents.

Defined results: null text counts as empty; an empty text gets the score of its bins like any other; repeated rows score
alike; without labels every score is 0.5, with one class only it is that class; an empty table gives an empty result.
Only doc_id and text enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import features as f
from .common import map_arrow
from .toxicity import labelled_sample, with_doubles

#: Most labelled rows that the model is fitted on.
SAMPLE = 24_000
NAMES = ("log_chars", "log_words", "word_length", "capitals", "digits", "symbols", "stops", "shouts", "accents", "breaks", "short_words", "distinct_words", "distinct_triples", "dup_lines", "sentence_words", "punct")


def features(texts: pa.Array) -> np.ndarray:
    """One row of NAMES per text, from the whole text."""
    c, n_words = f.byte_counts(texts)
    out = np.zeros((len(n_words), len(NAMES)))
    chars = c.sum(1) - c[:, f.TAIL]
    letters = np.maximum(c[:, f.UPPER] + c[:, f.LOWER] + c[:, f.LEAD], 1)
    size, words = np.maximum(chars, 1), np.maximum(n_words, 1)
    out[:, 0], out[:, 1] = np.log1p(chars), np.log1p(n_words)
    out[:, 2] = (chars - c[:, f.SPACE] - c[:, f.BREAK]) / words
    out[:, 3], out[:, 8] = c[:, f.UPPER] / letters, c[:, f.LEAD] / letters
    for j, k in ((4, f.DIGIT), (5, f.SYMBOL), (6, f.STOP), (7, f.SHOUT), (9, f.BREAK), (15, f.PUNCT)):
        out[:, j] = c[:, k] / size
    out[:, 14] = n_words / (c[:, f.STOP] + c[:, f.SHOUT] + 1)
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        w = t.split()
        if w:
            out[i, 10] = sum(len(x) <= 3 for x in w) / len(w)
            out[i, 11] = len(set(w)) / len(w)
            out[i, 12] = len(set(zip(w, w[1:], w[2:], strict=False))) / max(len(w) - 2, 1)
            lines = [x for x in t.split("\n") if x.strip()]
            out[i, 13] = 1 - len(set(lines)) / max(len(lines), 1)
    return out


@dataclass
class Additive:
    bins: int = 48
    coarse: int = 12
    rounds: int = 120
    pair_rounds: int = 60
    pairs: int = 8
    rate: float = 0.1
    start: float = 0.0
    cuts: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        self.start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        if y.min() == y.max():
            return self
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                margin += self._step(table, b[:, j], y, margin)[b[:, j]]
        self._choose_pairs(b, y, margin)
        for _ in range(self.pair_rounds):
            for j, k, dj, dk, table in self.pair_tables:
                cell = dj[b[:, j]] * table.shape[1] + dk[b[:, k]]
                flat = table.reshape(-1)
                margin += self._cells(flat, cell, y, margin, table.shape)[cell]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)

    def _sums(self, index: np.ndarray, y: np.ndarray, margin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return np.bincount(index, y - p, size), np.bincount(index, np.maximum(p * (1 - p), 1e-6), size)

    def _step(self, table: np.ndarray, index: np.ndarray, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """A tree of up to three leaves over the ordered bins; returns what it adds to each bin."""
        g, h = self._sums(index, y, margin, len(table))
        edges = [0, len(table)]
        for _ in range(2):
            best = (1e-3, None)
            for a, e in zip(edges, edges[1:], strict=False):
                if e - a < 2:
                    continue
                gl, hl = np.cumsum(g[a:e])[:-1], np.cumsum(h[a:e])[:-1]
                gs, hs = g[a:e].sum(), h[a:e].sum()
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], a + k + 1)
            if best[1] is None:
                break
            edges = sorted([*edges, best[1]])
        add = np.concatenate([np.full(e - a, self.rate * g[a:e].sum() / (h[a:e].sum() + 1)) for a, e in zip(edges, edges[1:], strict=False)])
        table += add
        return add

    def _coarse(self, j: int) -> np.ndarray:
        n = len(self.cuts[j]) + 1
        return np.minimum(np.arange(n) * self.coarse // n, self.coarse - 1)

    def _choose_pairs(self, b: np.ndarray, y: np.ndarray, margin: np.ndarray) -> None:
        """The pairs whose cells leave most of the residual unexplained."""
        gains = []
        for j, k in combinations(range(len(self.cuts)), 2):
            cell = self._coarse(j)[b[:, j]] * self.coarse + self._coarse(k)[b[:, k]]
            g, h = self._sums(cell, y, margin, self.coarse**2)
            gains.append(((g**2 / (h + 5)).sum(), j, k))
        for _, j, k in sorted(gains, reverse=True)[: self.pairs]:
            self.pair_tables.append((j, k, self._coarse(j), self._coarse(k), np.zeros((self.coarse, self.coarse))))

    def _cells(self, flat: np.ndarray, cell: np.ndarray, y: np.ndarray, margin: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """A depth-two tree over the pair: one cut of the first feature, then one of the second on either side."""
        g, h = (s.reshape(shape) for s in self._sums(cell, y, margin, flat.size))
        score = lambda u, v: u**2 / (v + 5)
        best = (-1.0, None)
        for k in range(1, shape[0]):
            cut, gain = [], 0.0
            for part in (slice(0, k), slice(k, None)):
                gp, hp = np.cumsum(g[part].sum(0)), np.cumsum(h[part].sum(0))
                both = score(gp[:-1], hp[:-1]) + score(gp[-1] - gp[:-1], hp[-1] - hp[:-1])
                m = int(both.argmax())
                cut.append((part, m + 1))
                gain += both[m]
            if gain > best[0]:
                best = (gain, cut)
        add = np.zeros(shape)
        for part, m in best[1]:
            for side in (slice(0, m), slice(m, None)):
                add[part, side] = self.rate * g[part, side].sum() / (h[part, side].sum() + 5)
        flat += add.reshape(-1)
        return add.reshape(-1)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        if self.tables:
            b = self.binned(x)
            for j, table in enumerate(self.tables):
                margin += table[b[:, j]]
            for j, k, dj, dk, table in self.pair_tables:
                margin += table[dj[b[:, j]], dk[b[:, k]]]
        return 1 / (1 + np.exp(-margin))


def _mapped(names: list[str], out: list[str], compute):
    """A mapInArrow function that appends columns computed from the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = compute(batch.column(names.index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.float64()) for c in cols]], [*names, *out])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Additive:
    sample = labelled_sample(docs, labels, "quality", most)
    rows = map_arrow(sample, _mapped(sample.columns, list(NAMES), lambda t: features(t).T), with_doubles(sample, list(NAMES)))
    got = rows.select("y", *NAMES).toPandas().sort_values(["y", *NAMES])  # at most `most` rows of numbers
    return Additive().fit(got[list(NAMES)].to_numpy(), got["y"].to_numpy(float)) if len(got) else Additive()


def score(docs: DataFrame, model: Additive, out: str = "score") -> DataFrame:
    """docs with the score of every whole text in column `out`, which is replaced if it is there."""
    docs = docs.drop(out)
    boxed = docs.sparkSession.sparkContext.broadcast(model)  # lookup tables: bounded by features x bins
    return map_arrow(docs, _mapped(docs.columns, [out], lambda t: [boxed.value.score(features(t))]), with_doubles(docs, [out]))
