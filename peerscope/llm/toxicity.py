"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are lexicon densities, second-person proximity, capitals, punctuation and obfuscation rates. The lexicon
is learned: words and word beginnings whose presence separates toxic from other labelled documents, counted once per
cluster of near copies so that a much-copied document does not put its words into it. The model is fitted on at most
SAMPLE labelled rows, those of smallest hash, in three parts: trees learn from two, calibration from the third, each
with a lexicon learned from the parts it doesn't look at. The scoring covers all documents.

Defined results: null text counts as empty; an empty text scores like any other row of zeros; repeated rows score
alike; without labels, or with labels of one class only, every score is that class's share (0.5 without labels); labels
repeated for an id count once (the largest); an empty table gives an empty result. Only doc_id and text enter a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, held_out, map_arrow
from .features import LOWER, SHOUT, STOP, SYMBOL, TAIL, UPPER, Memo, byte_counts

#: Most labelled rows that a model is fitted on.
SAMPLE = 24_000
#: Most entries of the lexicon.
LEXICON = 2_000

#: Second-person forms of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus su".split()
)
_OBFUSCATED = re.compile(r"[^\W\d_][*@$!0-9_.-]+[^\W\d_]")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NAMES = ("hits", "hit_rate", "strong_rate", "near_second", "second_rate", "hit_and_second", "capitals", "shouts", "stops", "symbols", "obfuscated", "log_words")


def bare(word: str) -> str:
    return _EDGE.sub("", word.lower())


def stems(word: str) -> tuple[str, ...]:
    """What the lexicon may hold of a bare word: itself, and its first four and five letters marked by an asterisk."""
    return (word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k)) if len(word) > 2 else ()


def features(texts: pa.Array, lexicon: frozenset[str], memo: Memo | None = None) -> np.ndarray:
    """One row of NAMES per text, from the whole text."""
    classes, n_words = byte_counts(texts)
    memo = memo if memo is not None else word_flags(lexicon)
    out = np.zeros((len(n_words), len(NAMES)))
    for i, t in enumerate(texts):
        words = (t.as_py() or "").split()
        if not words:
            continue
        flags = np.fromiter(map(memo.__getitem__, words), np.uint8, len(words))
        hit, second = np.flatnonzero(flags & 1), np.flatnonzero(flags & 2)
        near = 0
        if len(hit) and len(second):
            j = np.searchsorted(second, hit)
            gap = np.minimum(np.abs(second[np.minimum(j, len(second) - 1)] - hit), np.abs(hit - second[np.maximum(j - 1, 0)]))
            near = int((gap <= 4).sum())
        n = len(words)
        out[i, :6] = np.log1p(len(hit)), len(hit) / n, np.count_nonzero(flags & 8) / n, near / n, len(second) / n, np.log1p(near)
        out[i, 10] = np.count_nonzero(flags & 4) / n
    size = np.maximum(classes.sum(1) - classes[:, TAIL], 1)
    out[:, 6] = classes[:, UPPER] / np.maximum(classes[:, UPPER] + classes[:, LOWER], 1)
    out[:, 7], out[:, 8], out[:, 9] = (classes[:, k] / size for k in (SHOUT, STOP, SYMBOL))
    out[:, 11] = np.log1p(n_words)
    return out


def word_flags(lexicon: frozenset[str]) -> Memo:
    """Bits of a word: 1 in the lexicon, 2 second person, 4 obfuscated, 8 in the lexicon as a whole word."""

    def flags(word: str) -> int:
        b = bare(word)
        plain = re.sub(r"[*@$!0-9_.-]", "", b)
        return (any(s in lexicon for s in stems(b))) | 2 * (b in SECOND_PERSON) | 4 * bool(_OBFUSCATED.search(b) and len(plain) > 2) | 8 * (b in lexicon)

    return Memo(flags)


@dataclass
class Trees:
    """Histogram-based boosting for the logistic loss; each tree is a list of (feature, cut, left, right) or leaf values."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    start: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, cuts, y - q, np.maximum(q * (1 - q), 1e-6), np.arange(len(y)), self.depth, margin)
            self.trees.append(tree)
        return self

    def _grow(self, b, cuts, g, h, rows, depth, margin):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-3, None)
        if depth and len(rows) >= 20:
            for j, c in enumerate(cuts):
                if len(c) == 0:
                    continue
                gl = np.cumsum(np.bincount(b[rows, j], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b[rows, j], h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 1) | (hs - hl < 1)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k))
        if best[1] is None:
            value = float(self.rate * gs / (hs + 1))
            margin[rows] += value
            return value
        j, k = best[1]
        left = b[rows, j] <= k
        return (j, float(cuts[j][k]), self._grow(b, cuts, g, h, rows[left], depth - 1, margin), self._grow(b, cuts, g, h, rows[~left], depth - 1, margin))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)

        def add(tree, rows):
            if not isinstance(tree, tuple):
                out[rows] += tree
            elif len(rows):
                j, cut, left, right = tree
                low = x[rows, j] <= cut
                add(left, rows[low])
                add(right, rows[~low])

        for tree in self.trees:
            add(tree, np.arange(len(x)))
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values, with half a pseudo-count per block."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order], y[order], strict=True):
        blocks.append([s, s, t, 1.0])
        while len(blocks) > 1 and (blocks[-2][1] == blocks[-1][0] or blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    knots = np.array([v for b in blocks for v in (b[0], b[1])])
    level = np.maximum.accumulate(np.array([(b[2] + 0.25) / (b[3] + 0.5) for b in blocks for _ in (0, 1)]))
    return knots, level


@dataclass
class Model:
    lexicon: frozenset[str]
    trees: Trees | None
    knots: np.ndarray
    level: np.ndarray
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        m = self.trees.margin(x)
        # Ties within a calibrated block keep the trees' order: a small part of the score is the trees' own.
        return np.clip(0.98 * np.interp(m, self.knots, self.level) + 0.02 / (1 + np.exp(-m)), 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(part, y, text) of at most `most` labelled rows outside the held-out fold, those of smallest hash.

    The sample's ids are bounded by `most`, so they are broadcast to the scan of the texts.
    """
    rank = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    rows = labels.filter(~held_out() & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    ids = rows.orderBy(rank, "doc_id").limit(most)
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(3))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(part.cast("int").alias("part"), F.col("y").cast("int").alias("y"), F.coalesce("text", F.lit("")).alias("text"))


def stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, p0, q0, p1, q1, p2, q2): in how many clusters of toxic and of other texts of each part a stem occurs."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, y, t in zip(*(batch.column(c).to_pylist() for c in ("part", "y", "text")), strict=True):
                words = [bare(w) for w in t.split()]
                # One of the smallest hashes of a text's word triples: near copies agree on it nearly always.
                cluster = min((hash3(*w) for w in zip(words, words[1:], words[2:], strict=False)), default=0)
                rows += [(s, part, y, cluster) for s in {s for w in set(words) for s in stems(w)}]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["stem", "part", "y", "cluster"])

    rows = map_arrow(sample.select("part", "y", "text"), found, "stem string, part int, y int, cluster long").distinct()
    count = lambda k, y: F.count_if((F.col("part") == k) & (F.col("y") == y)).alias(f"{'qp'[y]}{k}")
    return rows.groupBy("stem").agg(*[count(k, y) for k in range(3) for y in (1, 0)]).filter("p0 + p1 + p2 >= 3")


def learn_lexicon(counts: DataFrame, sizes: dict[tuple[int, int], int], parts: tuple[int, ...]) -> frozenset[str]:
    """Stems that are far more frequent in the toxic texts of these parts; at most LEXICON of them reach the driver."""
    n1, n0 = (sum(sizes.get((k, y), 0) for k in parts) for y in (1, 0))
    if not n1 or not n0:
        return frozenset()
    p, q = (sum((F.col(f"{c}{k}") for k in parts), F.lit(0)) for c in "pq")
    odds = F.log((p + 0.5) / n1) - F.log((q + 0.5) / n0)
    top = counts.withColumn("odds", odds).filter((p >= 3) & (F.col("odds") >= 2.5) & (q * n1 * 20 <= p * n0)).orderBy(F.desc("odds"), "stem").limit(LEXICON)
    return frozenset(r["stem"] for r in top.collect())


def with_doubles(df: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])


def hash3(a: str, b: str, c: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{a}\0{b}\0{c}") >> 1


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    sample = cut(labelled_sample(docs, labels, "toxic", most))
    sizes = {(r["part"], r["y"]): r["count"] for r in sample.groupBy("part", "y").count().collect()}
    counts = cut(stem_counts(sample))
    # Each part's features come from a lexicon of the other two, so they look as those of unseen texts do.
    others = [learn_lexicon(counts, sizes, tuple(j for j in range(3) if j != k)) for k in range(3)]

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [word_flags(w) for w in others]
        for batch in batches:
            for k in range(3):
                own = batch.filter(pc.equal(batch.column("part"), k))
                x = features(own.column("text"), others[k], memos[k])
                yield pa.RecordBatch.from_arrays([own.column("part"), own.column("y"), *[pa.array(c) for c in x.T]], ["part", "y", *NAMES])

    schema = "part int, y int, " + ", ".join(f"{n} double" for n in NAMES)
    got = map_arrow(sample, matrix, schema).toPandas().sort_values(["part", "y", *NAMES])  # at most `most` rows of numbers
    y, part, x = got["y"].to_numpy(float), got["part"].to_numpy(), got[list(NAMES)].to_numpy()
    lexicon = learn_lexicon(counts, sizes, (0, 1, 2))
    if len(y) == 0 or y.min() == y.max():
        return Model(lexicon, None, np.zeros(0), np.zeros(0), float(y[0]) if len(y) else 0.5)
    fold, rest = part < 2, part == 2
    if len(set(y[fold])) < 2 or len(set(y[rest])) < 2:  # too few rows for parts
        fold = rest = np.ones(len(y), bool)
    trees = Trees().fit(x[fold], y[fold])
    knots, level = isotonic(trees.margin(x[rest]), y[rest])
    return Model(lexicon, trees, knots, level, float(y.mean()))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with the score of every whole text in column `out`, which is replaced if it is there."""
    docs = docs.drop(out)
    names = docs.columns
    boxed = docs.sparkSession.sparkContext.broadcast(model)  # lexicon, trees and knots: bounded by the parameters

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = boxed.value
        memo = word_flags(m.lexicon)
        for batch in batches:
            s = m.score(features(batch.column(names.index("text")), m.lexicon, memo))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*names, out])

    return map_arrow(docs, scored, with_doubles(docs, [out]))
