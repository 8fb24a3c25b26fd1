"""Stupid-backoff scores, computed by joins in blocks.

S(w | v) = c(v w) / c(v) where c(v w) >= MIN_COUNT, else BACKOFF * S(w); S(w) = c(w) / N for a text's first word and for
backing off. A context longer than one word backs off a word at a time. A document's score sums log S over its words.

Documents are dealt to blocks of about BLOCK_WORDS words by a hash of their id. A block explodes its documents into
n-grams and pre-aggregates them: one entry per distinct n-gram of a block, so even an n-gram that is in every document
has few entries. Entries are partitioned by n-gram hash into buckets that hold the count tables; each bucket adds up its
n-grams and answers every block, in the order of its entries. Blocks and answers are joined by block, and the logs are
summed per document. The number of blocks and buckets follows the input, so a task's memory doesn't.

A bucket is a range of hashes and a block's entries are sorted, so its entries for a bucket are one slice; slices travel
as one row each. A block has no more slices than entries, and cutting them costs a search per slice, so the work grows
with the entries however many blocks and buckets there are.

Counts cover all documents. N-grams of all orders are compared by 64-bit hashes, in one table.

Defined results: null, empty and blank texts have n_words 0, log_score 0 and a null mean; repeated rows count and are
scored each for itself; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, ship
from .features import Memo, raw_texts

ORDER, MIN_COUNT, BACKOFF = 2, 2, 0.4
BLOCK_WORDS = 1_500_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The n-grams of some documents. grams[k][i] is the hash of the (k+1)-gram that ends at word i, 0 where it would
    cross a document's start; distinct[k] are the distinct ones, sorted."""

    def __init__(self, texts: pa.ChunkedArray, order: int):
        import xxhash

        memo = Memo(xxhash.xxh64_intdigest)
        words = []
        for t in raw_texts(texts):
            found = t.split()
            words.append(np.fromiter(map(memo.__getitem__, found), np.uint64, len(found)))
        self.lengths = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        starts = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(flat)) - np.repeat(starts, self.lengths)
        self.grams, gram = [], _mix(flat)
        for k in range(order):
            if k:
                longer = np.zeros_like(gram)
                longer[1:] = _mix(self.grams[-1][:-1] * _ODD[0] + _mix(flat[1:] + _ODD[1]))
                gram = np.where(place >= k, longer, np.uint64(0))
            self.grams.append(gram)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of all orders, sorted, and how often each occurs here."""
        every = np.concatenate(self.grams)
        return np.unique(every[every != 0], return_counts=True)

    def slices(self, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Entries and their (bucket, start, end), bucket by bucket; a bucket is a range of hashes."""
        keys, counts = self.entries()
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]))
        return keys, counts, list(zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)) if len(keys) else []

    def log_scores(self, known: np.ndarray, totals: np.ndarray, n: int, min_count: int, backoff: float) -> np.ndarray:
        """Sum of log S per document, given the corpus counts of the block's distinct n-grams."""
        count = lambda g: np.where(g != 0, totals[np.minimum(np.searchsorted(known, g), len(known) - 1)], 0).astype(float)
        if not len(known):
            return np.zeros(len(self.lengths))
        own = [count(g) for g in self.grams]
        score = own[0] / max(n, 1)
        for k in range(1, len(own)):
            context = np.concatenate([[1.0], own[k - 1][:-1]])
            seen = own[k] >= min_count
            # Without k words before it, a word has no such context and its score stands.
            score = np.where(self.grams[k] == 0, score, np.where(seen, own[k] / np.maximum(context, 1), backoff * score))
        sums = np.concatenate([[0.0], np.cumsum(np.log(score))])
        ends = np.cumsum(self.lengths)
        return sums[ends] - sums[ends - self.lengths]


def score(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """Per document: doc_id, n_words, log_score and its mean per word."""
    ship(docs.sparkSession.sparkContext)
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = docs.select(F.coalesce(F.sum(F.regexp_count(body(), F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(n / BLOCK_WORDS))
    buckets = min(max(1, math.ceil(order * n / (2 * BLOCK_WORDS))), 1 << 31)
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int").alias("block"))

    def exploded(table: pa.Table) -> pa.Table:
        keys, counts, slices = Block(table.column("text"), order).slices(buckets)
        rows = [(b, keys[lo:hi], counts[lo:hi]) for b, lo, hi in slices]
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int32()),
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
            "keys": pa.array([k.tobytes() for _, k, _ in rows], pa.large_binary()).cast(pa.binary()),
            "counts": pa.array([c.astype(np.int64).tobytes() for _, _, c in rows], pa.binary()),
        })

    def added(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, counts, len(distinct)).astype(np.int64)[where]
        ends = np.cumsum([len(k) for k in keys])
        answers = [total[e - len(k) : e].tobytes() for k, e in zip(keys, ends, strict=True)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "totals": pa.array(answers, pa.binary())})

    def summed(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts.column("text"), order)
        known, _, slices = block.slices(buckets)
        totals, place = np.zeros(len(known), np.int64), {b: (lo, hi) for b, lo, hi in slices}
        for b, x in zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True):
            lo, hi = place[b]
            totals[lo:hi] = np.frombuffer(x, np.int64)
        logs = block.log_scores(known, totals, n, min_count, backoff)
        mean = [s / k if k else None for s, k in zip(logs.tolist(), block.lengths.tolist(), strict=True)]
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(block.lengths), "log_score": pa.array(logs), "mean_log_score": pa.array(mean, pa.float64())})

    entries = dealt.groupBy("block").applyInArrow(exploded, "block int, bucket int, keys binary, counts binary")
    answers = entries.groupBy("bucket").applyInArrow(added, "block int, bucket int, totals binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(summed, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")
