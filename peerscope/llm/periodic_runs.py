"""Periodic runs of words: an online catcher of squares over completed power-of-two blocks.

A square with period q has its first half in some stretch of q words, and if 2m - 1 <= q <= 4m - 2 for a power of two m,
that stretch holds a whole aligned block of m words, which stands again q words later. So every completed block of m
words watches the windows that begin 2m - 1 to 4m - 2 words after it, and a window that ends with an appended word
has just two blocks to be compared with at each of the log n sizes. Words are appended in pieces, and a piece's windows
are compared with their blocks in one numpy operation a size, by fingerprints modulo a prime. A caught pair is extended to
both sides as far as words agree, by bisection over fingerprints; pairs that reach the last word so far stay open and go on
with the next piece. Extended squares of equal ends are one run, of the least period among them. Runs are at last
compared word by word, so a fingerprint that is equal by chance changes nothing.

Memory is some forty bytes a word of one text, or of a batch of small texts of PIECE words; time is n log n.

Defined results: a null text has no words; an empty table gives an empty result; repeated rows and null ids are judged each
as a row of its own. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow
from .features import raw_texts
from .near_dedup import _mix

#: Words that are appended at a time; texts are put together up to that many.
PIECE = 1 << 17
#: A run has at least EXPONENT periods and LEAST words.
EXPONENT, LEAST = 4, 6

_PRIME = np.uint64((1 << 31) - 1)
_BASE = 1_220_703_125


def _powers(n: int) -> np.ndarray:
    """_BASE ** i modulo the prime, for i below n."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(_BASE, done, int(_PRIME))) % _PRIME
        done += k
    return out


class SquareCatcher:
    """Appends words and catches squares of periods up to `longest`; `most` words in all."""

    def __init__(self, most: int, longest: int, exponent: int = EXPONENT):
        self.words, self.n, self.exponent = np.zeros(most, np.int64), 0, exponent
        self.power, self.prefix = _powers(most + 1), np.zeros(most + 1, np.uint64)
        self.sizes = [1 << k for k in range(longest.bit_length()) if 2 * (1 << k) - 1 <= longest]
        self.longest = longest
        self.found = np.zeros((0, 3), np.int64)  # begin, end, period

    def append(self, words: np.ndarray) -> None:
        old, n = self.n, self.n + len(words)
        self.words[old:n] = words
        values = (_mix(words.astype(np.uint64)) % (_PRIME - np.uint64(1)) + np.uint64(1)) * self.power[old:n] % _PRIME
        self.prefix[old + 1 : n + 1] = (self.prefix[old] + np.cumsum(values)) % _PRIME
        self.n = n
        open_ = self.found[self.found[:, 1] == old] if old else self.found[:0]
        caught = [open_[:, [0, 2]]]  # an open run goes on from its first word
        for m in self.sizes:
            caught.extend(self._caught(m, old))
        pairs = np.concatenate(caught)
        closed = self.found[self.found[:, 1] != old] if old else self.found
        self.found = self._merged(np.concatenate([closed, self._extended(pairs[:, 0], pairs[:, 1])]))

    def _window(self, at: np.ndarray, m: int) -> np.ndarray:
        """Fingerprints of the m words from each place, in the scale of the last place."""
        p = _PRIME
        return (self.prefix[at + m] + p - self.prefix[at]) % p * self.power[len(self.power) - 1 - at] % p

    def _caught(self, m: int, old: int) -> Iterator[np.ndarray]:
        """(block, period) of windows of m words that end behind `old` and equal a block that watches them."""
        first, last = max(old - m + 1, 2 * m - 1), self.n - m
        if first > last:
            return
        at = np.arange(first, last + 1)
        block = (at - (2 * m - 1)) // m
        low = max(int(block[0]) - 1, 0)
        blocks, windows = self._window(np.arange(low, int(block[-1]) + 1) * m, m), self._window(at, m)
        for back in (0, 1):
            b = block - back
            same = np.flatnonzero(windows == blocks[np.maximum(b - low, 0)])
            start = b[same] * m
            period = at[same] - start
            good = (start >= 0) & (period <= self.longest)
            start, period = start[good], period[good]
            # A square longer than its block goes on at one side at least, or isn't complete yet.
            end, then = start + m, start + m + period
            on = (then >= self.n) | (period == m)
            on |= self.words[end] == self.words[np.minimum(then, self.n - 1)]
            on |= (start > 0) & (self.words[start - 1] == self.words[start - 1 + period])
            yield np.stack([start[on], period[on]], axis=1)

    def _agree(self, i: np.ndarray, j: np.ndarray, room: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from i and j (i < j) on, or before them, up to `room`."""
        known, p = np.zeros(len(i), np.int64), _PRIME
        if not len(i):
            return known
        shift = self.power[j - i]
        step = 1 << (int(room.max()).bit_length() - 1) if int(room.max()) else 0
        while step:
            go = known + step <= room
            a, b = i[go] + (known[go] if forward else -known[go] - step), j[go] + (known[go] if forward else -known[go] - step)
            same = (self.prefix[a + step] + p - self.prefix[a]) % p * shift[go] % p == (self.prefix[b + step] + p - self.prefix[b]) % p
            known[np.flatnonzero(go)[same]] += step
            step >>= 1
        return known

    def _extended(self, start: np.ndarray, period: np.ndarray) -> np.ndarray:
        """(begin, end, period) of long enough and of open stretches around the pairs."""
        other = start + period
        right = self._agree(start, other, self.n - other, True)
        left = self._agree(start, other, start, False)
        begin, end = start - left, other + right
        kept = (end - begin >= self.exponent * period) | (end == self.n)
        return np.stack([begin, end, period], axis=1)[kept]

    def _merged(self, rows: np.ndarray) -> np.ndarray:
        """Of stretches with the same ends, the least period; open ones all stay, as their ends aren't known."""
        key = np.where(rows[:, 1] == self.n, np.where(rows[:, 1] - rows[:, 0] >= 2 * rows[:, 2], -1, rows[:, 2]), -1)
        rows = rows[np.lexsort((rows[:, 2], key, rows[:, 1], rows[:, 0]))]
        key = np.where(rows[:, 1] == self.n, np.where(rows[:, 1] - rows[:, 0] >= 2 * rows[:, 2], -1, rows[:, 2]), -1)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (key[1:] != key[:-1])
        return rows[new]

    def runs(self, least: int = LEAST) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs so far, by start and period, each compared word by word."""
        out: dict[tuple[int, int], int] = {}
        for begin, end, period in self.found.tolist():
            breaks = np.flatnonzero(self.words[begin : end - period] != self.words[begin + period : end]) + begin
            for a, b in zip([begin, *(breaks + 1).tolist()], [*(breaks + period).tolist(), end]):
                if b - a >= max(least, self.exponent * period):
                    out[a, b] = min(period, out.get((a, b), period))
        return sorted((a, b - a, q) for (a, b), q in out.items())


def _texts_runs(texts: list[list[bytes]], exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text; the texts are appended one after the other, with a word that occurs once between them."""
    longest = max(map(len, texts)) // exponent
    if not longest:
        return [[] for _ in texts]
    ids: dict[bytes, int] = defaultdict(count().__next__)
    total, at, begins = sum(map(len, texts)) + len(texts), 0, []
    words = np.empty(total, np.int64)
    for k, t in enumerate(texts):
        begins.append(at)
        words[at : at + len(t)] = np.fromiter(map(ids.__getitem__, t), np.int64, len(t))
        words[at + len(t)] = -1 - k
        at += len(t) + 1
    catcher = SquareCatcher(total, longest, exponent)
    for piece in range(0, total, PIECE):
        catcher.append(words[piece : piece + PIECE])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = catcher.runs(least)
    for k, (start, length, period) in zip(np.searchsorted(begins, [r[0] for r in runs], side="right") - 1, runs):
        out[k].append((start - begins[k], length, period))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _groups(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    """Split texts, in groups of about PIECE words."""
    group, size = [], 0
    for t in texts:
        words = t.split()
        if group and size + len(words) > PIECE:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words) + 1
    if group:
        yield group


def find_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs and collapsed for every text.

    runs lists (start, length, period) of every stretch of at least `least` words and `exponent` times its smallest period
    that no neighbouring word extends; collapsed is the text, words joined by one space, without the words that some run holds
    after its first period.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in _groups(raw_texts(batch.column("text"))):
                per_text = _texts_runs(group, exponent, least)
                flat = np.array([r for runs in per_text for r in runs], np.int64).reshape(-1, 3)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in per_text])]), pa.int32())
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
                kept = pa.array([_collapsed(w, r) for w, r in zip(group, per_text)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(group)), pa.array([len(w) for w in group], pa.int64()), runs, kept], ["doc_id", "n_words", "runs", "collapsed"])
                at += len(group)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), found, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
