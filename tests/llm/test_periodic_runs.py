"""Periodic runs against a scan of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from peerscope.llm import periodic_runs, queries


def slow_runs(words, exponent=4, least=6):
    """For every period, the longest stretches of words that equal the word a period on; of equal ends the least period."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def texts(seed):
    r = random.Random(seed)
    out = ["", "a", "a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "x " + "a b c " * 4 + "a b x", "a a a b " * 40]
    for _ in range(60):
        base = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            unit = [r.choice("ab") for _ in range(r.randint(1, 9))]
            long = (unit * r.randint(2, 8))[: r.randint(4, 60)]
            at = r.randint(0, len(base))
            base[at:at] = long
        out.append(" ".join(base))
    return out


@pytest.mark.parametrize("piece", [1, 3, 16, 1 << 17])
def test_all_runs_of_any_pieces(monkeypatch, piece):
    monkeypatch.setattr(periodic_runs, "PIECE", piece)
    many = [t.encode().split() for t in texts(piece)]
    for exponent, least in ((4, 6), (2, 2), (3, 1)):
        want = [slow_runs(t, exponent, least) for t in many]
        assert periodic_runs._texts_runs(many, exponent, least) == want
        assert [periodic_runs._texts_runs([t], exponent, least)[0] for t in many[:30]] == want[:30]


def test_equal_fingerprints_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_PRIME", np.uint64(7))
    monkeypatch.setattr(periodic_runs, "_BASE", 3)
    many = [t.encode().split() for t in texts(9)]
    for got, want in zip(periodic_runs._texts_runs(many, 4, 6), [slow_runs(t) for t in many]):
        assert all(r in want for r in got)  # a collision may hide a run from a prime of seven, but never makes one up


def test_long_texts_in_linear_memory():
    words = [b"w%d" % (i % 1000) for i in range(5000)] + [b"z"] * 300_000 + [b"u%d" % i for i in range(100_000)] + [b"a", b"b", b"c"] * 70_000
    assert periodic_runs._texts_runs([words], 4, 6) == [[(0, 5000, 1000), (5000, 300_000, 1), (405_000, 210_000, 3)]]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "b " * 7, "y"), (None, "b " * 7, "y"), (3, "é é é é é é é\té\v é", "z")], "doc_id long, text string, runs string").repartition(2)
    rows = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(docs).collect())
    assert rows == [(0, 7, [(0, 7, 1)], "b"), (0, 7, [(0, 7, 1)], "b"), (1, 0, [], ""), (3, 8, [(1, 7, 1)], "é é é")]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_query(spark, data):
    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    want = set()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 3000:
            continue  # the scan of all periods is quadratic
        runs = slow_runs(words)
        keep = [True] * n
        for s, length, q in runs:
            keep[s + q : s + length] = [False] * (length - q)
        top = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        milli = 1000 * top[1] // top[2] if runs else None
        want.add((r.doc_id, len(runs), *top, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for w, k in zip(words, keep) if k))))
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, data).collect()]
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert want <= set(got) and sum(w[1] > 0 for w in want) > 10
