"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerscope.llm import hard_negatives as hn

SCHEMA = "id long, label int, vector array<long>"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for a in rows:
        if anchor(a[0]):
            score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))  # noqa: B023, E731
            others = sorted(((-score(r), r[0], r[1]) for r in rows if r[0] != a[0]))
            for p in [o for o in others if o[2] == a[1]][:positives]:
                fit = [o for o in others if o[2] != a[1] and low * -p[0] <= 100 * -o[0] <= high * -p[0]][:negatives]
                out += [(a[0], p[1], k + 1, o[1], -p[0], -o[0]) for k, o in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(tuple(r[n] for n in NAMES) for r in hn.mine(df, F.col("id") % 7 == 0, **how).collect())


def vectors(seed, n, width=8, kinds=4):
    r = np.random.default_rng(seed)
    centres = r.integers(-60, 60, (kinds, width))
    return [(i, int(r.integers(0, kinds)), [int(x) for x in centres[r.integers(0, kinds)] + r.integers(-20, 20, width)]) for i in range(n)]


@pytest.mark.parametrize("block,stride,group,cluster", [(8192, 256, 8192, 64), (7, 2, 5, 2), (50, 3, 1000, 1)])
def test_brute_force(spark, monkeypatch, block, stride, group, cluster):
    for name, value in (("BLOCK", block), ("STRIDE", stride), ("GROUP", group), ("CLUSTER", cluster)):
        monkeypatch.setattr(hn, name, value)
    rows = vectors(block, 160)
    assert mined(spark, rows) == brute(rows, lambda i: i % 7 == 0)


def test_ties_repeats_nulls_and_lengths(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1]), [r.choice([1, 2]), 1]) for i in range(60)] + [(14, 0, [1, 1])] + [(100, 1, [2, 1])] * 3
    rows += [(None, 0, [9, 9]), (200, None, [9, 9]), (201, 0, None), (202, 1, [None, 9]), (203, 1, []), (210, 0, [0, 0]), (211, 1, [3]), (212, 0, [1, 1, 50])]
    want = brute(rows, lambda i: i % 7 == 0)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=3, low=0, high=100) == brute(rows, lambda i: i % 7 == 0, 2, 3, 0, 100)


def test_few_rows_and_none(spark):
    assert mined(spark, [(7, 1, [5])]) == [] and mined(spark, [(1, 1, [5]), (2, 0, [5])]) == []
    assert spark.createDataFrame([], SCHEMA).transform(lambda d: hn.mine(d, F.col("id") % 7 == 0)).count() == 0
    same = [(i, 0, [3, 4]) for i in range(20)]
    assert mined(spark, same) == []


def test_clashing_columns_and_large_scores(spark):
    df = spark.createDataFrame([(7, 1, [5], "a", 1), (8, 1, [4], "b", 2), (9, 0, [2], "c", 3)], SCHEMA + ", rank string, anchor int")
    assert [tuple(r) for r in hn.mine(df, F.col("id") == 7).collect()] == [(7, 8, 1, 9, 20, 10)]
    with pytest.raises(Exception, match="smaller scale"):
        hn.mine(spark.createDataFrame([(7, 1, [2**30, 2**30]), (8, 1, [2**30, 1])], SCHEMA), F.col("id") == 7).collect()


def test_quantise(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([float("inf"), 1.0],), ([None, 1.0],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(hn.quantise(F.col("v"))).collect()] == [[128, -1], None, None, None, None, []]


def test_walks_end_early_and_lose_nothing():
    """Of anchors in one direction, a list of candidates around the sphere is walked in part only."""
    r = np.random.default_rng(5)
    near, all_round = r.normal(size=(20, 16)) + 12, r.normal(size=(20_000, 16))
    group = hn.Group(np.arange(20), np.zeros(20, int), np.floor(near * 10))
    cut = np.full((20, 1), hn.NONE + 1)
    walk = hn.Walk(group.lists(cut, np.full_like(cut, 2**60), 5, True))
    c = np.floor(all_round * 50)
    walk.block(np.arange(100, 20_100), np.zeros(20_000, int), c)
    assert walk.walked < 0.3 * 20 * len(c)
    full = (group.vectors @ c.T).astype(int)
    for a in range(20):
        best = np.lexsort((np.arange(len(c)), -full[a]))[:5]
        assert walk.ids[a, 0].tolist() == (best + 100).tolist() and walk.scores[a, 0].tolist() == full[a, best].tolist()
