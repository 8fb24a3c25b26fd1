"""Peer statistics: golden values, nulls, ties and the cohort-excluded forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerscope.functions.robust import all_gates, robust_z, scale_source
from peerscope.operators import peers, strata

KEYS = ["y", "code"]


def cells(spark):
    rows = [("c1", "FL", 10_000.0, 100), ("c2", "FL", 200_000.0, 100), ("c3", None, 5_000.0, 100), ("c4", "FL", 5_000.0, None), ("p1", "FL", 1_000.0, 100), ("p2", "FL", 2_000.0, 100), ("p3", "TX", 100_000.0, 100)]
    df = spark.createDataFrame([(2024, "A6010", n, s, v, b) for n, s, v, b in rows], "y int, code string, npi string, state string, services double, b long")
    return df.withColumns({"per": F.col("services") / F.col("b"), "known": F.col("b").isNotNull(), "cand": F.col("npi").startswith("c")})


def test_excluded_statistics_and_rank(spark):
    peer = F.col("known") & ~F.col("cand")
    s = peers.excluded_stats(cells(spark), KEYS, {"per": "per"}, peer).first()
    assert (s.peer_count, s.per_median, s.per_q3) == (3, 20.0, 510.0)
    ranked = {r.npi: r for r in peers.excluded_rank(cells(spark), KEYS, {"per": "per"}, peer, F.col("cand")).collect()}
    assert ranked["c1"].per_high_rank == 2 and ranked["c1"].per_peer_share == pytest.approx(2 / 3)
    assert ranked["c2"].per_high_rank == 1 and ranked["c4"].per_high_rank is None
    state = peers.excluded_stats(cells(spark).filter("state = 'FL'"), KEYS, {"per": "per"}, peer).first()
    assert (state.peer_count, state.per_q3) == (2, 17.5)


def test_ties_count_as_at_or_below(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("p", 2.0), ("c", 2.0), ("c", 0.5), ("c", None)], "kind string, v double").withColumn("g", F.lit(1))
    out = {r.v: (r.v_high_rank, r.v_peer_share) for r in peers.excluded_rank(df, ["g"], {"v": "v"}, F.col("kind") == "p", F.col("kind") == "c").collect()}
    assert out == {2.0: (1, 1.0), 0.5: (4, 0.0), None: (None, None)}


@pytest.mark.parametrize("most", [0, 50, 10**9])
def test_quartiles_match_numpy_in_both_forms(spark, most):
    rnd = np.random.default_rng(3)
    values = [(int(g), float(v)) for g, v in zip(rnd.integers(0, 4, 400), rnd.normal(size=400) * 10.0 ** rnd.integers(-300, 300, 400), strict=True)] + [(9, 5.0), (0, None), (1, 0.0), (1, -0.0)]
    df = spark.createDataFrame(values, "g int, v double")
    got = {r.g: r for r in peers.with_peer_stats(df, ["g"], {"v": "v"}, most).collect()}
    grouped = {r.g: r for r in peers.quartiles(df, ["g"], {"v": "v"}).collect()}
    for g in (0, 1, 2, 3, 9):
        x = np.array([v for k, v in values if k == g and v is not None])
        for r in (got[g], grouped[g]):
            assert r.v_q1 == pytest.approx(np.quantile(x, 0.25)) and r.v_median == pytest.approx(np.median(x))
            assert r.v_mad == pytest.approx(np.median(np.abs(x - np.median(x)))) and r.v_iqr == r.v_q3 - r.v_q1
    assert got[0].peer_count == grouped[0].peer_count == sum(k == 0 for k, _ in values)


def awkward(spark):
    """Ties, zeros, signs, extremes, nulls and a candidate cohort, in a large and some small strata, one of them null."""
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(600):
        a = [None, 0.0, -0.0, 1.0, -1.0, float(rnd.integers(-4, 4)), float(rnd.normal()), 1e308, -1e-308, float("inf")][int(rnd.integers(0, 10))]
        rows.append((i, [1, 1, 1, 2, 3, None][int(rnd.integers(0, 6))], "x" if i % 3 else None, a, float(rnd.integers(0, 5)), bool(i % 4 == 0)))
    return spark.createDataFrame(rows, "id int, g int, s string, a double, b double, cand boolean")


def same(x, y):
    assert set(x.columns) == set(y.columns)
    plain = lambda v: repr(v + 0.0 if isinstance(v, float) else v)
    rows = lambda df: sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()))
    assert rows(x) == rows(y)


def test_split_strata_give_the_results_of_windows(spark):
    df, m, peer = awkward(spark), {"a": "a", "b": "b"}, ~F.col("cand") & (F.col("id") % 7 > 0)
    finite = df.filter("a is null or abs(a) < 1e307")
    for most in (150,):
        same(peers.with_peer_stats(finite, ["g"], m, 10**9), peers.with_peer_stats(finite, ["g"], m, most))
        same(peers.percentiles(df, ["g"], m, most=10**9), peers.percentiles(df, ["g"], m, most=most))
        same(peers.with_excluded_stats(finite, ["g"], m, peer, most=10**9), peers.with_excluded_stats(finite, ["g"], m, peer, most=most))
        same(peers.excluded_rank(df, ["g"], m, peer, F.col("cand"), 10**9), peers.excluded_rank(df, ["g"], m, peer, F.col("cand"), most))


def test_buckets_keep_order(spark):
    values = sorted([0.0, -1.0, 1.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), *[2.0**k * s * f for k in range(-1000, 1000, 77) for s in (1, -1) for f in (1, 1 + 1e-15, 1.5)]])
    df = spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "v double")
    got = {repr(r.v): r.b for r in df.select("v", strata.bucket(F.col("v")).alias("b")).collect()}
    order = [got[repr(v)] for v in [*values, float("nan"), None]]
    assert order == sorted(order) and len(set(order)) > 90


def test_running_sums_of_one_key_in_many_tasks(spark):
    """One stratum with all rows: the sums are right, and no task of the ordered step has more than a small share of it."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"), F.lit(1).cast("long").alias("w"))
    out = strata.running(df, ["g"], ["v"], ["w"])
    assert out.filter((F.col("w_upto") != F.col("v") + 1) | (F.col("w_total") != n)).count() == 0
    buckets = df.groupBy(strata.bucket(F.col("v"))).count()
    assert buckets.agg(F.max("count")).first()[0] < n / 200


def test_one_stratum_of_all_rows(spark):
    df = spark.range(100_000).select(F.lit(1).alias("g"), (F.pow((F.col("id") * 7919) % 100_003, F.lit(2)) / 7).alias("v"))
    r = peers.quartiles(df, ["g"], {"v": "v"}).first()
    x = np.array([q.v for q in df.collect()])
    assert (r.v_q1, r.v_median, r.v_q3) == pytest.approx(tuple(np.quantile(x, [0.25, 0.5, 0.75]))) and r.v_mad == pytest.approx(np.median(np.abs(x - np.median(x))))


def test_robust_score_falls_back_and_degenerates(spark):
    df = spark.createDataFrame([(10.0, 1.0, 0.0, 2.0), (10.0, 1.0, 3.0, 2.0), (10.0, 1.0, 0.0, 0.0), (None, 1.0, 1.0, 1.0), (1e9 + 1, 1e9, 1e-4, 0.0)], "x double, m double, mad double, iqr double")
    c = [F.col(n) for n in ("x", "m", "mad", "iqr")]
    rows = df.select(robust_z(*c).alias("z"), scale_source(*c).alias("s")).collect()
    assert [r.s for r in rows] == ["iqr-fallback", "mad", "degenerate", None, "degenerate"]
    assert rows[0].z == pytest.approx(1.3489795 * 9 / 2) and rows[1].z == pytest.approx(0.67448975 * 3) and rows[2].z is None and rows[4].z is None


def test_percentiles_rank_nulls_last_and_count_them(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (1, 1.0)], "g int, v double")
    assert {r.v: round(r.v_percentile, 2) for r in peers.percentiles(df, ["g"], {"v": "v"}).collect()} == {1.0: 0.33, 5.0: 0.67, None: 1.0}


def test_unknown_gates_fail(spark):
    df = spark.createDataFrame([(None,), (2,)], "v int")
    assert [r.f for r in df.select(all_gates(F.col("v") > 1, F.lit(True)).alias("f")).collect()] == [False, True]


def test_null_strata_have_no_peers(spark):
    df = spark.createDataFrame([(None, 1.0), (1, 2.0)], "g int, v double")
    assert [r.g for r in peers.with_peer_stats(df, ["g"], {"v": "v"}).collect()] == [1]


def test_windowed_excluded_statistics_match_the_grouped_form(spark):
    peer, keys = F.col("known") & ~F.col("cand"), [*KEYS, "peer_scope", "geography"]
    rows = peers.scopes(cells(spark), "state")
    assert rows.filter("npi = 'c3'").count() == 1 and rows.filter("npi = 'p3'").select("geography").distinct().count() == 2
    grouped = {(r.peer_scope, r.geography): r for r in peers.excluded_stats(rows, keys, {"per": "per"}, peer).collect()}
    for r in peers.with_excluded_stats(rows, keys, {"per": "per"}, peer).collect():
        want = grouped[(r.peer_scope, r.geography)]
        assert (r.peer_count, r.per_q1, r.per_median, r.per_q3, r.per_iqr, r.per_mad) == (want.peer_count, want.per_q1, want.per_median, want.per_q3, want.per_iqr, want.per_mad)
    alone = peers.with_excluded_stats(cells(spark).filter("cand"), KEYS, {"per": "per"}, peer).first()
    assert alone.peer_count == 0 and alone.per_median is None and alone.per_mad is None
