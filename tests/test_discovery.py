"""Code discovery and its freezes on a hand-made cohort."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from peerscope.config import DiscoveryConfig
from peerscope.plans import claims, context

CFG = DiscoveryConfig(coverage_floor=Decimal("0.5"), cumulative_share=Decimal("0.5"), top_codes=1, cohort_payment=Decimal(900), selected_cap=5)
MONEY = "submitted decimal(18,4), allowed decimal(18,4), payment decimal(18,4), standardized decimal(18,4)"


def cohort(spark, cells, summary):
    money = lambda x: [Decimal(x)] * 4
    c = spark.createDataFrame([(n, e, code, pos, 1, Decimal(1), *money(p)) for n, e, code, pos, p in cells], f"npi string, entity string, code string, pos string, claims long, services decimal(18,4), {MONEY}")
    s = spark.createDataFrame([(n, e, *money(p)) for n, e, p in summary], f"npi string, entity string, {MONEY}")
    return s, c, s.select("npi").distinct()


CELLS = [("1", "I", "A", "x", 600), ("1", "I", "B", "x", 300), ("1", "I", "B", "y", 50), ("1", "I", "C", "x", 50), ("2", "O", "A", "x", 400), ("2", "O", "D", "x", 399)]
SUMMARY = [("1", "I", 1500), ("2", "O", 800)]


def test_discovery_returns_every_code_with_its_rules(spark):
    found = claims.discovery(*cohort(spark, CELLS, SUMMARY), CFG)
    rows = {(r.npi, r.code): (r.payment_rank, r.selected, r.selection_reasons) for r in found.collect()}
    assert rows == {
        ("1", "A"): (1, True, "candidate-top-n|cohort-payment-floor|candidate-coverage-target"), ("1", "B"): (2, False, ""), ("1", "C"): (3, False, ""),
        ("2", "A"): (1, True, "candidate-top-n|cohort-payment-floor|candidate-coverage-target"), ("2", "D"): (2, False, ""),
    }
    assert [(r.code, r.top_n_npis, r.coverage_npis, r.candidate_rows) for r in claims.code_freeze(found, CFG).collect()] == [("A", "1|2", "1|2", 2)]
    # D and B are material though no rule selects them.
    assert sorted((r.code, r.npis, r.selected) for r in claims.materiality_freeze(found, 350, CFG).collect()) == [("A", "1|2", True), ("B", "1", False), ("D", "2", False)]


def test_discovery_gates(spark):
    for cells, summary in (
        (CELLS, [("1", "I", 5000), ("2", "O", 800)]), (CELLS, [*SUMMARY, ("2", "O", 800)]), ([*CELLS, CELLS[0]], SUMMARY), (CELLS, [("1", "O", 1500), ("2", "O", 800)]), (CELLS, [*SUMMARY, ("3", "I", 5)]),
    ):
        with pytest.raises(ValueError, match="gates of discovery"):
            claims.discovery(*cohort(spark, cells, summary), CFG)


def test_freeze_rejects_what_does_not_replay(spark):
    found = claims.discovery(*cohort(spark, CELLS, SUMMARY), CFG).cache()
    one = (F.col("npi") == "1") & (F.col("code") == "B")
    changes = {
        "ranks": found.filter(~one), "cumulative": found.withColumn("after", F.when(one, F.col("after") + Decimal("0.0001")).otherwise(F.col("after"))), "rules": found.withColumn("selected_by_top_n", F.col("selected_by_top_n") | one),
        "cohort": found.withColumn("cohort_payment", F.when(one, F.col("cohort_payment") - 1).otherwise(F.col("cohort_payment"))), "reasons": found.withColumn("selection_reasons", F.lit("candidate-top-n")), "shares": found.withColumn("before_share", F.col("before_share") + 1e-9),
    }
    for what, changed in changes.items():
        with pytest.raises(ValueError, match=what):
            claims.code_freeze(changed, CFG)


def test_reassignment_counts_are_those_of_all_pairs(spark):
    rows = [("B", "g", f"{i}", y, (i * 37 % 50 + 5) + (y == 2) * ((i * 53) % 41 - 20)) for i in range(60) for y in (1, 2)] + [("B", "g", "gone", 1, 9), ("E", "g", "only", 2, 5), ("E", "g", "only", 1, 4)]
    series = spark.createDataFrame(rows, "brand string, generic string, npi string, data_year int, claims long")
    at = {(b, n, y): c for b, _, n, y, c in rows}
    change = {(b, n): at[b, n, 2] - at[b, n, 1] for b, n, y in at if y == 2 and (b, n, 1) in at}
    want = {}
    for (b, n), x in change.items():
        if x:
            others = [m for (d, m), z in change.items() if d == b and z * x < 0]
            want[b, n] = (x, len(others), sum(10 * abs(x + change[b, m]) <= at[b, n, 1] + at[b, m, 1] for m in others))
    assert {(r.brand, r.npi): (r.change, r.opposite, r.offsetting) for r in context.reassignment(series).collect()} == want
