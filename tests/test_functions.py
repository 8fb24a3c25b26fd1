"""Measures and labels."""

from decimal import Decimal

from pyspark.sql import functions as F

from peerscope.functions import measures as m


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (5, 100, 199, 200, 499, 500, 10_000)], "v int")
    assert [r.b for r in df.select(m.band("v", (100, 200, 500)).alias("b")).collect()] == ["500+", "100-199", "100-199", "200-499", "200-499", "500+", "500+"]


def test_dominant_component(spark):
    cases = [(80.0, 10.0, 10.0, 100.0, "a"), (50.0, 40.0, 10.0, 100.0, "mixed"), (50.0, None, None, 100.0, "unclassified"), (None, None, None, 100.0, "none"), (5.0, 5.0, 5.0, 0.0, "none"), (0.0, 0.0, 95.0, 100.0, "c")]
    df = spark.createDataFrame(cases, "a double, b double, c double, t double, want string")
    rows = df.select(m.dominant_component({k: F.col(k) for k in "abc"}, F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)
    visible = df.select(m.visible_dominance({k: F.col(k) for k in "abc"}, F.col("t")).alias("v")).collect()
    assert [r.v.split("-")[0] for r in visible] == ["dominant", "mixed", "unclassified", "unclassified", "unclassified", "dominant"]


def test_censored_change(spark):
    df = spark.createDataFrame([(18, 24), (None, 15), (30, None)], "a long, b long")
    rows = df.select(*[c.alias(n) for n, c in m.censored_change(F.col("a"), F.col("b")).items()]).collect()
    assert [tuple(r)[:4] for r in rows] == [(6, 6, 6, 6), (None, 5, 15, 15), (None, -30, -20, 30)]
    assert [r.visibility_status for r in rows] == ["both-visible-exact", "became-visible-prior-0-to-10-or-absent", "became-nonvisible-current-0-to-10-or-absent"]


def test_identity_name_and_reasons(spark):
    key, quality = m.identity_key(npi=F.lit(None).cast("string"), profile=F.lit("7"), record=F.lit("r"))
    r = one(spark, k=key, q=quality, n=m.display_name(F.lit("  "), F.lit(" Roe ")), s=m.reasons(";", a=F.lit(True), b=F.lit(None).cast("boolean"), c=F.lit(True)))
    assert tuple(r) == ("profile:7", "profile", "Roe", "a;c")


def test_marked_and_canonical_numbers(spark):
    df = spark.createDataFrame([(v,) for v in ("12.50", " 7 ", "*", "#", "", None, "-1", "NaN", "1e5", "x")], "v string")
    value, bad = m.marked_number(F.col("v"))
    rows = df.select(value.alias("n"), bad.alias("bad")).collect()
    assert [r.n for r in rows[:2]] == [Decimal("12.5"), Decimal("7")] and all(r.n is None for r in rows[2:])
    assert [r.bad for r in rows] == [False] * 6 + [True] * 4
    df = spark.createDataFrame([(Decimal(v),) for v in ("10.00", "10.50", "0.05", "100")], "d decimal(18,2)")
    assert [r.t for r in df.select(m.canonical_decimal(F.col("d")).alias("t")).collect()] == ["10", "10.5", "0.05", "100"]


def test_exposure_and_ratio_are_null_where_unknown(spark):
    r = one(spark, a=m.exposure(F.lit(100.0), F.lit(2), F.lit(None).cast("double")), b=m.exposure(F.lit(100.0), F.lit(2), F.lit(60.0)), c=m.ratio(F.lit(1), F.lit(0)), d=m.denominator_status(F.lit(0)))
    assert tuple(r) == (None, 0.0, None, "missing")
