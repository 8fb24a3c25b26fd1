"""Choice of releases by role and version, and the warnings about what it lacks."""

import pytest
from pyspark.sql import functions as F

from peerscope.operators import reshape
from peerscope.plans import claims, products
from peerscope.config import ScreenConfig

SCHEMA = "release_id long, data_year int, dataset string, status string, version string, observed_at string, filters map<string,string>"
PRODUCT, BRAND, OWN = {"Brnd_Name": "X", "GNRC_NAME": "y"}, {"brnd_name": "x"}, {"Prscrbr_NPI": "7"}


def chosen(spark, rows, years=(2020, 2021)):
    df = spark.createDataFrame(rows, SCHEMA)
    got = products.select_releases(df, "7", "x", "Y", list(years), "P", "G")
    return got, {(r.data_year, r.role): (r.release_id, r.scope, r.all_drugs) for r in got.collect()}


def test_roles_take_the_latest_compatible_release(spark):
    _, got = chosen(spark, [
        (1, 2020, "P", "loaded", "a", "2021-01", PRODUCT), (2, 2020, "P", "loaded", "b", "2021-02", BRAND), (3, 2020, "P", "loaded", "a", "2021-09", {"state": "FL"}), (4, 2020, "P", "failed", "b", "2022-01", {}),
        (5, 2020, "G", "loaded", "a", "2021-01", {}), (6, 2020, "G", "loaded", "a", "2021-01", BRAND), (7, 2020, "P", "loaded", "a", "2021-08", OWN), (8, 2020, "P", "loaded", "b", "2021-01", OWN), (9, 2021, "P", "loaded", "c", "2021-01", BRAND),
    ])
    # The portfolio is of the cohort's version, though another is later; without one the cohort's release stands in.
    assert got == {(2020, "provider"): (2, "brand", False), (2020, "geography"): (6, "brand", False), (2020, "portfolio"): (8, "npi", True), (2021, "provider"): (9, "brand", False), (2021, "portfolio"): (9, "brand", False)}


def test_without_a_cohort_it_raises(spark):
    with pytest.raises(ValueError, match="no loaded release"):
        chosen(spark, [(1, 2020, "P", "loaded", "a", "2021", OWN), (2, 2019, "P", "loaded", "a", "2021", BRAND)])


def test_all_warnings(spark):
    selection, _ = chosen(spark, [(1, 2020, "P", "loaded", "a", "1", BRAND), (2, 2020, "P", "loaded", "b", "2", OWN), (3, 2022, "P", "loaded", "a", "1", BRAND)], (2020, 2021, 2022))
    spine = reshape.year_spine(selection, 2020, 2022)
    denominators = spine.withColumn("denominator_status", F.when(F.col("data_year") == 2020, "available").otherwise("missing"))
    got = {(r.warning, r.data_year) for r in products.coverage_warnings(selection, spine, spine.filter("data_year = 2020"), denominators).collect()}
    assert got == {
        ("missing-cohort-release", 2021), ("missing-national-denominator", 2021), ("missing-national-denominator", 2022), ("portfolio-limited-to-target-brand", 2022), ("no-visible-candidate-row", 2022), ("no-adjacent-cohort-years", None), ("mixed-versions", 2020),
    }


def test_a_shortlist_rejects_mixed_settings_and_releases(spark):
    df = spark.createDataFrame([(2020, 1, 0.95), (2020, 2, 0.95), (2021, 3, 0.9)], "data_year int, source_release_id long, tail double")
    with pytest.raises(ValueError, match="mix settings: tail=2"):
        claims.anonymous_shortlist(df, ScreenConfig(years=(2020, 2021)), ["tail"])
    with pytest.raises(ValueError, match="mix releases: years=1, first=2020"):
        claims.anonymous_shortlist(df, ScreenConfig(years=(2020, 2021)), (), "source_release_id")
