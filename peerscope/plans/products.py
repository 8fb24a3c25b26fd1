"""Product trajectories, leaders, churn, portfolios and denominators, and the choice of releases behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import censored_change, denominator_status, ratio
from ..operators.peers import attach


def product_rows(drug: DataFrame, brand: str, generic: str) -> DataFrame:
    """Rows of one product by case-insensitive names, with unit costs."""
    rows = drug.filter((F.lower("brand") == brand.lower()) & (F.lower("generic") == generic.lower()))
    return rows.withColumns({"cost_per_claim": ratio("cost", "claims"), "claims_per_beneficiary": ratio("claims", "beneficiaries")})


def trajectory(drug: DataFrame, national: DataFrame, npi: str, brand: str, generic: str) -> DataFrame:
    """One prescriber's product by year: rank, percentile, ratio to the extreme quantile, national shares, change."""
    rows = product_rows(drug, brand, generic)
    year = Window.partitionBy("data_year")
    ranked = rows.withColumns({
        "claims_rank": F.rank().over(year.orderBy(F.col("claims").desc())), "claims_percent_rank": F.percent_rank().over(year.orderBy("claims")),
        "visible_rows": F.count("*").over(year), "visible_claims": F.sum("claims").over(year),
    })
    spread = rows.groupBy("data_year").agg(F.percentile("claims", 0.999).alias("claims_p999"), F.percentile("cost_per_claim", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("q"))
    own = attach(ranked.filter(F.col("npi") == npi), spread.select("data_year", "claims_p999", F.get("q", F.lit(0)).alias("p01_cost"), F.get("q", F.lit(1)).alias("median_cost"), F.get("q", F.lit(2)).alias("p99_cost")), ["data_year"])
    whole = national.filter((F.lower("brand") == brand.lower()) & (F.lower("generic") == generic.lower())).select("data_year", "national_claims", "national_cost")
    own = attach(own, whole, ["data_year"], "left")
    order = Window.partitionBy("npi").orderBy("data_year")
    own = own.withColumns({"previous_year": F.lag("data_year").over(order), "previous_claims": F.lag("claims").over(order)})
    return own.withColumns({
        "ratio_to_p999": ratio("claims", "claims_p999"), "national_claim_share": 100 * ratio("claims", "national_claims"), "national_cost_share": 100 * ratio("cost", "national_cost"),
        "visible_claim_share": 100 * ratio("claims", "visible_claims"), "denominator_status": F.when(F.col("national_claims").isNull(), "missing").otherwise("available"),
        "change_percent": F.when(F.col("previous_year") == F.col("data_year") - 1, 100 * ratio(F.col("claims") - F.col("previous_claims"), F.col("previous_claims"))),
    })


def leaders(drug: DataFrame, national: DataFrame, brand: str, generic: str, k: int) -> DataFrame:
    """The k prescribers with most claims a year, ties by identifier."""
    year = Window.partitionBy("data_year")
    most = year.orderBy(F.col("claims").desc())
    rows = product_rows(drug, brand, generic).withColumns({
        "claims_rank": F.rank().over(most), "place": F.row_number().over(year.orderBy(F.col("claims").desc(), "npi")),
        "claims_percent_rank": F.percent_rank().over(year.orderBy("claims")), "visible_rows": F.count("*").over(year),
    })
    whole = national.filter((F.lower("brand") == brand.lower()) & (F.lower("generic") == generic.lower())).select("data_year", "national_claims")
    return attach(rows.filter(F.col("place") <= k), whole, ["data_year"], "left").withColumn("national_claim_share", 100 * ratio("claims", "national_claims"))


def churn(drug: DataFrame, years: list[int], brand: str, generic: str, k: int, hidden: int = 10) -> DataFrame:
    """Changes between adjacent years of the cohort, with bounds where one side is not visible; the k largest a pair.

    A row takes part in the pair that it starts and in the one it ends; both are known from its year, so the rows are
    doubled once and grouped, not joined to the pairs.
    """
    pairs = [y for y in years if y + 1 in years]
    rows = product_rows(drug, brand, generic).withColumn("from_year", F.explode(F.array("data_year", F.col("data_year") - 1))).filter(F.col("from_year").isin(pairs))
    first, second = F.col("data_year") == F.col("from_year"), F.col("data_year") == F.col("from_year") + 1
    at = lambda c, when: F.max(F.when(when, F.col(c)))
    paired = rows.groupBy("from_year", "npi").agg(at("claims", first).alias("from_claims"), at("claims", second).alias("to_claims"), at("cost", first).alias("from_cost"), at("cost", second).alias("to_cost"))
    changed = paired.withColumns({**censored_change(F.col("from_claims"), F.col("to_claims"), hidden), "cost_change": F.col("to_cost") - F.col("from_cost"), "to_year": F.col("from_year") + 1})
    place = F.row_number().over(Window.partitionBy("from_year").orderBy(F.col("ranking_magnitude").desc(), "npi"))
    return changed.withColumn("change_rank", place).filter(F.col("change_rank") <= k)


def portfolio(drug: DataFrame, npi: str, full_years: list[int]) -> DataFrame:
    """A prescriber's products by year with cost rank, shares of what is visible, and what the year's release covers."""
    year = Window.partitionBy("data_year")
    rows = drug.filter(F.col("npi") == npi).withColumns({
        "cost_rank": F.rank().over(year.orderBy(F.col("cost").desc())), "year_claims": F.sum("claims").over(year), "year_cost": F.sum("exact_cost").over(year).cast("double"),
        "scope": F.when(F.col("data_year").isin(full_years), "all-reported-drugs").otherwise("target-brand-only"),
    })
    return rows.withColumns({"claim_share": 100 * ratio("claims", "year_claims"), "cost_share": 100 * ratio("cost", "year_cost"), "cost_per_claim": ratio("cost", "claims")})


def denominators(spine: DataFrame, national: DataFrame, brand: str, generic: str) -> DataFrame:
    """Every requested year with the product's national totals and whether they can serve as a denominator."""
    whole = national.filter((F.lower("brand") == brand.lower()) & (F.lower("generic") == generic.lower())).select("data_year", "national_prescribers", "national_claims", "national_cost")
    return spine.join(whole, "data_year", "left").withColumn("denominator_status", denominator_status(F.col("national_claims")))


def release_scope(filters: Column, npi: str, brand: str, generic: str) -> Column:
    """What a release was retrieved for, by its filters without regard to case: product, brand, full, npi; null for another selection."""
    pair = lambda k, v: F.struct(F.lower(k).alias("key"), F.lower(v).alias("value"))
    have = F.array_sort(F.transform(F.map_entries(filters), lambda e: pair(e["key"], e["value"])))
    same = lambda **wanted: have == F.array(*[pair(F.lit(k), F.lit(v)) for k, v in sorted(wanted.items())])
    label = F.when(F.size(filters) == 0, "full").when(same(brnd_name=brand, gnrc_name=generic), "product").when(same(brnd_name=brand), "brand")
    return label.when(same(prscrbr_npi=npi), "npi")


def select_releases(register: DataFrame, npi: str, brand: str, generic: str, years: list[int], provider: str, geography: str) -> DataFrame:
    """Per year the releases in the roles of product cohort (provider), denominators (geography) and the prescriber's portfolio.

    The latest observed compatible release is taken, ties by the larger id. A portfolio prefers releases of the cohort's
    version; without one that holds all drugs the cohort's release stands in, and all_drugs is false. Raises without any cohort.
    """
    scoped = register.filter((F.col("status") == "loaded") & F.col("data_year").isin(years)).withColumn("scope", release_scope(F.col("filters"), npi, brand, generic))
    keep = ["data_year", "role", "release_id", "version", "scope", "all_drugs"]
    first = lambda df, *order: df.withColumn("place", F.row_number().over(Window.partitionBy("data_year", "role").orderBy(*order, F.col("observed_at").desc(), F.col("release_id").desc()))).filter("place = 1").select(*keep)
    role = F.when(F.col("dataset") == provider, "provider").when(F.col("dataset") == geography, "geography")
    named = scoped.filter(F.col("scope").isin("product", "brand", "full")).withColumns({"role": role, "all_drugs": F.col("scope") == "full"}).filter("role is not null")
    chosen = first(named)
    cohort = chosen.filter("role = 'provider'")
    if cohort.isEmpty():
        raise ValueError(f"no loaded release holds the cohort of {brand!r}")
    wide = scoped.filter((F.col("dataset") == provider) & F.col("scope").isin("npi", "full")).withColumns({"role": F.lit("portfolio"), "all_drugs": F.lit(True)})
    same = F.coalesce(F.col("version") == F.col("cohort_version"), F.lit(False))
    portfolio = first(wide.join(cohort.select("data_year", F.col("version").alias("cohort_version")), "data_year", "left"), same.desc())
    instead = cohort.join(portfolio, "data_year", "left_anti").withColumns({"role": F.lit("portfolio"), "all_drugs": F.lit(False)}).select(*keep)
    return chosen.unionByName(portfolio).unionByName(instead)


def coverage_warnings(selection: DataFrame, spine: DataFrame, candidate_years: DataFrame, denominators: DataFrame) -> DataFrame:
    """(warning, data_year) rows of what the outputs of a selection lack; the year is null where none is meant."""
    cohort, portfolio = selection.filter("role = 'provider'"), selection.filter("role = 'portfolio'")
    say = lambda df, text: df.select(F.lit(text).alias("warning"), "data_year")
    without = lambda df, other: df.select("data_year").join(other.select("data_year").distinct(), "data_year", "left_anti")
    pairs = cohort.select("data_year").join(cohort.select((F.col("data_year") - 1).alias("data_year")), "data_year", "left_semi")
    lonely = pairs.agg(F.count("*").alias("n"), F.lit(None).cast("int").alias("data_year")).filter("n = 0")
    versions = portfolio.filter("all_drugs").select("data_year", F.col("version").alias("other"))
    found = {
        "missing-cohort-release": without(spine, cohort), "missing-national-denominator": without(spine, denominators.filter("denominator_status = 'available'")), "portfolio-limited-to-target-brand": portfolio.filter("not all_drugs"),
        "no-visible-candidate-row": without(cohort, candidate_years), "no-adjacent-cohort-years": lonely, "mixed-versions": cohort.join(versions, "data_year").filter("version != other"),
    }
    return reduce(DataFrame.unionByName, [say(df, text) for text, df in found.items()])
