"""Provider-service scan, supplier screen, code discovery and peer review, as functions from cells to result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import cut
from ..config import DiscoveryConfig, ReviewConfig, ScanConfig, ScreenConfig
from ..functions.measures import band, dominant_component, exposure, ratio, reasons
from ..functions.robust import all_gates
from ..operators.peers import attach, percentiles, score, scored

SCAN_METRICS = {"reach": "panel_penetration", "days": "days_per_tested", "units": "units_per_day"}
SCREEN_METRICS = {"std": "std_per_beneficiary", "raw": "raw_per_beneficiary", "claims": "claims_per_beneficiary", "services": "services_per_beneficiary"}


def count_where(condition: Column) -> Column:
    """A filtered count that can be used over a window."""
    return F.sum(F.when(condition, 1).otherwise(0))


def scan_rows(cells: DataFrame, panel: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Visible cells of providers with a large enough panel, with their measures."""
    panel = panel.filter(F.col("beneficiaries") >= cfg.minimum_panel).select(
        "data_year", "npi", F.col("beneficiaries").alias("panel"), F.col("standardized").alias("provider_standardized"), band("beneficiaries", cfg.panel_edges).alias("panel_band")
    )
    tested, services, days = F.col("tested"), F.col("services"), F.col("bene_days")
    rows = cells.withColumnRenamed("beneficiaries", "tested").join(panel, ["data_year", "npi"])
    rows = rows.filter((tested >= cfg.minimum_descriptive) & (services > 0) & (days > 0))
    return rows.withColumns({
        "panel_penetration": ratio(tested, F.col("panel")),
        "days_per_tested": ratio(days, tested),
        "units_per_day": ratio(services, days),
        "std_per_panel": ratio(F.col("standardized"), F.col("panel")),
        "std_share": ratio(F.col("standardized"), F.col("provider_standardized")),
    })


def provider_service_scan(cells: DataFrame, panel: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Cells scored within year, entity, specialty, code, place and panel band; flags, persistence over years, routes.

    The broader percentiles drop the band. Cells below the tested minimum stay as unscored descriptive rows.
    """
    # Cells below the minimum form strata of their own, whose statistics are then blanked: one pass, no union.
    broad = ["data_year", "specialty", "entity", "code", "pos", "__tested"]
    keys = [*broad, "panel_band"]
    rows = scan_rows(cells, panel, cfg).withColumn("__tested", F.col("tested") >= cfg.minimum_tested)
    # Strata lie within the broad ones, so both are split where the broad one is large.
    use = lambda form, part: form.percentiles(form.percentiles(form.with_peer_stats(part, keys, SCAN_METRICS), keys, SCAN_METRICS), broad, SCAN_METRICS, "broad_percentile")
    made = score(scored(rows, broad, use), SCAN_METRICS).withColumn("broad_peer_count", F.count("*").over(Window.partitionBy(*broad)))
    added = [c for c in made.columns if c not in rows.columns]
    return _scan_routes(made.select(*[c for c in rows.columns if c != "__tested"], *[F.when(F.col("__tested"), F.col(c)).alias(c) for c in added]), cfg)


def _scan_routes(rows: DataFrame, cfg: ScanConfig) -> DataFrame:
    peers = F.col("peer_count") >= cfg.minimum_peers
    gates = lambda n, *more: all_gates(F.col("tested") >= cfg.minimum_tested, peers, F.col(f"{n}_percentile") >= cfg.full, F.col(f"{n}_z") >= cfg.z, F.col(f"{n}_ratio") >= cfg.ratio, *more)
    flagged = rows.withColumns({
        "status": F.when(F.col("tested") < cfg.minimum_tested, "insufficient-volume-descriptive").when(peers, "scoreable").otherwise("insufficient-peer-descriptive"),
        "reach_flag": gates("reach", F.col("panel_penetration") - F.col("reach_median") >= cfg.difference),
        "days_flag": gates("days"),
        "units_flag": gates("units"),
    })
    identity = Window.partitionBy("npi", "specialty", "entity", "code", "pos")
    scoreable = F.col("status") == "scoreable"
    years = {"comparable_years": count_where(scoreable).over(identity), "latest_present": F.max("data_year").over(identity) == cfg.to_year}
    for n in SCAN_METRICS:
        years[f"{n}_tail_years"] = count_where(scoreable & (F.col(f"{n}_percentile") >= cfg.tail)).over(identity)
        years[f"{n}_full_years"] = count_where(F.col(f"{n}_flag")).over(identity)
    timed = flagged.withColumns(years)
    enough = F.col("latest_present") & (F.col("comparable_years") >= cfg.comparable_years)
    timed = timed.withColumns({f"{n}_confirmed": enough & (F.col(f"{n}_tail_years") >= cfg.tail_years) & (F.col(f"{n}_full_years") >= cfg.full_years) for n in SCAN_METRICS})

    def route(kind: str, none: str) -> Column:
        reach, strong = F.col(f"reach_{kind}"), F.col(f"days_{kind}") | F.col(f"units_{kind}")
        return F.when(reach & strong, "reach-and-intensity").when(reach, "reach").when(strong, "intensity").otherwise(none)

    few = F.col("status") == "insufficient-peer-descriptive"
    broad_tail = F.coalesce((F.col("broad_peer_count") >= cfg.minimum_peers) & ((F.col("reach_broad_percentile") >= cfg.full) | (F.col("days_broad_percentile") >= cfg.full)), F.lit(False))
    low = F.col("status") == "insufficient-volume-descriptive"
    return timed.withColumns({
        "route": F.when(low, "insufficient-volume").when(~scoreable, "insufficient-peer").otherwise(route("flag", "none")),
        "temporal_route": route("confirmed", "not-confirmed"),
        "broad_status": F.when(low, "insufficient-volume").when(few & broad_tail, "broader-peer-tail-descriptive").when(few, "insufficient-peer").otherwise("not-applicable"),
    })


def shortlist(scan: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Latest-year rows with at least one reason, their reasons and a priority from 1 to 7."""
    provisional = F.col("broad_status") == "broader-peer-tail-descriptive"
    rules = {
        "temporal-reach": F.col("reach_confirmed"), "temporal-repeat": F.col("days_confirmed"), "temporal-unit": F.col("units_confirmed"),
        "latest-full-reach": F.col("reach_flag"), "latest-full-repeat": F.col("days_flag"), "latest-full-unit": F.col("units_flag"),
        "broader-peer-reach-provisional": provisional & (F.col("reach_broad_percentile") >= cfg.full),
        "broader-peer-repeat-provisional": provisional & (F.col("days_broad_percentile") >= cfg.full),
    }
    temporal_reach, temporal_strong = F.col("reach_confirmed"), F.col("days_confirmed") | F.col("units_confirmed")
    full_strong = F.col("days_flag") | F.col("units_flag")
    priority = (
        F.when(temporal_reach & temporal_strong, 1).when(temporal_reach, 2).when(temporal_strong, 3)
        .when(F.col("reach_flag") & full_strong, 4).when(F.col("reach_flag"), 5).when(full_strong, 6).otherwise(7)
    )
    return scan.filter(F.col("data_year") == cfg.to_year).withColumns({"reasons": reasons(";", **rules), "priority": priority}).filter("reasons <> ''")


def multicode_reach(scan: DataFrame, percentile: float, minimum_years: int, minimum_codes: int, latest: int) -> DataFrame:
    """Providers whose reach is in the tail for several codes, each in several scoreable years including the latest.

    Tail years, their list and the payment over all years come from one grouping of the scan.
    """
    group = ["npi", "specialty", "entity", "pos"]
    tail = (F.col("status") == "scoreable") & (F.col("reach_percentile") >= percentile)
    in_tail = lambda c: F.when(tail, F.col(c))
    codes = scan.groupBy(*group, "code").agg(
        F.count_if(tail).alias("years"), F.max(in_tail("data_year")).alias("last"), F.min(in_tail("reach_percentile")).alias("low"),
        F.array_join(F.array_sort(F.collect_list(in_tail("data_year"))), ",").alias("year_list"), F.sum("payment").alias("payment"),
    )
    stable = codes.filter((F.col("years") >= minimum_years) & (F.col("last") == latest))
    return stable.withColumn("codes_in_group", F.count("*").over(Window.partitionBy(*group))).filter(F.col("codes_in_group") >= minimum_codes)


def screen_rows(summary: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Suppliers with a large enough panel and complete stratum labels, their category, band and measures."""
    total, b = F.col("payment"), F.col("beneficiaries")
    parts = {"DME": F.col("dme"), "POS": F.col("pos_paid"), "Drug": F.col("drug")}
    named = F.coalesce(F.trim("entity"), F.lit("")) != ""
    named = named & (F.coalesce(F.trim("specialty"), F.lit("")) != "")
    return summary.filter(F.col("data_year").isin(*cfg.years) & (b >= cfg.minimum_panel) & named).withColumns({
        "band": band("beneficiaries", cfg.band_edges),
        "category": dominant_component(parts, total, cfg.dominance),
        "std_per_beneficiary": ratio(F.col("standardized"), b),
        "raw_per_beneficiary": ratio(total, b),
        "claims_per_beneficiary": ratio(F.col("claims"), b),
        "services_per_beneficiary": ratio(F.col("services"), b),
    })


def supplier_screen(summary: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Suppliers scored within year, entity, specialty, category and band; magnitude gates, persistence and routes."""
    keys = ["data_year", "entity", "specialty", "category", "band"]
    rows = screen_rows(summary, cfg)
    rows = score(scored(rows, keys, lambda form, part: form.percentiles(form.with_peer_stats(part, keys, SCREEN_METRICS), keys, SCREEN_METRICS)), SCREEN_METRICS)
    rows = rows.withColumns({
        "raw_exposure": exposure(F.col("payment"), F.col("beneficiaries"), F.col("raw_q3")),
        "std_exposure": exposure(F.col("standardized"), F.col("beneficiaries"), F.col("std_q3")),
    })
    return screen_routes(rows, cfg)


def screen_routes(rows: DataFrame, cfg: ScreenConfig) -> DataFrame:
    peers = F.col("peer_count") >= cfg.minimum_peers
    pct = lambda n: F.col(f"{n}_percentile")
    full = {f"{n}_full": all_gates(peers, pct(n) >= cfg.full, F.col(f"{n}_z") >= cfg.z, F.col(f"{n}_ratio") >= cfg.ratio) for n in SCREEN_METRICS}
    rows = rows.withColumns({
        "scoreable": peers, **full,
        "std_tail": all_gates(peers, pct("std") >= cfg.tail),
        "use_tail": all_gates(peers, (pct("claims") >= cfg.tail) | (pct("services") >= cfg.tail)),
        "magnitude": (F.col("payment") >= cfg.minimum_payment) & (F.col("raw_exposure") >= cfg.minimum_exposure) & (F.col("std_exposure") >= cfg.minimum_exposure),
    })
    rows = rows.withColumns({
        "tail_year": F.col("magnitude") & F.col("std_tail") & F.col("use_tail"),
        "full_year": F.col("magnitude") & F.col("std_full") & (F.col("claims_full") | F.col("services_full")),
    })
    path = Window.partitionBy("npi", "entity", "specialty", "category")
    rows = rows.withColumns({
        "comparable_years": count_where(F.col("scoreable")).over(path), "tail_years": count_where(F.col("tail_year")).over(path),
        "full_years": count_where(F.col("full_year")).over(path), "latest_present": F.max("data_year").over(path) == cfg.latest_year,
    })
    persistent = (F.col("comparable_years") == len(cfg.years)) & (F.col("tail_years") >= 2) & (F.col("full_years") >= 1) & F.col("latest_present")
    emerging = (F.col("data_year") == cfg.latest_year) & F.col("full_year")
    route = F.when(persistent, "high-dollar-persistent").when(emerging, "high-dollar-emerging").when(F.col("payment") >= cfg.minimum_payment, "high-spend-context").otherwise("not-qualified")
    return rows.withColumns({"persistent": persistent, "route": route})


#: What the screen derives from measures alone; a frozen shortlist is checked against them.
DERIVED = ("scoreable", "std_full", "raw_full", "claims_full", "services_full", "std_tail", "use_tail", "magnitude", "tail_year", "full_year", "comparable_years", "tail_years", "full_years", "latest_present", "persistent", "route")


def anonymous_shortlist(screen: DataFrame, cfg: ScreenConfig, settings: Sequence[str] = (), release: str | None = None) -> DataFrame:
    """Latest-year persistent or emerging suppliers, once every derived column has been derived again and agrees.

    A mismatch, a supplier twice in a year, more than one value of a column of `settings`, or of `release` in a year,
    raises: a shortlist isn't made from rows that contradict themselves.
    """
    screen = cut(screen)  # its gates and the shortlist read it several times
    if settings:
        mixed = screen.agg(*[F.count_distinct(F.struct(c)).alias(c) for c in settings]).first().asDict()
        if any(n > 1 for n in mixed.values()):
            raise ValueError(f"screen rows mix settings: {', '.join(f'{c}={n}' for c, n in mixed.items() if n > 1)}")
    if release:
        several = screen.groupBy("data_year").agg(F.count_distinct(F.struct(release)).alias("n")).filter("n > 1").agg(F.count("*").alias("n"), F.min("data_year").alias("y")).first()
        if several["n"]:
            raise ValueError(f"screen rows mix releases: years={several['n']}, first={several['y']}")
    again = screen_routes(screen.drop(*DERIVED), cfg).select("data_year", "npi", *[F.col(c).alias(f"__{c}") for c in DERIVED])
    differs = F.lit(False)
    for c in DERIVED:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = screen.join(again, ["data_year", "npi"])
    found = both.agg(F.count_if(differs).alias("wrong"), F.count("*").alias("n"), F.count_distinct("data_year", "npi").alias("d")).first()
    if found["wrong"] or found["n"] != found["d"]:
        raise ValueError(f"screen rows do not replay: mismatches={found['wrong']}, duplicates={found['n'] - found['d']}")
    return screen.filter((F.col("data_year") == cfg.latest_year) & F.col("route").isin("high-dollar-persistent", "high-dollar-emerging"))


def frozen_identities(candidates: DataFrame, suppliers: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Attributes of exactly the candidate keys; a key that is missing or not unique raises."""
    found = candidates.select(*keys).join(suppliers.select(*keys, *attributes), list(keys), "left")
    n = found.groupBy(*keys).agg(F.count("*").alias("copies"), F.count(attributes[0]).alias("known")).agg(F.count_if(F.col("copies") != 1), F.count_if(F.col("known") == 0)).first()
    if n[0] or n[1]:
        raise ValueError(f"identities are not exact: repeated={n[0]}, missing={n[1]}")
    return found


#: Why a code is selected.
SELECTED_BY = {"candidate-top-n": "selected_by_top_n", "cohort-payment-floor": "selected_by_cohort", "candidate-coverage-target": "selected_by_coverage"}
MONEY = ("submitted", "allowed", "payment", "standardized")


def selection(ranked: DataFrame, cfg: DiscoveryConfig) -> dict[str, Column]:
    """The three rules over a ranked code; shares are compared by products of decimals, so nothing is rounded."""
    target = F.lit(cfg.cumulative_share).cast("decimal(10,6)")
    return {
        "selected_by_top_n": F.col("payment_rank") <= cfg.top_codes,
        "selected_by_cohort": F.col("cohort_payment") >= F.lit(cfg.cohort_payment),
        "selected_by_coverage": F.col("before") < F.col("visible_payment") * target,
    }


def discovery(summary: DataFrame, cells: DataFrame, candidates: DataFrame, cfg: DiscoveryConfig) -> DataFrame:
    """Every code of every candidate by visible payment, with cumulative payments and shares, and which rules select it.

    Money must be decimal, so that cumulative payments replay exactly. Raises unless each candidate has one summary row,
    cells without repeats that agree with it on the entity, positive payments and a visible share of the summary's payment
    of at least the floor, and the selected codes are between one and the cap.
    """
    wanted = candidates.select("npi").distinct()
    own, rows = cells.join(wanted, "npi", "left_semi"), summary.join(wanted, "npi", "left_semi")
    codes = own.groupBy("npi", "code").agg(
        F.count("*").alias("cells"), F.count_distinct("pos").alias("places"), F.min("entity").alias("entity"), F.max("entity").alias("__entity"), F.array_join(F.array_sort(F.collect_set("pos")), ",").alias("indicators"),
        F.sum("claims").alias("cell_claims"), F.sum("services").alias("services"), *[F.sum(c).alias(f"code_{c}") for c in MONEY],
    )
    portfolio = codes.groupBy("npi").agg(
        *[F.sum(f"code_{c}").alias(f"visible_{c}") for c in MONEY],
        F.min("entity").alias("detail_entity"), F.bool_or((F.col("cells") != F.col("places")) | (F.col("entity") != F.col("__entity")) | F.col("entity").isNull()).alias("broken"), F.count_distinct("entity").alias("entities"),
    )
    whole = rows.groupBy("npi").agg(F.count("*").alias("n"), F.min("entity").alias("summary_entity"), *[F.max(c).alias(f"summary_{c}") for c in MONEY])
    both = wanted.join(whole, "npi", "left").join(portfolio, "npi", "left")
    floor = F.lit(cfg.coverage_floor).cast("decimal(10,6)")
    exact = (F.col("n") == 1) & ~F.col("broken") & (F.col("entities") == 1) & (F.col("summary_entity") == F.col("detail_entity"))
    covered = (F.col("summary_payment") > 0) & (F.col("visible_payment") > 0) & (F.col("visible_payment") >= F.col("summary_payment") * floor)
    bad = both.agg(F.count_if(~F.coalesce(exact, F.lit(False))).alias("integrity"), F.count_if(~F.coalesce(covered, F.lit(False))).alias("coverage"), F.count("*").alias("n")).first()
    if bad["integrity"] or bad["coverage"] or not bad["n"]:
        raise ValueError(f"candidates fail the gates of discovery: source integrity={bad['integrity']}, visible coverage={bad['coverage']} of {bad['n']}")
    order = Window.partitionBy("npi").orderBy(F.col("code_payment").desc(), "code")
    by_code = Window.partitionBy("code")
    ranked = codes.drop("places", "__entity").join(both.select("npi", *[f"{k}_{c}" for k in ("summary", "visible") for c in MONEY]), "npi").withColumns({
        "payment_rank": F.row_number().over(order),
        "before": F.coalesce(F.sum("code_payment").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "after": F.sum("code_payment").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "cohort_payment": F.sum("code_payment").over(by_code), "cohort_standardized": F.sum("code_standardized").over(by_code),
    })
    share = lambda x, y: F.col(x).cast("double") / F.nullif(F.col(y).cast("double"), F.lit(0.0))
    ranked = ranked.withColumns({**{f"coverage_{c}": share(f"visible_{c}", f"summary_{c}") for c in MONEY}, "before_share": share("before", "visible_payment"), "after_share": share("after", "visible_payment"), **selection(ranked, cfg)})
    found = ranked.withColumn("selected", F.col("selected_by_top_n") | F.col("selected_by_cohort") | F.col("selected_by_coverage")).withColumn("selection_reasons", reasons("|", **{k: F.col(c) for k, c in SELECTED_BY.items()}))
    found = cut(found)
    n = found.filter("selected").select("code").distinct().count()
    if not 1 <= n <= cfg.selected_cap:
        raise ValueError(f"selected codes out of bounds: {n}")
    return found


def replay(found: DataFrame, cfg: DiscoveryConfig) -> None:
    """Raises unless a discovery holds together: complete ranks in payment order, exact cumulative payments that end at the
    visible payment, shares, coverage and cohort totals as they follow from the rows, and rules and reasons as configured."""
    order, by_npi = Window.partitionBy("npi").orderBy("payment_rank"), Window.partitionBy("npi")
    close = lambda x, y: F.abs(x - y) <= 1e-15 * F.greatest(F.abs(y), F.lit(1.0))  # noqa: E731  (doubles hold no 1e-18)
    real = lambda c: F.col(c).cast("double")
    again = found.withColumns({
        "__rank": F.row_number().over(order), "__end": F.coalesce(F.lag("after").over(order), F.lit(0)), "__up": F.lag("code_payment").over(order), "__code": F.lag("code").over(order),
        "__all": F.sum("code_payment").over(by_npi), "__cohort": F.sum("code_payment").over(Window.partitionBy("code")), "__cohort_std": F.sum("code_standardized").over(Window.partitionBy("code")), **{f"__{c}": v for c, v in selection(found, cfg).items()},
    })
    holds = {
        "ranks": F.col("payment_rank") == F.col("__rank"),
        "order": F.col("__up").isNull() | (F.col("__up") > F.col("code_payment")) | ((F.col("__up") == F.col("code_payment")) & (F.col("__code") < F.col("code"))),
        "cumulative": (F.col("before") == F.col("__end")) & (F.col("after") == F.col("before") + F.col("code_payment")) & (F.col("__all") == F.col("visible_payment")),
        "shares": close(F.col("before_share"), real("before") / real("visible_payment")) & close(F.col("after_share"), real("after") / real("visible_payment")),
        "coverage": close(F.col("coverage_payment"), real("visible_payment") / real("summary_payment")) & (F.col("visible_payment") >= F.col("summary_payment") * F.lit(cfg.coverage_floor).cast("decimal(10,6)")),
        "cohort": (F.col("cohort_payment") == F.col("__cohort")) & (F.col("cohort_standardized") == F.col("__cohort_std")),
        "rules": (F.col("selected_by_top_n") == F.col("__selected_by_top_n")) & (F.col("selected_by_cohort") == F.col("__selected_by_cohort")) & (F.col("selected_by_coverage") == F.col("__selected_by_coverage")),
        "reasons": (F.col("selected") == (F.col("selection_reasons") != "")) & (F.col("selection_reasons") == reasons("|", **{k: F.col(c) for k, c in SELECTED_BY.items()})),
    }
    bad = again.agg(*[F.count_if(~F.coalesce(v, F.lit(False))).alias(k) for k, v in holds.items()]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"discovery does not replay: {', '.join(f'{k}={n}' for k, n in bad.items() if n)}")


def code_freeze(found: DataFrame, cfg: DiscoveryConfig) -> DataFrame:
    """One row per selected code, with the candidates each rule names and the reasons, once the discovery replays."""
    replay(found, cfg)
    who = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c), F.col("npi")))), "|")
    frozen = found.groupBy("code").agg(
        F.bool_or("selected").alias("any"), *[F.bool_or(c).alias(c) for c in SELECTED_BY.values()], who("selected_by_top_n").alias("top_n_npis"), who("selected_by_coverage").alias("coverage_npis"),
        F.max("cohort_payment").alias("cohort_payment"), F.max("cohort_standardized").alias("cohort_standardized"), F.count("*").alias("candidate_rows"),
    )
    frozen = frozen.filter("any").drop("any").withColumn("reasons", reasons("|", **{k: F.col(c) for k, c in SELECTED_BY.items()}))
    n = frozen.count()
    if not 1 <= n <= cfg.selected_cap:
        raise ValueError(f"selected codes out of bounds: {n}")
    return frozen


def materiality_freeze(found: DataFrame, threshold, cfg: DiscoveryConfig) -> DataFrame:
    """Every code with any candidate at or above the threshold, selected by a rule or not, once the discovery replays."""
    replay(found, cfg)
    big = found.filter(F.col("code_payment") >= F.lit(threshold))
    return big.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("npi")), "|").alias("npis"), F.max("code_payment").alias("max_payment"), F.max("cohort_payment").alias("cohort_payment"), F.bool_or("selected").alias("selected"))


REVIEW_METRICS = {"services": "services_per_beneficiary", "payment": "payment_per_beneficiary", "std": "std_per_beneficiary", "claims": "claims_per_beneficiary"}


def review_cells(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cells with per-beneficiary measures, a candidate flag and whether their beneficiaries are known."""
    b = F.col("beneficiaries")
    marked = cells.join(attach_flag(candidates), "npi", "left").withColumn("candidate", F.coalesce("candidate", F.lit(False)))
    return marked.withColumns({
        "known": b.isNotNull() & (b > 0), "services_per_beneficiary": ratio(F.col("services"), b), "payment_per_beneficiary": ratio(F.col("payment"), b),
        "std_per_beneficiary": ratio(F.col("standardized"), b), "claims_per_beneficiary": ratio(F.col("claims"), b),
    })


def attach_flag(candidates: DataFrame) -> DataFrame:
    return candidates.select("npi").distinct().withColumn("candidate", F.lit(True))


STATE_METRICS = {f"state_{n}": m for n, m in REVIEW_METRICS.items()}
#: Metrics of use rather than money; their tails qualify a cell.
USE = ("claims", "services")


def portfolio_coverage(cells: DataFrame, summary: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per candidate and year the totals and concentration of its cells, what share of the summary they are, and the rest."""
    keys = ["data_year", "npi"]
    own, pay = cells.join(candidates.select("npi").distinct(), "npi", "left_semi"), F.col("payment")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(pay.desc(), "code", "pos"))
    folio = own.withColumn("place", place).groupBy(*keys).agg(
        F.count("*").alias("portfolio_cells"), F.count_distinct("code").alias("portfolio_codes"), *[F.sum(c).alias(f"portfolio_{c}") for c in ("services", "payment", "standardized")],
        F.max(pay).alias("top"), F.sum(F.when(F.col("place") <= 3, pay)).alias("top_three"), F.sum(pay * pay).alias("squares"),
    )
    both = folio.join(summary.select(*keys, *[F.col(c).alias(f"summary_{c}") for c in ("services", "payment", "standardized")]), keys)
    return both.withColumns({
        "portfolio_top_share": ratio("top", "portfolio_payment"), "portfolio_top_three_share": ratio("top_three", "portfolio_payment"), "portfolio_hhi": ratio(F.col("squares"), F.col("portfolio_payment") * F.col("portfolio_payment")),
        **{f"{c}_coverage": ratio(f"portfolio_{c}", f"summary_{c}") for c in ("services", "payment", "standardized")}, **{f"unrepresented_{c}": F.col(f"summary_{c}") - F.col(f"portfolio_{c}") for c in ("payment", "standardized")},
    }).drop("top", "top_three", "squares")


def peer_review(cells: DataFrame, summary: DataFrame, candidates: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Candidates' cells against peers outside the cohort, within year, code, place and entity, in the nation and in their state.

    Flags need enough national peers, a tail in use per beneficiary and all magnitude gates; the state's statistics are
    context and null where the state is blank. A cell qualifies over time if the focus year and an earlier year both do.
    Only the configured codes are reviewed.
    Every row also has its shares of the visible market and what its candidate's cells cover of the summary.
    """
    keys = ["data_year", "code", "pos", "entity"]
    local = [*keys, "geography"]
    cells = cells.filter(F.upper("code").isin(list(cfg.codes))) if cfg.codes else cells
    rows = review_cells(cells, candidates).withColumn("geography", F.nullif(F.upper("state"), F.lit("")))
    peer, own = F.col("known") & ~F.col("candidate"), F.col("candidate")
    # The state's strata lie within the national ones, so all statistics and ranks share one shuffle.
    def use(form, part: DataFrame) -> DataFrame:
        part = form.with_excluded_stats(form.with_excluded_stats(part, keys, REVIEW_METRICS, peer), local, STATE_METRICS, peer, "state_peer_count")
        return form.excluded_rank(form.excluded_rank(part, keys, REVIEW_METRICS, peer, F.lit(True)), local, STATE_METRICS, peer, own)

    known = scored(rows, keys, use)
    placed = F.col("geography").isNotNull()
    known = known.withColumns({c: F.when(placed, F.col(c)) for n in STATE_METRICS for c in (f"{n}_high_rank", f"{n}_peer_share", *[f"{n}_{k}" for k in ("q1", "median", "q3", "iqr", "mad")])})
    over = lambda value, quartile: exposure(F.col(value), F.col("beneficiaries"), F.col(quartile))
    known = score(score(known, REVIEW_METRICS), STATE_METRICS).withColumns({
        "state_peer_count": F.when(placed, F.col("state_peer_count")).otherwise(0),
        "raw_exposure": over("payment", "payment_q3"), "std_exposure": over("standardized", "std_q3"), "state_raw_exposure": over("payment", "state_payment_q3"), "state_std_exposure": over("standardized", "state_std_q3"),
    })
    enough = F.col("peer_count") >= cfg.minimum_peers
    status = F.when(~F.col("known"), "unknown-beneficiary-descriptive").when(enough, "scoreable").otherwise("insufficient-peer-descriptive")
    no_scale = all_gates(*[F.col(f"{n}_scale") == "degenerate" for n in USE])
    robust = lambda n: (F.col(f"{n}_z") >= cfg.z, F.col(f"{n}_ratio") >= cfg.ratio)
    tail = {f"{n}_tail": all_gates(F.col("known"), enough, F.col(f"{n}_peer_share") >= cfg.tail) for n in REVIEW_METRICS}
    tail |= {f"{n}_robust_tail": all_gates(F.col("known"), enough, F.col(f"{n}_peer_share") >= cfg.tail, *robust(n)) for n in USE}
    full = {f"{n}_full": all_gates(F.col("known"), enough, F.col(f"{n}_peer_share") >= cfg.full, *robust(n)) for n in REVIEW_METRICS}
    magnitude = all_gates(F.col("payment") >= cfg.minimum_payment, F.col("raw_exposure") >= cfg.minimum_exposure, F.col("std_exposure") >= cfg.minimum_exposure)
    out = known.withColumns({"status": status, **tail, **full, "magnitude": magnitude})
    out = out.withColumns({
        "qualification_status": F.when((F.col("status") == "scoreable") & no_scale, "degenerate-utilization-scale-descriptive").otherwise(F.col("status")),
        "tail_year": F.col("magnitude") & (F.col("claims_robust_tail") | F.col("services_robust_tail")), "full_year": F.col("magnitude") & (F.col("claims_full") | F.col("services_full")),
    })
    path = Window.partitionBy("npi", "code", "pos", "entity")
    now, before = F.col("data_year") == cfg.focus_year, F.col("data_year") < cfg.focus_year
    both = lambda c: F.bool_or(F.col(c) & now).over(path) & F.bool_or(F.col(c) & before).over(path)
    years = {"observed_years": F.count("*").over(path), **{f"{k}_years": count_where(F.col(f"{k}_year")).over(path) for k in ("tail", "full")}}
    out = out.withColumns({**years, "temporal_tail": both("tail_year"), "temporal_full": both("full_year")})
    market = market_context(cells, candidates, cfg.state, cfg.minimum_peers).select("data_year", "code", "pos", *[F.col(c).alias(f"market_{c}") for c in ("services", "payment", "standardized")], *MARKET_SHARES)
    out = attach(attach(out, market, ["data_year", "code", "pos"]), portfolio_coverage(cells, summary, candidates), ["data_year", "npi"])
    return out.withColumns({f"{c}_market_share": ratio(c, f"market_{c}") for c in ("services", "payment", "standardized")})


MARKET_SHARES = [f"{w}_{c}" for w in ("state", "cohort") for c in ("share", "services_share", "standardized_share")]


def market_context(cells: DataFrame, candidates: DataFrame, state: str, minimum_peers: int) -> DataFrame:
    """Totals, shares of one state and of the cohort, concentration and known-cell quartiles per year, code and place."""
    rows = review_cells(cells, candidates)
    here, known = F.col("state") == state, F.col("known")
    pay = F.col("payment")
    mid = lambda c, p: F.percentile(F.when(known, F.col(c)), p)
    out = rows.groupBy("data_year", "code", "pos").agg(
        F.count("*").alias("visible_cells"), F.count_if(known).alias("known_cells"), F.count_if(known & ~F.col("candidate")).alias("peer_cells"), F.count_if(~known).alias("unknown_cells"),
        *[F.sum(c).alias(c) for c in ("services", "payment", "standardized")],
        *[F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0)).alias(f"{w}_{c}") for w, cond in (("state", here), ("cohort", F.col("candidate"))) for c in ("services", "payment", "standardized")],
        (F.max(pay) / F.nullif(F.sum(pay), F.lit(0.0))).alias("top_share"), (F.sum(pay * pay) / F.nullif(F.sum(pay) * F.sum(pay), F.lit(0.0))).alias("hhi"),
        mid("services_per_beneficiary", 0.5).alias("services_median"), mid("services_per_beneficiary", 0.75).alias("services_q75"), mid("payment_per_beneficiary", 0.5).alias("payment_median"),
    )
    return out.withColumns({
        **{f"{w}_share": ratio(f"{w}_payment", "payment") for w in ("state", "cohort")}, **{f"{w}_{c}_share": ratio(f"{w}_{c}", c) for w in ("state", "cohort") for c in ("services", "standardized")},
        "peer_status": F.when(F.col("peer_cells") >= minimum_peers, "scoreable").otherwise("insufficient-cohort-excluded-peer-cells-descriptive"),
    })


def market_by_state(cells: DataFrame, candidates: DataFrame, states: DataFrame) -> DataFrame:
    """National rows for every requested state by entity, with the state's own numbers; absent states count zero.

    `states` is the short list of requested states, so the grid is a small multiple of the national rows.
    """
    keys = ["data_year", "code", "pos", "entity"]
    rows = review_cells(cells, candidates)
    peer = F.when(F.col("known") & ~F.col("candidate"), F.col("services_per_beneficiary"))
    stats = lambda p: [F.count("*").alias(f"{p}_cells"), F.sum("services").alias(f"{p}_services"), F.count(peer).alias(f"{p}_peers"), F.percentile(peer, 0.5).alias(f"{p}_median"), F.percentile(peer, 0.75).alias(f"{p}_q75")]
    national = rows.groupBy(*keys).agg(*stats("national")).withColumn("wanted", F.lit(True))
    grid = national.join(F.broadcast(states.select(F.col("state").alias("requested"))), F.col("wanted"))
    local = rows.join(F.broadcast(states), "state", "left_semi").groupBy(*keys, "state").agg(*stats("state"))
    same = F.col("requested").eqNullSafe(F.col("l.state"))
    for k in keys:
        same = same & F.col(f"g.{k}").eqNullSafe(F.col(f"l.{k}"))
    joined = grid.alias("g").join(local.alias("l"), same, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(
        *[F.col(f"g.{k}").alias(k) for k in keys], F.col("requested").alias("state"), "national_cells", "national_services", "national_peers", "national_median", "national_q75",
        zero("state_cells"), F.coalesce("state_services", F.lit(0.0)).alias("state_services"), zero("state_peers"), "state_median", "state_q75",
        F.coalesce(ratio("state_services", "national_services"), F.lit(0.0)).alias("state_share"),
    )
