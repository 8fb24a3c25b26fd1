"""Registered end-to-end analyses (D1-D27) over the bindings, each with its reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut
from ..config import TEST_DISCOVERY, TEST_REVIEW, TEST_SCAN, TEST_SCREEN
from ..operators.reshape import year_spine
from . import bindings as b
from . import claims, context, products, relations
from .registry import query

S, T = TEST_SCAN, TEST_SCREEN
BRAND, GENERIC, NPI, STATE, NATURE = "Brand#3", "generic of brand#3", "0000000007", "NATION_3", "1-URGENT"


def rounded(df: DataFrame, places: int, *columns: str) -> list:
    """Columns rounded half up, as decimals of twelve places, so that ties round one way in any engine."""
    return [F.round(F.col(c).cast("decimal(38,12)"), places).cast("double").alias(c) for c in columns]


def peer_sql(source: str, keys: str, metrics: dict[str, str], prefix: str) -> str:
    """Reference form of the peer statistics: q (quartiles), d (deviations) and <prefix> with z, scale, ratio, percentile."""
    q = ", ".join(f"quantile_cont({m}, 0.25) AS {n}_q1, quantile_cont({m}, 0.5) AS {n}_median, quantile_cont({m}, 0.75) AS {n}_q3, quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25) AS {n}_iqr" for n, m in metrics.items())
    d = ", ".join(f"quantile_cont(abs({m} - {n}_median), 0.5) AS {n}_mad" for n, m in metrics.items())
    big = lambda n, k: f"{n}_{k} > 1e-12 * greatest(1, abs({n}_median))"
    z = ", ".join(
        f"CASE WHEN {big(n, 'mad')} THEN 0.67448975 * ({m} - {n}_median) / {n}_mad WHEN {big(n, 'iqr')} THEN 1.3489795 * ({m} - {n}_median) / {n}_iqr END AS {n}_z, "
        f"CASE WHEN {m} IS NULL OR {n}_median IS NULL THEN NULL WHEN {big(n, 'mad')} THEN 'mad' WHEN {big(n, 'iqr')} THEN 'iqr-fallback' ELSE 'degenerate' END AS {n}_scale, "
        f"CASE WHEN {n}_median > 0 THEN {m} / {n}_median END AS {n}_ratio, cume_dist() OVER (PARTITION BY {keys} ORDER BY {m} ASC NULLS LAST) AS {n}_percentile"
        for n, m in metrics.items()
    )
    return f"""{prefix}_q AS (SELECT {keys}, count(*) AS peer_count, {q} FROM {source} GROUP BY {keys}),
  {prefix}_d AS (SELECT {keys}, {d} FROM {source} JOIN {prefix}_q USING ({keys}) GROUP BY {keys}),
  {prefix} AS (SELECT *, {z} FROM {source} JOIN {prefix}_q USING ({keys}) JOIN {prefix}_d USING ({keys}))"""


SCAN_BAND = "CASE WHEN panel BETWEEN 10 AND 4999 THEN '10-4999' WHEN panel BETWEEN 5000 AND 9999 THEN '5000-9999' WHEN panel BETWEEN 10000 AND 19999 THEN '10000-19999' ELSE '20000+' END"
SCAN_ROWS = f"""{b.CELLS_AND_SUMMARY}, panel AS (SELECT data_year, npi, beneficiaries AS panel, standardized AS provider_standardized FROM summary WHERE beneficiaries >= {S.minimum_panel}),
  scan_rows AS (SELECT c.* EXCLUDE (beneficiaries), c.beneficiaries AS tested, panel, {SCAN_BAND} AS panel_band, c.beneficiaries / nullif(panel, 0) AS panel_penetration,
    c.bene_days / nullif(c.beneficiaries, 0) AS days_per_tested, c.services / nullif(c.bene_days, 0) AS units_per_day, c.standardized / nullif(panel, 0) AS std_per_panel,
    c.standardized / nullif(provider_standardized, 0) AS std_share
    FROM cells c JOIN panel p ON c.data_year = p.data_year AND c.npi = p.npi WHERE c.beneficiaries >= {S.minimum_descriptive} AND c.services > 0 AND c.bene_days > 0),
  tested_rows AS (SELECT * FROM scan_rows WHERE tested >= {S.minimum_tested})"""
_KEYS = "data_year, specialty, entity, code, pos, panel_band"
_BROAD = "data_year, specialty, entity, code, pos"
_ID = "PARTITION BY npi, specialty, entity, code, pos"


def _gate(n: str, more: str = "") -> str:
    return f"coalesce(tested >= {S.minimum_tested} AND peer_count >= {S.minimum_peers} AND {n}_percentile >= {S.full} AND {n}_z >= {S.z} AND {n}_ratio >= {S.ratio}{more}, false)"


def _route(kind: str, none: str) -> str:
    return f"CASE WHEN reach_{kind} AND (days_{kind} OR units_{kind}) THEN 'reach-and-intensity' WHEN reach_{kind} THEN 'reach' WHEN days_{kind} OR units_{kind} THEN 'intensity' ELSE '{none}' END"


SCAN = f"""{SCAN_ROWS}, {peer_sql('tested_rows', _KEYS, claims.SCAN_METRICS, 'scored')},
  wide AS (SELECT *, count(*) OVER (PARTITION BY {_BROAD}) AS broad_peer_count, cume_dist() OVER (PARTITION BY {_BROAD} ORDER BY panel_penetration ASC NULLS LAST) AS reach_broad_percentile,
    cume_dist() OVER (PARTITION BY {_BROAD} ORDER BY days_per_tested ASC NULLS LAST) AS days_broad_percentile FROM scored),
  every AS (SELECT * FROM wide UNION ALL BY NAME SELECT * FROM scan_rows WHERE tested < {S.minimum_tested}),
  flagged AS (SELECT *, CASE WHEN tested < {S.minimum_tested} THEN 'insufficient-volume-descriptive' WHEN peer_count >= {S.minimum_peers} THEN 'scoreable' ELSE 'insufficient-peer-descriptive' END AS status,
    {_gate('reach', f' AND panel_penetration - reach_median >= {S.difference}')} AS reach_flag, {_gate('days')} AS days_flag, {_gate('units')} AS units_flag FROM every),
  timed AS (SELECT *, count(*) FILTER (status = 'scoreable') OVER ({_ID}) AS comparable_years, max(data_year) OVER ({_ID}) = {S.to_year} AS latest_present,
    {', '.join(f"count(*) FILTER (status = 'scoreable' AND {n}_percentile >= {S.tail}) OVER ({_ID}) AS {n}_tail_years, count(*) FILTER ({n}_flag) OVER ({_ID}) AS {n}_full_years" for n in claims.SCAN_METRICS)} FROM flagged),
  confirmed AS (SELECT *, {', '.join(f"latest_present AND comparable_years >= {S.comparable_years} AND {n}_tail_years >= {S.tail_years} AND {n}_full_years >= {S.full_years} AS {n}_confirmed" for n in claims.SCAN_METRICS)} FROM timed),
  scan AS (SELECT *, CASE WHEN tested < {S.minimum_tested} THEN 'insufficient-volume' WHEN status <> 'scoreable' THEN 'insufficient-peer' ELSE {_route('flag', 'none')} END AS route, {_route('confirmed', 'not-confirmed')} AS temporal_route,
    CASE WHEN tested < {S.minimum_tested} THEN 'insufficient-volume' WHEN status = 'insufficient-peer-descriptive' AND broad_peer_count >= {S.minimum_peers} AND (reach_broad_percentile >= {S.full} OR days_broad_percentile >= {S.full}) THEN 'broader-peer-tail-descriptive'
      WHEN status = 'insufficient-peer-descriptive' THEN 'insufficient-peer' ELSE 'not-applicable' END AS broad_status FROM confirmed)"""


#: The label that strata are made of: two kinds of suppliers, as regions leave too few peers to a stratum of the test tables.
KIND = "CASE WHEN CAST(npi AS BIGINT) % 3 = 0 THEN 'clinic' ELSE 'pharmacy' END"


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("specialty", F.when(F.col("npi").cast("long") % 3 == 0, "clinic").otherwise("pharmacy"))


#: Measures that the scan reads.
SCAN_NEEDS = ("beneficiaries", "bene_days", "services", "standardized")


def panel_cells(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    cells, summary = b.cells_and_summary(spark, sf_dir, needs=(*SCAN_NEEDS, *more))
    return labelled(cells), labelled(summary)


FLAT_SCAN = SCAN.replace("SELECT c.* EXCLUDE (beneficiaries), ", f"SELECT c.* EXCLUDE (beneficiaries, specialty), {KIND.replace('npi', 'c.npi')} AS specialty, ")


def scan(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The scan, with further measures of its cells where stated."""
    return claims.provider_service_scan(*panel_cells(spark, sf_dir, *more), S)


_SCAN_FIXED = ["data_year", "npi", "code", "pos", "entity", "specialty", "panel_band", "tested", "status", "reach_flag", "days_flag", "units_flag", "route", "temporal_route", "broad_status", "comparable_years", "reach_tail_years", "units_full_years", "latest_present", "peer_count", "broad_peer_count", "reach_scale"]
_SCAN_ROUND = ["panel_penetration", "days_per_tested", "units_per_day", "std_per_panel", "std_share", "reach_median", "reach_mad", "days_iqr", "reach_percentile", "units_percentile", "reach_broad_percentile"]
_SCAN_Z = ["reach_z", "days_z", "units_z", "reach_ratio"]
_r = lambda cols, n: ", ".join(f"CAST(round(CAST({c} AS DECIMAL(38,12)), {n}) AS DOUBLE) AS {c}" for c in cols)


@query("d1_provider_service_scan", f"SELECT {', '.join(_SCAN_FIXED)}, {_r(_SCAN_ROUND, 6)}, {_r(_SCAN_Z, 6)} FROM scan", FLAT_SCAN)
def d1(spark, sf_dir):
    df = scan(spark, sf_dir)
    return df.select(*_SCAN_FIXED, *rounded(df, 6, *_SCAN_ROUND), *rounded(df, 6, *_SCAN_Z))


@query(
    "d2_shortlist",
    f"""SELECT npi, code, pos, priority, reasons, CAST(round(CAST(panel_penetration AS DECIMAL(38,12)), 6) AS DOUBLE) AS panel_penetration FROM (SELECT *, concat_ws(';', CASE WHEN reach_confirmed THEN 'temporal-reach' END, CASE WHEN days_confirmed THEN 'temporal-repeat' END, CASE WHEN units_confirmed THEN 'temporal-unit' END,
      CASE WHEN reach_flag THEN 'latest-full-reach' END, CASE WHEN days_flag THEN 'latest-full-repeat' END, CASE WHEN units_flag THEN 'latest-full-unit' END,
      CASE WHEN broad_status = 'broader-peer-tail-descriptive' AND reach_broad_percentile >= {S.full} THEN 'broader-peer-reach-provisional' END,
      CASE WHEN broad_status = 'broader-peer-tail-descriptive' AND days_broad_percentile >= {S.full} THEN 'broader-peer-repeat-provisional' END) AS reasons,
    CASE WHEN reach_confirmed AND (days_confirmed OR units_confirmed) THEN 1 WHEN reach_confirmed THEN 2 WHEN days_confirmed OR units_confirmed THEN 3 WHEN reach_flag AND (days_flag OR units_flag) THEN 4
      WHEN reach_flag THEN 5 WHEN days_flag OR units_flag THEN 6 ELSE 7 END AS priority FROM scan WHERE data_year = {S.to_year}) WHERE reasons <> ''""",
    FLAT_SCAN,
)
def d2(spark, sf_dir):
    df = claims.shortlist(scan(spark, sf_dir), S)
    return df.select("npi", "code", "pos", "priority", "reasons", *rounded(None, 6, "panel_penetration"))


@query(
    "d3_multicode_reach",
    """WITH tail AS (SELECT npi, specialty, entity, pos, code, count(*) AS years, max(data_year) AS last, min(reach_percentile) AS low, string_agg(CAST(data_year AS VARCHAR), ',' ORDER BY data_year) AS year_list
      FROM scan WHERE status = 'scoreable' AND reach_percentile >= 0.7 GROUP BY ALL),
    stable AS (SELECT * FROM tail WHERE years >= 2 AND last = (SELECT max(data_year) FROM scan)),
    paid AS (SELECT npi, entity, pos, code, sum(payment) AS payment FROM scan GROUP BY ALL)
    SELECT npi, entity, pos, code, years, year_list, CAST(round(CAST(low AS DECIMAL(38,12)), 6) AS DOUBLE) AS low, CAST(round(CAST(payment AS DECIMAL(38,12)), 2) AS DOUBLE) AS payment, n AS codes_in_group FROM (SELECT *, count(*) OVER (PARTITION BY npi, entity, pos) AS n FROM stable) JOIN paid USING (npi, entity, pos, code) WHERE n >= 2""",
    FLAT_SCAN,
)
def d3(spark, sf_dir):
    df = claims.multicode_reach(scan(spark, sf_dir, "payment"), 0.7, 2, 2, S.to_year)
    return df.select("npi", "entity", "pos", "code", "years", "year_list", *rounded(None, 6, "low"), *rounded(None, 2, "payment"), "codes_in_group")


_CAT = f"""CASE WHEN payment <= 0 OR (coalesce(dme, 0) = 0 AND coalesce(pos_paid, 0) = 0 AND coalesce(drug, 0) = 0) THEN 'none' WHEN (coalesce(dme, 0) + coalesce(pos_paid, 0) + coalesce(drug, 0)) / payment < {T.dominance} THEN 'unclassified'
  WHEN coalesce(dme, 0) / payment >= {T.dominance} THEN 'DME' WHEN coalesce(pos_paid, 0) / payment >= {T.dominance} THEN 'POS' WHEN coalesce(drug, 0) / payment >= {T.dominance} THEN 'Drug' ELSE 'mixed' END"""
_SKEYS = "data_year, entity, specialty, category, band"
_PATH = "PARTITION BY npi, entity, specialty, category"
_full = lambda n: f"coalesce(peer_count >= {T.minimum_peers} AND {n}_percentile >= {T.full} AND {n}_z >= {T.z} AND {n}_ratio >= {T.ratio}, false)"
SCREEN = f"""{b.SUMMARY}, screen_rows AS (SELECT * REPLACE ({KIND} AS specialty), {_CAT} AS category, CASE WHEN beneficiaries BETWEEN 20 AND 74 THEN '20-74' WHEN beneficiaries BETWEEN 75 AND 89 THEN '75-89' ELSE '90+' END AS band,
    standardized / nullif(beneficiaries, 0) AS std_per_beneficiary, payment / nullif(beneficiaries, 0) AS raw_per_beneficiary, claims / nullif(beneficiaries, 0) AS claims_per_beneficiary, services / nullif(beneficiaries, 0) AS services_per_beneficiary
    FROM summary WHERE data_year IN (1999, 2000, 2001) AND beneficiaries >= {T.minimum_panel}),
  {peer_sql('screen_rows', _SKEYS, claims.SCREEN_METRICS, 'screened')},
  gated AS (SELECT *, greatest(0, payment - beneficiaries * raw_q3) AS raw_exposure, greatest(0, standardized - beneficiaries * std_q3) AS std_exposure, peer_count >= {T.minimum_peers} AS scoreable,
    {', '.join(f'{_full(n)} AS {n}_full' for n in claims.SCREEN_METRICS)}, coalesce(peer_count >= {T.minimum_peers} AND std_percentile >= {T.tail}, false) AS std_tail,
    coalesce(peer_count >= {T.minimum_peers} AND (claims_percentile >= {T.tail} OR services_percentile >= {T.tail}), false) AS use_tail FROM screened),
  sized AS (SELECT *, payment >= {T.minimum_payment} AND raw_exposure >= {T.minimum_exposure} AND std_exposure >= {T.minimum_exposure} AS magnitude FROM gated),
  yearly AS (SELECT *, magnitude AND std_tail AND use_tail AS tail_year, magnitude AND std_full AND (claims_full OR services_full) AS full_year FROM sized),
  path AS (SELECT *, count(*) FILTER (scoreable) OVER ({_PATH}) AS comparable_years, count(*) FILTER (tail_year) OVER ({_PATH}) AS tail_years, count(*) FILTER (full_year) OVER ({_PATH}) AS full_years, max(data_year) OVER ({_PATH}) = 2001 AS latest_present FROM yearly),
  screen AS (SELECT *, comparable_years = 3 AND tail_years >= 2 AND full_years >= 1 AND latest_present AS persistent, CASE WHEN comparable_years = 3 AND tail_years >= 2 AND full_years >= 1 AND latest_present THEN 'high-dollar-persistent'
    WHEN data_year = 2001 AND full_year THEN 'high-dollar-emerging' WHEN payment >= {T.minimum_payment} THEN 'high-spend-context' ELSE 'not-qualified' END AS route FROM path)"""
_SC_FIXED = ["data_year", "npi", "entity", "specialty", "category", "band", "beneficiaries", "claims", "peer_count", "scoreable", "std_full", "raw_full", "claims_full", "services_full", "std_tail", "use_tail", "magnitude", "tail_year", "full_year", "comparable_years", "tail_years", "full_years", "persistent", "route", "std_scale"]
_SC_ROUND = ["std_per_beneficiary", "raw_per_beneficiary", "claims_per_beneficiary", "std_median", "raw_q3", "std_percentile", "services_percentile"]
_SC_Z = ["std_z", "raw_ratio", "services_z"]
_SC_MONEY = ["raw_exposure", "std_exposure"]


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.supplier_screen(labelled(b.summary(spark, sf_dir)), T)


@query("d4_supplier_screen", f"SELECT {', '.join(_SC_FIXED)}, {_r(_SC_ROUND, 5)}, {_r(_SC_Z, 6)}, {_r(_SC_MONEY, 3)} FROM screen", SCREEN)
def d4(spark, sf_dir):
    df = screen(spark, sf_dir)
    return df.select(*_SC_FIXED, *rounded(df, 5, *_SC_ROUND), *rounded(df, 6, *_SC_Z), *rounded(df, 3, *_SC_MONEY))


SHORT = "SELECT data_year, npi, category, route, tail_years, full_years FROM screen WHERE data_year = 2001 AND route IN ('high-dollar-persistent', 'high-dollar-emerging')"


@query("d5_anonymous_shortlist", SHORT, SCREEN)
def d5(spark, sf_dir):
    rows = screen(spark, sf_dir).withColumns({"screen_tail": F.lit(T.tail), "source_release_id": F.col("data_year") * 10})
    return claims.anonymous_shortlist(rows, T, ["screen_tail"], "source_release_id").select("data_year", "npi", "category", "route", "tail_years", "full_years")


def names(spark, sf_dir):
    s, n = b.read(spark, sf_dir, "supplier"), b.read(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("npi"), F.col("s_name").alias("name"), F.col("n_name").alias("state"))


NAMES = "names AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS npi, s_name AS name, n_name AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query("d6_frozen_identities", "SELECT npi, name, state FROM names WHERE CAST(npi AS BIGINT) % 7 = 0", NAMES)
def d6(spark, sf_dir):
    known = names(spark, sf_dir)
    return claims.frozen_identities(known.filter(F.col("npi").cast("long") % 7 == 0), known, ["npi"], ["name", "state"])


@query("d7_shortlist_identities", f"WITH short AS ({SHORT}) SELECT short.*, name, state FROM short JOIN names USING (npi)", f"{SCREEN}, {NAMES}")
def d7(spark, sf_dir):
    short = d5(spark, sf_dir)
    return short.join(claims.frozen_identities(short, names(spark, sf_dir), ["npi"], ["name", "state"]), "npi")


YEAR = 2000


def candidate_parts(spark, sf_dir):
    cells, summary = b.cells_and_summary(spark, sf_dir, exact=True, needs=("claims", "services", *claims.MONEY), year=YEAR)
    return summary, cells, summary.filter(F.col("npi").cast("long") % 5 == 0).select("npi").distinct()


D = TEST_DISCOVERY
DISCOVERY = f"""{b.EXACT_CELLS_AND_SUMMARY}, codes AS (SELECT npi, code, min(entity) AS entity, count(*) AS cells, string_agg(pos, ',' ORDER BY pos) AS indicators, CAST(sum(claims) AS BIGINT) AS cell_claims, sum(services) AS services,
    {', '.join(f'sum({c}) AS code_{c}' for c in claims.MONEY)} FROM cells WHERE data_year = {YEAR} AND CAST(npi AS BIGINT) % 5 = 0 GROUP BY ALL),
  folio AS (SELECT npi, {', '.join(f'sum(code_{c}) AS visible_{c}' for c in claims.MONEY)} FROM codes GROUP BY npi),
  ranked AS (SELECT codes.*, folio.* EXCLUDE (npi), {', '.join(f's.{c} AS summary_{c}' for c in claims.MONEY)}, row_number() OVER (PARTITION BY npi ORDER BY code_payment DESC, code) AS payment_rank,
    coalesce(sum(code_payment) OVER (PARTITION BY npi ORDER BY code_payment DESC, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(code_payment) OVER (PARTITION BY npi ORDER BY code_payment DESC, code ROWS UNBOUNDED PRECEDING) AS after,
    sum(code_payment) OVER (PARTITION BY code) AS cohort_payment, sum(code_standardized) OVER (PARTITION BY code) AS cohort_standardized FROM codes JOIN folio USING (npi) JOIN summary s USING (npi) WHERE s.data_year = {YEAR}),
  ruled AS (SELECT *, payment_rank <= {D.top_codes} AS selected_by_top_n, cohort_payment >= {D.cohort_payment} AS selected_by_cohort, before < visible_payment * {D.cumulative_share} AS selected_by_coverage FROM ranked),
  found AS (SELECT *, selected_by_top_n OR selected_by_cohort OR selected_by_coverage AS selected, CAST(before AS DOUBLE) / CAST(visible_payment AS DOUBLE) AS before_share, CAST(after AS DOUBLE) / CAST(visible_payment AS DOUBLE) AS after_share,
    {', '.join(f'CAST(visible_{c} AS DOUBLE) / nullif(CAST(summary_{c} AS DOUBLE), 0) AS coverage_{c}' for c in claims.MONEY)},
    concat_ws('|', CASE WHEN selected_by_top_n THEN 'candidate-top-n' END, CASE WHEN selected_by_cohort THEN 'cohort-payment-floor' END, CASE WHEN selected_by_coverage THEN 'candidate-coverage-target' END) AS selection_reasons FROM ruled)"""
_D_FIXED = ["npi", "entity", "code", "cells", "indicators", "cell_claims", "payment_rank", "before_share", "after_share", *[f"coverage_{c}" for c in claims.MONEY], *claims.SELECTED_BY.values(), "selected", "selection_reasons"]
_D_MONEY = ["services", *[f"{k}_{c}" for k in ("code", "summary", "visible") for c in claims.MONEY], "before", "after", "cohort_payment", "cohort_standardized"]
_real = lambda cols: [F.col(c).cast("double").alias(c) for c in cols]
_real_sql = lambda cols: ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
MATERIAL = 1_250_000


def found_codes(spark, sf_dir):
    return claims.discovery(*candidate_parts(spark, sf_dir), D)


@query("d8_code_discovery", f"SELECT {', '.join(_D_FIXED)}, {_real_sql(_D_MONEY)} FROM found", DISCOVERY)
def d8(spark, sf_dir):
    return found_codes(spark, sf_dir).select(*_D_FIXED, *_real(_D_MONEY))


@query(
    "d9_code_freeze",
    """SELECT code, bool_or(selected_by_top_n) AS selected_by_top_n, bool_or(selected_by_cohort) AS selected_by_cohort, bool_or(selected_by_coverage) AS selected_by_coverage, coalesce(string_agg(npi, '|' ORDER BY npi) FILTER (selected_by_top_n), '') AS top_n_npis,
      coalesce(string_agg(npi, '|' ORDER BY npi) FILTER (selected_by_coverage), '') AS coverage_npis, CAST(max(cohort_payment) AS DOUBLE) AS cohort_payment, CAST(max(cohort_standardized) AS DOUBLE) AS cohort_standardized, count(*) AS candidate_rows,
      concat_ws('|', CASE WHEN bool_or(selected_by_top_n) THEN 'candidate-top-n' END, CASE WHEN bool_or(selected_by_cohort) THEN 'cohort-payment-floor' END, CASE WHEN bool_or(selected_by_coverage) THEN 'candidate-coverage-target' END) AS reasons FROM found GROUP BY code HAVING bool_or(selected)""",
    DISCOVERY,
)
def d9(spark, sf_dir):
    df = claims.code_freeze(found_codes(spark, sf_dir), D)
    return df.select(*[c for c in df.columns if not c.startswith("cohort_")], *_real(["cohort_payment", "cohort_standardized"]))


@query("d10_materiality_freeze", f"SELECT code, string_agg(npi, '|' ORDER BY npi) AS npis, CAST(max(code_payment) AS DOUBLE) AS max_payment, CAST(max(cohort_payment) AS DOUBLE) AS cohort_payment, bool_or(selected) AS selected FROM found WHERE code_payment >= {MATERIAL} GROUP BY code", DISCOVERY)
def d10(spark, sf_dir):
    return claims.materiality_freeze(found_codes(spark, sf_dir), MATERIAL, D).select("code", "npis", "selected", *_real(["max_payment", "cohort_payment"]))


C = TEST_REVIEW
REVIEW = f"""{b.CELLS_AND_SUMMARY}, review AS (SELECT *, upper(state) AS geography, CAST(npi AS BIGINT) % 5 = 0 AS candidate, beneficiaries IS NOT NULL AND beneficiaries > 0 AS known, services / nullif(beneficiaries, 0) AS services_per_beneficiary,
  payment / nullif(beneficiaries, 0) AS payment_per_beneficiary, standardized / nullif(beneficiaries, 0) AS std_per_beneficiary, claims / nullif(beneficiaries, 0) AS claims_per_beneficiary FROM service_cells)"""
_RK = "data_year, code, pos, entity"
_here = "p.known AND NOT p.candidate AND p.data_year = x.data_year AND p.code = x.code AND p.pos = x.pos AND p.entity = x.entity"
_rank = lambda n, m, where=_here, peers="peer_count": f"CASE WHEN x.{m} IS NOT NULL AND {peers} > 0 THEN 1 + (SELECT count(*) FROM review p WHERE {where} AND p.{m} > x.{m}) END AS {n}_high_rank"
_share = lambda n, m, where=_here, peers="peer_count": f"CASE WHEN x.{m} IS NOT NULL AND {peers} > 0 THEN (SELECT count(*) FROM review p WHERE {where} AND p.{m} <= x.{m}) / {peers} END AS {n}_peer_share"
_in_state = f"{_here} AND p.geography = x.geography"
_RM = claims.REVIEW_METRICS
_TAIL = lambda n, more="", at=C.tail: f"coalesce(known AND peer_count >= {C.minimum_peers} AND {n}_peer_share >= {at}{more}, false)"
_STRONG = lambda n: f" AND {n}_z >= {C.z} AND {n}_ratio >= {C.ratio}"
_RPATH = "PARTITION BY npi, code, pos, entity"
_same = lambda keys, x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
_over = lambda value, q: f"CASE WHEN {q} IS NOT NULL AND beneficiaries IS NOT NULL THEN greatest(0, {value} - beneficiaries * {q}) END"
_zed = lambda n, m: f"CASE WHEN {n}_mad > 1e-12 * greatest(1, abs({n}_median)) THEN 0.67448975 * ({m} - {n}_median) / {n}_mad WHEN {n}_iqr > 1e-12 * greatest(1, abs({n}_median)) THEN 1.3489795 * ({m} - {n}_median) / {n}_iqr END"
_MONEY3 = ("services", "payment", "standardized")
PEER_REVIEW = f"""{REVIEW.replace('FROM service_cells)', "FROM service_cells WHERE code IN ('" + "', '".join(C.codes) + "'))")}, peers AS (SELECT * FROM review WHERE known AND NOT candidate), {peer_sql('peers', _RK, _RM, 'stats')}, {peer_sql('peers', _RK + ', geography', _RM, 'near')},
  stat AS (SELECT DISTINCT {_RK}, peer_count, {', '.join(f'{n}_median, {n}_q3, {n}_iqr, {n}_mad' for n in _RM)} FROM stats),
  near_stat AS (SELECT DISTINCT {_RK}, geography, peer_count AS state_peer_count, {', '.join(f'{n}_{k} AS state_{n}_{k}' for n in _RM for k in ('median', 'q3', 'iqr', 'mad'))} FROM near),
  placed AS (SELECT x.*, stat.* EXCLUDE ({_RK}), near_stat.* EXCLUDE ({_RK}, geography), {', '.join(_rank(n, m) for n, m in _RM.items())}, {', '.join(_share(n, m) for n, m in _RM.items())},
      {', '.join(_rank('state_' + n, m, _in_state, 'state_peer_count') for n, m in _RM.items())}, {', '.join(_share('state_' + n, m, _in_state, 'state_peer_count') for n, m in _RM.items())}
    FROM (SELECT * FROM review WHERE candidate) x LEFT JOIN stat ON {_same(_RK, 'x', 'stat')} LEFT JOIN near_stat ON {_same(_RK + ', geography', 'x', 'near_stat')}),
  judged AS (SELECT *, {_over('payment', 'payment_q3')} AS raw_exposure, {_over('standardized', 'std_q3')} AS std_exposure, {_over('payment', 'state_payment_q3')} AS state_raw_exposure, {_over('standardized', 'state_std_q3')} AS state_std_exposure,
    CASE WHEN NOT known THEN 'unknown-beneficiary-descriptive' WHEN peer_count >= {C.minimum_peers} THEN 'scoreable' ELSE 'insufficient-peer-descriptive' END AS status,
    {', '.join(f'{_zed(n, m)} AS {n}_z, CASE WHEN {n}_median > 0 THEN {m} / {n}_median END AS {n}_ratio, {_zed("state_" + n, m)} AS state_{n}_z' for n, m in _RM.items())} FROM placed),
  sized AS (SELECT *, coalesce(payment >= {C.minimum_payment} AND raw_exposure >= {C.minimum_exposure} AND std_exposure >= {C.minimum_exposure}, false) AS magnitude, {', '.join(f'{_TAIL(n)} AS {n}_tail, {_TAIL(n, _STRONG(n), C.full)} AS {n}_full' for n in _RM)},
    {', '.join(f'{_TAIL(n, _STRONG(n))} AS {n}_robust_tail' for n in claims.USE)}, CASE WHEN status = 'scoreable' AND claims_z IS NULL AND services_z IS NULL THEN 'degenerate-utilization-scale-descriptive' ELSE status END AS qualification_status FROM judged),
  yearly AS (SELECT *, magnitude AND (claims_robust_tail OR services_robust_tail) AS tail_year, magnitude AND (claims_full OR services_full) AS full_year FROM sized),
  timed AS (SELECT *, count(*) OVER ({_RPATH}) AS observed_years, count(*) FILTER (tail_year) OVER ({_RPATH}) AS tail_years, count(*) FILTER (full_year) OVER ({_RPATH}) AS full_years,
      {', '.join(f'bool_or({k}_year AND data_year = {C.focus_year}) OVER ({_RPATH}) AND bool_or({k}_year AND data_year < {C.focus_year}) OVER ({_RPATH}) AS temporal_{k}' for k in ('tail', 'full'))} FROM yearly),
  market AS (SELECT data_year, code, pos, {', '.join(f"sum({c}) AS market_{c}, coalesce(sum({c}) FILTER (state = '{C.state}'), 0) AS state_{c}, coalesce(sum({c}) FILTER (candidate), 0) AS cohort_{c}" for c in _MONEY3)} FROM review GROUP BY ALL),
  folio AS (SELECT data_year, npi, count(*) AS portfolio_cells, count(DISTINCT code) AS portfolio_codes, {', '.join(f'sum({c}) AS portfolio_{c}' for c in _MONEY3)}, max(payment) / sum(payment) AS portfolio_top_share, list_sum(list_sort(list(payment), 'DESC')[1:3]) / sum(payment) AS portfolio_top_three_share,
    sum(payment * payment) / (sum(payment) * sum(payment)) AS portfolio_hhi FROM review WHERE candidate GROUP BY ALL),
  peer_review AS (SELECT y.*, folio.* EXCLUDE (data_year, npi), {', '.join(f'portfolio_{c} / nullif(s.{c}, 0) AS {c}_coverage, y.{c} / nullif(market_{c}, 0) AS {c}_market_share' for c in _MONEY3)}, s.payment - portfolio_payment AS unrepresented_payment, s.standardized - portfolio_standardized AS unrepresented_standardized,
      {', '.join(f"{w}_{c} / nullif(market_{c}, 0) AS {w}_{'' if c == 'payment' else c + '_'}share" for w in ('state', 'cohort') for c in _MONEY3)}
    FROM timed y JOIN market m ON {_same('data_year, code, pos', 'y', 'm')} JOIN folio ON {_same('data_year, npi', 'y', 'folio')} JOIN summary s ON {_same('data_year, npi', 'y', 's')})"""
_PR_FIXED = ["data_year", "npi", "code", "pos", "entity", "status", "qualification_status", "services_high_rank", "std_high_rank", "state_services_high_rank", "state_payment_high_rank", "services_tail", "std_tail", "claims_robust_tail", "services_robust_tail", "services_full", "payment_full", "magnitude", "tail_year", "full_year", "observed_years", "tail_years", "full_years", "temporal_tail", "temporal_full", "portfolio_cells", "portfolio_codes"]
_PR_ROUND = ["services_per_beneficiary", "services_median", "services_peer_share", "claims_peer_share", "std_z", "state_services_median", "state_services_peer_share", "state_std_z", "state_claims_q3", "services_market_share", "payment_market_share", "standardized_market_share", *claims.MARKET_SHARES, "portfolio_top_share", "portfolio_top_three_share", "portfolio_hhi", "services_coverage", "payment_coverage", "standardized_coverage"]
_PR_MONEY = ["raw_exposure", "state_raw_exposure", "state_std_exposure"]
_PR_EXACT = ["unrepresented_payment", "unrepresented_standardized"]


def review_parts(spark, sf_dir):
    return b.service_cells(spark, sf_dir), review_candidates(spark, sf_dir)


def review_candidates(spark, sf_dir):
    return b.read(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 5 == 0).select(F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("npi"))


@query("d11_peer_review", f"SELECT {', '.join(_PR_FIXED)}, coalesce(peer_count, 0) AS peer_count, coalesce(state_peer_count, 0) AS state_peer_count, {_r(_PR_ROUND, 6)}, {_r(_PR_MONEY, 3)}, {_r(_PR_EXACT, 4)} FROM peer_review", PEER_REVIEW)
def d11(spark, sf_dir):
    cells, summary = b.cells_and_summary(spark, sf_dir)
    df = claims.peer_review(b.suppressed(cells), summary, review_candidates(spark, sf_dir), C)
    return df.select(*_PR_FIXED, "peer_count", "state_peer_count", *rounded(df, 6, *_PR_ROUND), *rounded(df, 3, *_PR_MONEY), *rounded(df, 4, *_PR_EXACT))


@query(
    "d12_market_context",
    f"""SELECT data_year, code, pos, count(*) AS visible_cells, count(*) FILTER (known) AS known_cells, count(*) FILTER (known AND NOT candidate) AS peer_cells, count(*) FILTER (NOT known) AS unknown_cells, CAST(round(CAST(sum(services) AS DECIMAL(38,12)), 4) AS DOUBLE) AS services, CAST(round(CAST(sum(payment) AS DECIMAL(38,12)), 4) AS DOUBLE) AS payment,
      CAST(round(CAST(max(payment) / nullif(sum(payment), 0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS top_share, CAST(round(CAST(sum(payment * payment) / nullif(sum(payment) * sum(payment), 0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS hhi, CAST(round(CAST(quantile_cont(services_per_beneficiary, 0.5) FILTER (known) AS DECIMAL(38,12)), 6) AS DOUBLE) AS services_median,
      CAST(round(CAST(quantile_cont(services_per_beneficiary, 0.75) FILTER (known) AS DECIMAL(38,12)), 6) AS DOUBLE) AS services_q75, CAST(round(CAST(coalesce(sum(payment) FILTER (state = '{STATE}'), 0) / nullif(sum(payment), 0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS state_share,
      CAST(round(CAST(coalesce(sum(payment) FILTER (candidate), 0) / nullif(sum(payment), 0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS cohort_share, CASE WHEN count(*) FILTER (known AND NOT candidate) >= 60 THEN 'scoreable' ELSE 'insufficient-cohort-excluded-peer-cells-descriptive' END AS peer_status FROM review GROUP BY data_year, code, pos""",
    REVIEW,
)
def d12(spark, sf_dir):
    df = claims.market_context(*review_parts(spark, sf_dir), STATE, 60)
    return df.select("data_year", "code", "pos", "visible_cells", "known_cells", "peer_cells", "unknown_cells", *rounded(df, 4, "services", "payment"), *rounded(df, 6, "top_share", "hhi", "services_median", "services_q75", "state_share", "cohort_share"), "peer_status")


@query(
    "d13_market_by_state",
    """WITH wanted AS (SELECT unnest(['NATION_3', 'NATION_7', 'NOWHERE']) AS state), nat AS (SELECT data_year, code, pos, entity, count(*) AS national_cells, sum(services) AS national_services, count(services_per_beneficiary) FILTER (known AND NOT candidate) AS national_peers,
        quantile_cont(services_per_beneficiary, 0.5) FILTER (known AND NOT candidate) AS national_median FROM review GROUP BY ALL),
      loc AS (SELECT data_year, code, pos, entity, state, count(*) AS state_cells, sum(services) AS state_services, count(services_per_beneficiary) FILTER (known AND NOT candidate) AS state_peers, quantile_cont(services_per_beneficiary, 0.75) FILTER (known AND NOT candidate) AS state_q75 FROM review GROUP BY ALL)
    SELECT nat.data_year, nat.code, nat.pos, nat.entity, wanted.state, national_cells, national_peers, CAST(round(CAST(national_median AS DECIMAL(38,12)), 6) AS DOUBLE) AS national_median, coalesce(state_cells, 0) AS state_cells, coalesce(state_peers, 0) AS state_peers, CAST(round(CAST(state_q75 AS DECIMAL(38,12)), 6) AS DOUBLE) AS state_q75,
      CAST(round(CAST(coalesce(state_services / nullif(national_services, 0), 0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS state_share
    FROM nat CROSS JOIN wanted LEFT JOIN loc ON nat.data_year IS NOT DISTINCT FROM loc.data_year AND nat.code IS NOT DISTINCT FROM loc.code AND nat.pos IS NOT DISTINCT FROM loc.pos AND nat.entity IS NOT DISTINCT FROM loc.entity AND wanted.state = loc.state""",
    REVIEW,
)
def d13(spark, sf_dir):
    states = spark.createDataFrame([("NATION_3",), ("NATION_7",), ("NOWHERE",)], "state string")
    df = claims.market_by_state(*review_parts(spark, sf_dir), states)
    return df.select("data_year", "code", "pos", "entity", "state", "national_cells", "national_peers", *rounded(None, 6, "national_median"), "state_cells", "state_peers", *rounded(df, 6, "state_q75", "state_share"))


PRODUCT = f"lower(brand) = lower('{BRAND}') AND lower(generic) = lower('{GENERIC}')"


@query(
    "d14_trajectory",
    f"""WITH base AS (SELECT *, cost / nullif(claims, 0) AS cost_per_claim FROM provider_drug WHERE {PRODUCT}), ranked AS (SELECT *, rank() OVER (PARTITION BY data_year ORDER BY claims DESC) AS claims_rank, percent_rank() OVER (PARTITION BY data_year ORDER BY claims) AS claims_percent_rank,
        count(*) OVER (PARTITION BY data_year) AS visible_rows, sum(claims) OVER (PARTITION BY data_year) AS visible_claims FROM base),
      spread AS (SELECT data_year, quantile_cont(claims, 0.999) AS claims_p999, quantile_cont(cost_per_claim, 0.5) AS median_cost, quantile_cont(cost_per_claim, 0.01) AS p01_cost, quantile_cont(cost_per_claim, 0.99) AS p99_cost FROM base GROUP BY data_year),
      own AS (SELECT ranked.*, claims_p999, median_cost, p01_cost, p99_cost, national_claims, national_cost FROM ranked JOIN spread USING (data_year) LEFT JOIN (SELECT * FROM national_drug WHERE {PRODUCT}) USING (data_year) WHERE npi = '{NPI}'),
      timed AS (SELECT *, lag(data_year) OVER (ORDER BY data_year) AS previous_year, lag(claims) OVER (ORDER BY data_year) AS previous_claims FROM own)
    SELECT data_year, npi, claims, claims_rank, visible_rows, previous_year, CASE WHEN national_claims IS NULL THEN 'missing' ELSE 'available' END AS denominator_status, CAST(round(CAST(claims_percent_rank AS DECIMAL(38,12)), 6) AS DOUBLE) AS claims_percent_rank, CAST(round(CAST(claims_p999 AS DECIMAL(38,12)), 5) AS DOUBLE) AS claims_p999, CAST(round(CAST(median_cost AS DECIMAL(38,12)), 4) AS DOUBLE) AS median_cost,
      CAST(round(CAST(p99_cost AS DECIMAL(38,12)), 4) AS DOUBLE) AS p99_cost, CAST(round(CAST(claims / nullif(claims_p999, 0) AS DECIMAL(38,12)), 5) AS DOUBLE) AS ratio_to_p999, CAST(round(CAST(100 * claims / nullif(national_claims, 0) AS DECIMAL(38,12)), 5) AS DOUBLE) AS national_claim_share, CAST(round(CAST(100 * claims / nullif(visible_claims, 0) AS DECIMAL(38,12)), 5) AS DOUBLE) AS visible_claim_share,
      CAST(round(CAST(CASE WHEN previous_year = data_year - 1 THEN 100 * (claims - previous_claims) / nullif(previous_claims, 0) END AS DECIMAL(38,12)), 5) AS DOUBLE) AS change_percent FROM timed""",
    b.NATIONAL_DRUG,
)
def d14(spark, sf_dir):
    df = products.trajectory(b.provider_drug(spark, sf_dir), b.national_drug(spark, sf_dir), NPI, BRAND, GENERIC)
    return df.select("data_year", "npi", "claims", "claims_rank", "visible_rows", "previous_year", "denominator_status", *rounded(None, 6, "claims_percent_rank"), *rounded(df, 5, "claims_p999"), *rounded(df, 4, "median_cost", "p99_cost"), *rounded(df, 5, "ratio_to_p999", "national_claim_share", "visible_claim_share", "change_percent"))


@query(
    "d15_leaders",
    f"""WITH ranked AS (SELECT data_year, npi, claims, beneficiaries, rank() OVER (PARTITION BY data_year ORDER BY claims DESC) AS claims_rank, row_number() OVER (PARTITION BY data_year ORDER BY claims DESC, npi) AS place, percent_rank() OVER (PARTITION BY data_year ORDER BY claims) AS claims_percent_rank FROM provider_drug WHERE {PRODUCT})
    SELECT ranked.* EXCLUDE (claims_percent_rank), CAST(round(CAST(claims_percent_rank AS DECIMAL(38,12)), 6) AS DOUBLE) AS claims_percent_rank, national_claims, CAST(round(CAST(100 * claims / nullif(national_claims, 0) AS DECIMAL(38,12)), 5) AS DOUBLE) AS national_claim_share FROM ranked LEFT JOIN (SELECT data_year, national_claims FROM national_drug WHERE {PRODUCT}) USING (data_year) WHERE place <= 10""",
    b.NATIONAL_DRUG,
)
def d15(spark, sf_dir):
    df = products.leaders(b.provider_drug(spark, sf_dir), b.national_drug(spark, sf_dir), BRAND, GENERIC, 10)
    return df.select("data_year", "npi", "claims", "beneficiaries", "claims_rank", "place", *rounded(None, 6, "claims_percent_rank"), "national_claims", *rounded(None, 5, "national_claim_share"))


@query(
    "d16_churn",
    f"""WITH base AS (SELECT * FROM provider_drug WHERE {PRODUCT}), pairs AS (SELECT unnest(range(1995, 2001)) AS from_year), paired AS (SELECT from_year, npi, max(claims) FILTER (data_year = from_year) AS from_claims, max(claims) FILTER (data_year = from_year + 1) AS to_claims,
        max(cost) FILTER (data_year = from_year) AS from_cost, max(cost) FILTER (data_year = from_year + 1) AS to_cost FROM pairs JOIN base ON data_year IN (from_year, from_year + 1) GROUP BY ALL),
      bounds AS (SELECT *, CASE WHEN from_claims IS NOT NULL AND to_claims IS NOT NULL THEN to_claims - from_claims END AS change, CASE WHEN from_claims IS NULL THEN to_claims - 2 WHEN to_claims IS NULL THEN -from_claims ELSE to_claims - from_claims END AS change_low,
        CASE WHEN from_claims IS NULL THEN to_claims WHEN to_claims IS NULL THEN 2 - from_claims ELSE to_claims - from_claims END AS change_high, abs(coalesce(to_claims, 0) - coalesce(from_claims, 0)) AS ranking_magnitude,
        CASE WHEN from_claims IS NULL THEN 'became-visible-prior-0-to-2-or-absent' WHEN to_claims IS NULL THEN 'became-nonvisible-current-0-to-2-or-absent' ELSE 'both-visible-exact' END AS visibility_status FROM paired)
    SELECT CAST(from_year AS INTEGER) AS from_year, CAST(from_year + 1 AS INTEGER) AS to_year, npi, from_claims, to_claims, change, change_low, change_high, ranking_magnitude, visibility_status, CAST(round(CAST(100 * change / nullif(from_claims, 0) AS DECIMAL(38,12)), 5) AS DOUBLE) AS change_percent, CAST(round(CAST(to_cost - from_cost AS DECIMAL(38,12)), 2) AS DOUBLE) AS cost_change, change_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY from_year ORDER BY ranking_magnitude DESC, npi) AS change_rank FROM bounds) WHERE change_rank <= 25""",
    b.PROVIDER_DRUG,
)
def d16(spark, sf_dir):
    df = products.churn(b.provider_drug(spark, sf_dir), list(range(1995, 2002)), BRAND, GENERIC, 25, hidden=2)
    return df.select("from_year", "to_year", "npi", "from_claims", "to_claims", "change", "change_low", "change_high", "ranking_magnitude", "visibility_status", *rounded(None, 5, "change_percent"), *rounded(None, 2, "cost_change"), "change_rank")


@query(
    "d17_portfolio",
    f"""SELECT data_year, brand, generic, claims, rank() OVER (PARTITION BY data_year ORDER BY cost DESC) AS cost_rank, CASE WHEN data_year IN (1998, 1999, 2000) THEN 'all-reported-drugs' ELSE 'target-brand-only' END AS scope, CAST(round(CAST(cost / nullif(claims, 0) AS DECIMAL(38,12)), 4) AS DOUBLE) AS cost_per_claim,
      CAST(round(CAST(100 * claims / nullif(sum(claims) OVER (PARTITION BY data_year), 0) AS DECIMAL(38,12)), 5) AS DOUBLE) AS claim_share, CAST(round(CAST(100 * cost / nullif(CAST(sum(exact_cost) OVER (PARTITION BY data_year) AS DOUBLE), 0) AS DECIMAL(38,12)), 5) AS DOUBLE) AS cost_share FROM provider_drug WHERE npi = '{NPI}'""",
    b.PROVIDER_DRUG,
)
def d17(spark, sf_dir):
    df = products.portfolio(b.provider_drug(spark, sf_dir), NPI, [1998, 1999, 2000])
    return df.select("data_year", "brand", "generic", "claims", "cost_rank", "scope", *rounded(None, 4, "cost_per_claim"), *rounded(df, 5, "claim_share", "cost_share"))


@query("d18_national_denominators", f"SELECT CAST(y AS INTEGER) AS data_year, national_prescribers, national_claims, CAST(round(CAST(national_cost AS DECIMAL(38,12)), 2) AS DOUBLE) AS national_cost, CASE WHEN national_claims IS NULL OR national_claims <= 0 THEN 'missing' ELSE 'available' END AS denominator_status FROM range(1994, 2003) t(y) LEFT JOIN (SELECT * FROM national_drug WHERE {PRODUCT}) n ON n.data_year = y", b.NATIONAL_DRUG)
def d18(spark, sf_dir):
    national = b.national_drug(spark, sf_dir)
    return products.denominators(year_spine(national, 1994, 2002), national, BRAND, GENERIC).withColumn("national_cost", rounded(None, 2, "national_cost")[0])


SELECTED = f"""{b.NATIONAL_DRUG}, {b.DRUG_RELEASES}, named AS (SELECT *, CASE dataset WHEN 'F' THEN 'provider' ELSE 'geography' END AS role, scope = 'full' AS all_drugs FROM drug_releases WHERE status = 'loaded' AND data_year BETWEEN 1994 AND 2002 AND scope IN ('product', 'brand', 'full')),
  chosen AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY data_year, role ORDER BY observed_at DESC, release_id DESC) = 1), cohort AS (SELECT * FROM chosen WHERE role = 'provider'),
  folio AS (SELECT r.data_year, r.release_id, r.version, r.scope FROM drug_releases r LEFT JOIN cohort c ON c.data_year = r.data_year WHERE r.status = 'loaded' AND r.dataset = 'F' AND r.scope IN ('npi', 'full') AND r.data_year BETWEEN 1994 AND 2002
    QUALIFY row_number() OVER (PARTITION BY r.data_year ORDER BY coalesce(r.version = c.version, false) DESC, r.observed_at DESC, r.release_id DESC) = 1),
  selected AS (SELECT data_year, role, release_id, version, scope, all_drugs FROM chosen UNION ALL SELECT data_year, 'portfolio', release_id, version, scope, true FROM folio
    UNION ALL SELECT data_year, 'portfolio', release_id, version, scope, false FROM cohort WHERE data_year NOT IN (SELECT data_year FROM folio))"""


def selected(spark, sf_dir):
    return products.select_releases(b.drug_releases(spark, sf_dir), NPI, BRAND, GENERIC, list(range(1994, 2003)), "F", "O")


@query("d19_select_releases", "SELECT * FROM selected", SELECTED)
def d19(spark, sf_dir):
    return selected(spark, sf_dir)


@query(
    "d20_coverage_warnings",
    f"""WITH spine AS (SELECT CAST(y AS INTEGER) AS data_year FROM range(1994, 2003) t(y)), own AS (SELECT data_year FROM provider_drug WHERE npi = '{NPI}' AND {PRODUCT}), p AS (SELECT * FROM selected WHERE role = 'provider')
    SELECT 'missing-cohort-release' AS warning, data_year FROM spine WHERE data_year NOT IN (SELECT data_year FROM p) UNION ALL SELECT 'missing-national-denominator', data_year FROM spine WHERE data_year NOT IN (SELECT data_year FROM national_drug WHERE {PRODUCT} AND national_claims > 0)
    UNION ALL SELECT 'portfolio-limited-to-target-brand', data_year FROM selected WHERE role = 'portfolio' AND NOT all_drugs UNION ALL SELECT 'no-visible-candidate-row', data_year FROM p WHERE data_year NOT IN (SELECT data_year FROM own)
    UNION ALL SELECT 'no-adjacent-cohort-years', NULL WHERE NOT EXISTS (SELECT 1 FROM p JOIN p n ON n.data_year = p.data_year + 1)
    UNION ALL SELECT 'mixed-versions', p.data_year FROM p JOIN selected f ON f.data_year = p.data_year AND f.role = 'portfolio' AND f.all_drugs AND f.version <> p.version""",
    SELECTED,
)
def d20(spark, sf_dir):
    drug, national = b.provider_drug(spark, sf_dir), b.national_drug(spark, sf_dir)
    spine = year_spine(national, 1994, 2002)
    own = products.product_rows(drug, BRAND, GENERIC).filter(F.col("npi") == NPI)
    return products.coverage_warnings(selected(spark, sf_dir), spine, own, products.denominators(spine, national, BRAND, GENERIC))


IDENTIFIED = f"""{b.PAYMENTS}, identified AS (SELECT *, coalesce('npi:' || npi, 'profile:' || profile, 'hospital:' || hospital, 'record:' || record_id) AS recipient,
  CASE WHEN npi IS NOT NULL THEN 'npi' WHEN profile IS NOT NULL THEN 'profile' WHEN hospital IS NOT NULL THEN 'hospital' ELSE 'record_id' END AS raw_quality, third_party IS NOT NULL AND lower(third_party) <> 'no third party payment' AS third,
  lower(coalesce(related_product, '')) = 'yes' OR coalesce(len(product_names), 0) > 0 OR coalesce(len(product_ndcs), 0) > 0 AS product FROM payments),
  labelled AS (SELECT *, CASE raw_quality WHEN 'record_id' THEN 'record-only' WHEN 'profile' THEN 'profile-id' WHEN 'hospital' THEN 'teaching-hospital-id' ELSE raw_quality END AS quality FROM identified)"""
_values = lambda c: f"coalesce(string_agg(DISTINCT {c}, '|' ORDER BY {c}), '')"
MEASURES = f"""count(*) AS records, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(number_of_payments) AS BIGINT) AS payments, count(*) FILTER (number_of_payments IS NULL) AS records_missing_payments, CAST(min(paid_on) AS VARCHAR) AS first_paid, CAST(max(paid_on) AS VARCHAR) AS last_paid,
      count(*) FILTER (nature = '{NATURE}') AS focus_records, CAST(coalesce(sum(amount) FILTER (nature = '{NATURE}'), 0) AS DOUBLE) AS focus_amount, count(third_party) AS indicator_records, count(*) FILTER (third) AS third_party_records, CAST(coalesce(sum(amount) FILTER (third), 0) AS DOUBLE) AS third_party_amount,
      count(third_party_name) AS named_third_party_records, count(*) FILTER (product) AS product_records, {_values('nature')} AS natures, {_values('form')} AS forms, {_values('third_party')} AS third_party_values, {_values('third_party_name')} AS third_party_names, string_agg(DISTINCT source_release_id, '|' ORDER BY source_release_id) AS source_release_ids"""
_MONEY = ("amount", "focus_amount", "third_party_amount")
_tags = lambda keys, arrays: " UNION ALL ".join(f"SELECT {keys}, '{k}' AS kind, unnest({c}) AS v FROM labelled" for k, c in arrays.items())
_kinds = lambda keys, arrays: f"tags AS ({_tags(keys, arrays)}), kinds AS (SELECT {keys}, " + ", ".join(f"string_agg(DISTINCT v, '|' ORDER BY v) FILTER (kind = '{k}') AS {k}_values" for k in arrays) + f" FROM tags WHERE trim(v) <> '' GROUP BY {keys})"
_label_map = lambda c, value, out: f"(SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT coalesce({c}, '[missing]') AS k, CAST({value} AS VARCHAR) AS n FROM labelled i WHERE i.payer = l.payer AND i.program_year = l.program_year GROUP BY 1)) AS {out}"
_joined = lambda arrays: [F.array_join(f"{k}_values", "|").alias(f"{k}_values") for k in arrays]
_as_text = lambda *cols: [F.col(c).cast("string").alias(c) for c in cols]
_measured = [c for c in relations.MEASURE_NAMES if c not in (*_MONEY, "first_paid", "last_paid", "source_release_ids")]
_releases = lambda: F.array_join(F.transform("source_release_ids", lambda r: r.cast("string")), "|").alias("source_release_ids")
_COUNTED = ["recipients", *[f"{k}_recipients" for k in relations.QUALITIES], "distinct_npis", "distinct_profiles", "distinct_hospitals", "focus_npis", "distinct_third_party_names"]


@query(
    "d21_organization_summary",
    f"""WITH {_kinds('payer, program_year', relations.PRODUCT_ARRAYS)}, base AS (SELECT payer, program_year, {MEASURES}, CAST(coalesce(sum(amount) FILTER (form = 'cash'), 0) AS DOUBLE) AS cash_amount, CAST(coalesce(sum(amount) FILTER (form = 'stock'), 0) AS DOUBLE) AS stock_amount, {_values('recipient_type')} AS recipient_types, count(*) FILTER (quality = '{relations.QUALITIES["record"]}') AS records_missing_stable_recipient_identifier,
      {', '.join(f"CAST(coalesce(sum(amount) FILTER (quality = '{q}'), 0) AS DOUBLE) AS {k}_amount, count(DISTINCT recipient) FILTER (quality = '{q}') AS {k}_recipients" for k, q in relations.QUALITIES.items())}, count(DISTINCT recipient) AS recipients,
      count(DISTINCT npi) AS distinct_npis, count(DISTINCT profile) AS distinct_profiles, count(DISTINCT hospital) AS distinct_hospitals, count(DISTINCT npi) FILTER (nature = '{NATURE}') AS focus_npis, count(DISTINCT third_party_name) AS distinct_third_party_names FROM labelled GROUP BY payer, program_year)
    SELECT l.*, kinds.* EXCLUDE (payer, program_year), {_label_map('nature', 'count(*)', 'records_by_nature')}, {_label_map('nature', 'sum(amount)', 'amounts_by_nature')}, {_label_map('recipient_type', 'count(*)', 'records_by_recipient_type')} FROM base l LEFT JOIN kinds USING (payer, program_year)""",
    IDENTIFIED,
)
def d21(spark, sf_dir):
    df = relations.annual_summary(b.payments(spark, sf_dir), NATURE)
    money = [*_MONEY, "cash_amount", "stock_amount", *[f"{k}_amount" for k in relations.QUALITIES]]
    return df.select("payer", "program_year", *_measured, *_as_text("first_paid", "last_paid"), *_real(money), "recipient_types", "records_missing_stable_recipient_identifier", _releases(), *_COUNTED, *_joined(relations.PRODUCT_ARRAYS), "records_by_nature", "amounts_by_nature", "records_by_recipient_type")


@query(
    "d22_recipient_panel",
    f"""WITH {_kinds('payer, program_year, recipient, quality', {**relations.RECIPIENT_ARRAYS, **relations.PRODUCT_ARRAYS})}, base AS (SELECT program_year, recipient, quality, max(npi) AS npi, max(profile) AS profile, max(hospital) AS hospital, max(recipient_type) AS recipient_type, {MEASURES} FROM labelled WHERE payer = '3' GROUP BY program_year, recipient, quality)
    SELECT base.*, kinds.* EXCLUDE (payer, program_year, recipient, quality) FROM base LEFT JOIN (SELECT * FROM kinds WHERE payer = '3') kinds USING (program_year, recipient, quality)""",
    IDENTIFIED,
)
def d22(spark, sf_dir):
    df = relations.recipient_panel(b.payments(spark, sf_dir), "3", NATURE)
    return df.select("program_year", "recipient", "quality", "npi", "profile", "hospital", "recipient_type", *_measured, *_as_text("first_paid", "last_paid"), *_real(_MONEY), _releases(), *_joined({**relations.RECIPIENT_ARRAYS, **relations.PRODUCT_ARRAYS}))


def _roster(scope: str) -> str:
    return f"""WITH roster AS (SELECT payer, program_year, recipient, quality, count(*) AS records, sum(amount) AS amount, bool_or(third) AS third FROM labelled WHERE nature = '{NATURE}' {"AND npi IS NOT NULL" if scope == "npi-only" else ""} GROUP BY ALL),
      years AS (SELECT DISTINCT payer, program_year FROM roster), pairs AS (SELECT a.payer, a.program_year AS previous_year FROM years a JOIN years c ON a.payer = c.payer AND c.program_year = a.program_year + 1),
      merged AS (SELECT coalesce(p.payer, c.payer) AS payer, coalesce(p.previous_year, c.previous_year) AS previous_year, coalesce(p.recipient, c.recipient) AS recipient, coalesce(p.quality, c.quality) AS quality, p.recipient IS NOT NULL AS was, c.recipient IS NOT NULL AS now,
          p.records AS previous_records, c.records AS current_records, p.amount AS previous_amount, c.amount AS current_amount, p.third AS pt, c.third AS ct
        FROM (SELECT previous_year, r.* FROM pairs JOIN roster r ON r.payer = pairs.payer AND r.program_year = previous_year) p
        FULL JOIN (SELECT previous_year, r.* FROM pairs JOIN roster r ON r.payer = pairs.payer AND r.program_year = previous_year + 1) c ON p.payer = c.payer AND p.previous_year = c.previous_year AND p.recipient = c.recipient),
      sized AS (SELECT *, CASE WHEN was AND now THEN 'retained' WHEN now THEN 'added' ELSE 'exited' END AS status, count(*) FILTER (was) OVER w AS previous_size, count(*) FILTER (now) OVER w AS current_size, count(*) FILTER (was AND now) OVER w AS retained_count, count(*) OVER w AS all_count,
        count(*) FILTER (was AND now AND pt IS DISTINCT FROM ct) OVER w AS third_changes FROM merged WINDOW w AS (PARTITION BY payer, previous_year))
    SELECT payer, previous_year, recipient, quality, status, CASE status WHEN 'added' THEN 1 WHEN 'exited' THEN 2 ELSE 3 END AS status_order, previous_records, current_records, CAST(current_amount AS DOUBLE) AS current_amount, previous_size, current_size, retained_count, third_changes,
      CAST(round(CAST(100 * retained_count / nullif(previous_size, 0) AS DECIMAL(38,12)), 5) AS DOUBLE) AS retained_percent, CAST(round(CAST(100 * retained_count / nullif(all_count, 0) AS DECIMAL(38,12)), 5) AS DOUBLE) AS jaccard_percent FROM sized"""


def _transitions(spark, sf_dir, scope):
    df = relations.roster_transitions(b.payments(spark, sf_dir), NATURE, scope)
    return df.select("payer", "previous_year", "recipient", "quality", "status", "status_order", "previous_records", "current_records", F.col("current_amount").cast("double").alias("current_amount"), "previous_size", "current_size", "retained_count", "third_changes", *rounded(df, 5, "retained_percent", "jaccard_percent"))


@query("d23_roster_transitions", _roster("all"), IDENTIFIED)
def d23(spark, sf_dir):
    return _transitions(spark, sf_dir, "all")


@query("d23_roster_transitions_npi_only", _roster("npi-only"), IDENTIFIED)
def d23_npi(spark, sf_dir):
    return _transitions(spark, sf_dir, "npi-only")


@query(
    "d24_attribution_shares",
    """SELECT data_year, npi, brand, claims, CAST(round(CAST(claims / nullif(national_claims, 0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS claim_share, CAST(round(CAST(claims / nullif(lag(claims) OVER (PARTITION BY npi, brand ORDER BY data_year), 0) - 1 AS DECIMAL(38,12)), 6) AS DOUBLE) AS growth, CAST(round(CAST(claims / nullif(beneficiaries, 0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS claims_per_beneficiary,
      CAST(national_claims - sum(claims) OVER (PARTITION BY data_year, brand) AS BIGINT) AS visible_gap FROM provider_drug LEFT JOIN national_drug USING (data_year, brand, generic)""",
    b.NATIONAL_DRUG,
)
def d24(spark, sf_dir):
    df = context.attribution_shares(b.provider_drug(spark, sf_dir), b.national_drug(spark, sf_dir))
    return df.select("data_year", "npi", "brand", "claims", *rounded(df, 6, "claim_share", "growth", "claims_per_beneficiary"), "visible_gap")


CHANGES = f"""{b.PROVIDER_DRUG}, dated AS (SELECT *, max(data_year) OVER (PARTITION BY brand, generic) AS last FROM provider_drug), two AS (SELECT brand, generic, npi, max(claims) FILTER (data_year = last) AS now, max(claims) FILTER (data_year = last - 1) AS before FROM dated GROUP BY ALL),
  pairs AS (SELECT u.brand, u.npi AS rising, d.npi AS falling, u.now - u.before AS rise, d.now - d.before AS fall, 10 * abs(u.now - u.before + d.now - d.before) <= u.before + d.before AS offsets, (u.now - u.before + d.now - d.before) / (u.before + d.before) AS combined_ratio
    FROM two u JOIN two d ON u.brand = d.brand AND u.generic = d.generic AND u.now > u.before AND d.now < d.before)"""
_OFFSET = "CASE WHEN {} THEN 'offsetting-attribution-discontinuity-for-review' ELSE 'no-offsetting-reassignment-pattern-established' END AS classification"


def _series(spark, sf_dir):
    """What reassignment reads of the visible rows, cut, as it is read several times."""
    return cut(b.provider_drug(spark, sf_dir).select("data_year", "npi", "brand", "generic", "claims"))


@query(
    "d25_reassignment",
    f"""SELECT brand, npi, change, coalesce(opposite, 0) AS opposite, coalesce(offsetting, 0) AS offsetting, {_OFFSET.format('coalesce(offsetting, 0) > 0')} FROM (SELECT brand, npi, now - before AS change FROM two WHERE now <> before)
    LEFT JOIN (SELECT brand, rising AS npi, count(*) AS opposite, count(*) FILTER (offsets) AS offsetting FROM pairs GROUP BY ALL UNION ALL SELECT brand, falling, count(*), count(*) FILTER (offsets) FROM pairs GROUP BY ALL) USING (brand, npi)""",
    CHANGES,
)
def d25(spark, sf_dir):
    return context.reassignment(_series(spark, sf_dir)).select("brand", "npi", "change", "opposite", "offsetting", "classification")


@query(
    "d25_reassignment_pairs",
    f"SELECT brand, rising, falling, rise, fall, combined_ratio, {_OFFSET.format('offsets')} FROM pairs WHERE rising IN (SELECT rising FROM pairs p WHERE p.brand = pairs.brand QUALIFY row_number() OVER (ORDER BY rise DESC, rising) = 1)",
    CHANGES,
)
def d25_pairs(spark, sf_dir):
    # The stated actors: of every product the one that rose most.
    series = _series(spark, sf_dir)
    most = context.last_changes(series).filter("change > 0").groupBy("brand", "generic").agg(F.max(F.struct("change", F.expr("-cast(npi as bigint)").alias("by"), "npi")).alias("m")).select("brand", "generic", "m.npi")
    return context.reassignment_pairs(series, most).select("brand", "rising", "falling", "rise", "fall", "combined_ratio", "classification")


ROLES = ("prescriber", "dispenser", "administrator", "biller")


@query(
    "d26_role_completeness",
    """WITH a AS (SELECT brand || '/' || state AS product, CASE flag WHEN 'A' THEN 'prescriber' WHEN 'N' THEN 'dispenser' ELSE CASE WHEN CAST(npi AS BIGINT) % 2 = 0 THEN 'biller' ELSE 'administrator' END END AS role, npi AS actor, pos FROM lines WHERE data_year >= 1999),
      g AS (SELECT product, string_agg(DISTINCT role, '|' ORDER BY role) AS roles, count(DISTINCT actor) FILTER (role = 'dispenser') AS dispensers, bool_or(role = 'prescriber' AND pos = 'F') AS protocol, list(DISTINCT role) AS present FROM a GROUP BY product)
    SELECT product, roles, dispensers, coalesce((SELECT string_agg(r, '|' ORDER BY r) FROM unnest(['prescriber', 'dispenser', 'administrator', 'biller']) t(r) WHERE NOT list_contains(present, r)), '') AS missing_roles,
      CASE WHEN len(present) < 4 THEN 'incomplete-roles' WHEN protocol AND dispensers > 1 THEN 'protocol-attribution-plausible-not-proven' ELSE 'ordinary-clinical-attribution-unresolved' END AS classification FROM g""",
    b.LINES,
)
def d26(spark, sf_dir):
    rows = b.lines(spark, sf_dir).filter(F.col("data_year") >= 1999)
    role = F.when(F.col("flag") == "A", "prescriber").when(F.col("flag") == "N", "dispenser").when(F.col("npi").cast("long") % 2 == 0, "biller").otherwise("administrator")
    roles = rows.select(F.concat_ws("/", "brand", "state").alias("product"), role.alias("role"), F.col("npi").alias("actor"), F.when(F.col("pos") == "F", "standing-order-protocol").alias("basis"))
    df = context.role_completeness(roles, "product", ROLES)
    return df.select("product", F.array_join("roles", "|").alias("roles"), "dispensers", F.array_join("missing_roles", "|").alias("missing_roles"), "classification")


@query(
    "d27_status_timeline",
    """WITH snap AS (SELECT DISTINCT o_custkey AS id, CAST(year(o_orderdate) AS VARCHAR) AS as_of, CASE WHEN bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey, year(o_orderdate)) THEN 'revoked' ELSE 'enrolled' END AS status FROM orders)
    SELECT c_custkey AS id, CASE WHEN max(as_of) IS NULL THEN 'absent' ELSE 'present' END AS presence, count(as_of) AS assertions, string_agg(as_of || '=' || status, ';' ORDER BY as_of) AS timeline FROM customer LEFT JOIN snap ON id = c_custkey GROUP BY c_custkey""",
)
def d27(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("string").alias("as_of")).agg(F.when(F.bool_or(F.col("o_orderstatus") == "F"), "revoked").otherwise("enrolled").alias("status"))
    df = context.status_timeline(o, b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")
    return df.withColumn("assertions", F.col("assertions").cast("long"))
