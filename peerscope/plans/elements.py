"""Registered elements: measures, filters, joins, aggregates, peer statistics, windows, sorts and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import measures as m
from ..functions.robust import all_gates
from ..operators import peers, reshape, strata
from ..operators.gates import duplicates
from . import analyses as a
from . import bindings as b
from . import claims
from .registry import query
from .relations import identified, sorted_json, sum_where

KEY = ["data_year", "npi", "code", "pos"]
K = ", ".join(KEY)


def nine(*columns: str) -> list:
    return a.rounded(None, 9, *columns)


# --- measures -------------------------------------------------------------------------------------------------------
@query("p1_p2_p4_cell_measures", f"SELECT {K}, panel_band, {a._r(['panel_penetration', 'days_per_tested', 'units_per_day', 'std_per_panel', 'std_share'], 9)} FROM scan_rows", a.SCAN_ROWS)
def p1(spark, sf_dir):
    return claims.scan_rows(*b.cells_and_summary(spark, sf_dir, needs=a.SCAN_NEEDS), a.S).select(*KEY, "panel_band", *nine("panel_penetration", "days_per_tested", "units_per_day", "std_per_panel", "std_share"))


@query("p3_reconstructed_amounts", f"SELECT {K}, round(services * (payment / services), 4) AS paid, round(services * (standardized / services), 4) AS std FROM cells", b.CELLS)
def p3(spark, sf_dir):
    c = b.cells(spark, sf_dir)
    return c.select(*KEY, F.round(F.col("services") * m.ratio("payment", "services"), 4).alias("paid"), F.round(F.col("services") * m.ratio("standardized", "services"), 4).alias("std"))


@query("p5_p6_p7_supplier_measures", f"SELECT data_year, npi, band, category, {a._r(list(claims.SCREEN_METRICS.values()), 5)} FROM screen_rows", a.SCREEN)
def p5(spark, sf_dir):
    return claims.screen_rows(b.summary(spark, sf_dir), a.T).select("data_year", "npi", "band", "category", *a.rounded(None, 5, *claims.SCREEN_METRICS.values()))


@query(
    "p8_visible_dominance",
    """SELECT data_year, npi, CASE WHEN coalesce((coalesce(dme, 0) + coalesce(pos_paid, 0) + coalesce(drug, 0)) / nullif(payment, 0), 0) < 0.8 THEN 'unclassified-insufficient-component-coverage'
      WHEN greatest(coalesce(dme, 0), coalesce(pos_paid, 0), coalesce(drug, 0)) / nullif(coalesce(dme, 0) + coalesce(pos_paid, 0) + coalesce(drug, 0), 0) >= 0.45 THEN 'dominant-visible-component' ELSE 'mixed-visible-components' END AS dominance FROM summary""",
    b.SUMMARY,
)
def p8(spark, sf_dir):
    return b.summary(spark, sf_dir).select("data_year", "npi", m.visible_dominance({"dme": F.col("dme"), "pos": F.col("pos_paid"), "drug": F.col("drug")}, F.col("payment"), 0.8, 0.45).alias("dominance"))


@query("p9_unit_costs", "SELECT data_year, npi, brand, round(cost / nullif(claims, 0), 8) AS cost_per_claim, round(claims / nullif(beneficiaries, 0), 9) AS claims_per_beneficiary FROM provider_drug", b.PROVIDER_DRUG)
def p9(spark, sf_dir):
    return b.provider_drug(spark, sf_dir).select("data_year", "npi", "brand", F.round(m.ratio("cost", "claims"), 8).alias("cost_per_claim"), F.round(m.ratio("claims", "beneficiaries"), 9).alias("claims_per_beneficiary"))


@query("p10_f2_portfolio_scope", "SELECT data_year, brand, npi, CASE WHEN data_year IN (1998, 2000) THEN 'all-reported-drugs' ELSE 'target-brand-only' END AS scope FROM provider_drug WHERE data_year BETWEEN 1997 AND 2000", b.PROVIDER_DRUG)
def p10(spark, sf_dir):
    rows = b.provider_drug(spark, sf_dir).filter(F.col("data_year").between(1997, 2000))
    return rows.select("data_year", "brand", "npi", F.when(F.col("data_year").isin(1998, 2000), "all-reported-drugs").otherwise("target-brand-only").alias("scope"))


@query("p12_recipient_identity", "SELECT record_id, recipient, quality FROM labelled", a.IDENTIFIED)
def p12(spark, sf_dir):
    return identified(b.payments(spark, sf_dir)).select("record_id", "recipient", "quality")


@query("p13_benchmark_exposure", "WITH q AS (SELECT data_year, quantile_cont(payment / nullif(beneficiaries, 0), 0.75) AS q3 FROM summary GROUP BY data_year) SELECT data_year, npi, round(greatest(0, payment - beneficiaries * q3), 4) AS exposure FROM summary JOIN q USING (data_year)", b.SUMMARY)
def p13(spark, sf_dir):
    rows = b.summary(spark, sf_dir).withColumn("per", m.ratio("payment", "beneficiaries"))
    known = peers.attach(rows, peers.quartiles(rows, ["data_year"], {"per": "per"}), ["data_year"])
    return known.select("data_year", "npi", F.round(m.exposure(F.col("payment"), F.col("beneficiaries"), F.col("per_q3")), 4).alias("exposure"))


@query("p15_display_name", "SELECT c_custkey, trim(trim(coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, '')) || ' ' || trim(c_name)) AS name FROM customer")
def p15(spark, sf_dir):
    return b.read(spark, sf_dir, "customer").select("c_custkey", m.display_name(F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")), F.col("c_name")).alias("name"))


@query("p16_selection_reasons", f"SELECT {K}, concat_ws('|', CASE WHEN beneficiaries >= 10 THEN 'volume' END, CASE WHEN payment >= 500000 THEN 'payment' END, CASE WHEN claims > beneficiaries THEN 'repeat' END) AS reasons FROM cells", b.CELLS)
def p16(spark, sf_dir):
    return b.cells(spark, sf_dir).select(*KEY, m.reasons("|", volume=F.col("beneficiaries") >= 10, payment=F.col("payment") >= 500_000, repeat=F.col("claims") > F.col("beneficiaries")).alias("reasons"))


@query("p17_provenance_columns", "SELECT npi, count(*) AS cells, 'service-scan' AS screen_algorithm, '1' AS screen_algorithm_version, 'Small cells are not shown.' AS suppression_caveat FROM cells GROUP BY npi", b.CELLS)
def p17(spark, sf_dir):
    return b.cells(spark, sf_dir).groupBy("npi").agg(F.count("*").alias("cells")).withColumns(m.provenance("service-scan", "1", suppression="Small cells are not shown."))


# --- filters ---------------------------------------------------------------------------------------------------------
@query("f1_case_insensitive", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = lower('1-Urgent')")
def f1(spark, sf_dir):
    return b.read(spark, sf_dir, "orders").filter(F.lower("o_orderpriority") == "1-Urgent".lower()).select("o_orderkey")


@query("f3_minimum_volume", f"SELECT {K}, beneficiaries >= 5 AS tested FROM cells WHERE beneficiaries >= 2 AND services > 0", b.CELLS)
def f3(spark, sf_dir):
    return b.cells(spark, sf_dir).filter((F.col("beneficiaries") >= 2) & (F.col("services") > 0)).select(*KEY, (F.col("beneficiaries") >= 5).alias("tested"))


@query("f4_nonblank_stratum", "SELECT record_id, specialty FROM payments WHERE nullif(trim(specialty), '') IS NOT NULL", b.PAYMENTS)
def f4(spark, sf_dir):
    return b.payments(spark, sf_dir).filter(F.nullif(F.trim("specialty"), F.lit("")).isNotNull()).select("record_id", "specialty")


@query("f5_patterns", "SELECT s_suppkey, regexp_matches(s_name, '^Supplier#[0-9]{9}$') AS ok FROM supplier")
def f5(spark, sf_dir):
    return b.read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").rlike("^Supplier#[0-9]{9}$").alias("ok"))


@query("f6_null_safe", "SELECT record_id FROM payments WHERE third_party IS DISTINCT FROM 'Entity' AND npi IS NOT DISTINCT FROM NULL", b.PAYMENTS)
def f6(spark, sf_dir):
    return b.payments(spark, sf_dir).filter(~F.col("third_party").eqNullSafe("Entity") & F.col("npi").eqNullSafe(None)).select("record_id")


@query("f7_identifier_scope", "SELECT program_year, count(DISTINCT recipient) AS recipients FROM labelled WHERE npi IS NOT NULL GROUP BY program_year", a.IDENTIFIED)
def f7(spark, sf_dir):
    return identified(b.payments(spark, sf_dir)).filter(F.col("npi").isNotNull()).groupBy("program_year").agg(F.count_distinct("recipient").alias("recipients"))


@query("f8_closed_lists", "SELECT code, count(*) AS cells FROM cells WHERE upper(trim(code)) IN ('ECONOMY', 'PROMO') GROUP BY code", b.CELLS)
def f8(spark, sf_dir):
    wanted = spark.createDataFrame([(" economy",), ("PROMO",), ("promo",)], "c string").select(F.upper(F.trim("c")).alias("wanted")).distinct()
    rows = b.cells(spark, sf_dir)
    return rows.join(F.broadcast(wanted), F.upper(F.trim("code")) == F.col("wanted"), "left_semi").groupBy("code").agg(F.count("*").alias("cells"))


@query("f9_positive_product", "SELECT record_id FROM labelled WHERE product", a.IDENTIFIED)
def f9(spark, sf_dir):
    return identified(b.payments(spark, sf_dir)).filter("product").select("record_id")


# --- joins -----------------------------------------------------------------------------------------------------------
@query("j1_panel_detail", "SELECT c.data_year, c.npi, c.code, c.pos, s.beneficiaries AS panel FROM summary s JOIN cells c ON s.data_year = c.data_year AND s.npi = c.npi", b.CELLS_AND_SUMMARY)
def j1(spark, sf_dir):
    return b.cells(spark, sf_dir).select(*KEY).join(b.summary(spark, sf_dir).select("data_year", "npi", F.col("beneficiaries").alias("panel")), ["data_year", "npi"])


@query("j2_row_peer_stats", f"WITH q AS (SELECT data_year, code, pos, count(*) AS n, quantile_cont(payment, 0.5) AS mid FROM cells GROUP BY ALL) SELECT {K}, n, round(payment / nullif(mid, 0), 9) AS to_median FROM cells JOIN q USING (data_year, code, pos)", b.CELLS)
def j2(spark, sf_dir):
    rows, keys = b.cells(spark, sf_dir), ["data_year", "code", "pos"]
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("payment", 0.5).alias("mid"))
    return peers.attach(rows, stats, keys).select(*KEY, "n", F.round(m.ratio("payment", "mid"), 9).alias("to_median"))


@query("j3_optional_denominator", "SELECT data_year, npi, brand, claims, national_claims FROM provider_drug LEFT JOIN national_drug USING (data_year, brand, generic)", b.NATIONAL_DRUG)
def j3(spark, sf_dir):
    return peers.attach(b.provider_drug(spark, sf_dir), b.national_drug(spark, sf_dir), ["data_year", "brand", "generic"], "left").select("data_year", "npi", "brand", "claims", "national_claims")


@query("j4_all_and_scored", f"WITH big AS (SELECT {K}, payment FROM cells WHERE beneficiaries >= 8), small AS (SELECT {K}, claims FROM cells WHERE beneficiaries <= 9) SELECT {K}, payment IS NOT NULL AS in_big, claims FROM big FULL JOIN small USING ({K})", b.CELLS)
def j4(spark, sf_dir):
    rows = b.cells(spark, sf_dir)
    big, small = rows.filter("beneficiaries >= 8").select(*KEY, "payment"), rows.filter("beneficiaries <= 9").select(*KEY, "claims")
    return big.join(small, KEY, "full_outer").select(*KEY, F.col("payment").isNotNull().alias("in_big"), "claims")


@query("j5_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j5(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return b.read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == o.o_custkey, "left_anti").select("c_custkey")


@query("j6_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j6(spark, sf_dir):
    c = b.read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return b.read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == c.c_custkey, "left_semi").select("o_orderkey")


@query("j7_j8_year_code_grid", "WITH grid AS (SELECT CAST(y AS INTEGER) AS data_year, code FROM range(1994, 2002) t(y) CROSS JOIN (SELECT DISTINCT code FROM cells)) SELECT data_year, code, count(npi) AS cells FROM grid LEFT JOIN cells USING (data_year, code) GROUP BY ALL", b.CELLS)
def j7(spark, sf_dir):
    # The years of the grid are exploded from a literal sequence on the few codes.
    rows = b.cells(spark, sf_dir)
    grid = rows.select("code").distinct().select("code", F.explode(F.sequence(F.lit(1994), F.lit(2001))).alias("data_year"))
    return grid.join(rows.groupBy("data_year", "code").agg(F.count("npi").alias("n")), ["data_year", "code"], "left").select("data_year", "code", F.coalesce("n", F.lit(0)).alias("cells"))


@query("j9_adjacent_years", "SELECT x.npi, x.data_year, x.payment AS before, y.payment AS after FROM summary x JOIN summary y ON x.npi = y.npi AND y.data_year = x.data_year + 1", b.SUMMARY)
def j9(spark, sf_dir):
    s = b.summary(spark, sf_dir)
    later = s.select("npi", (F.col("data_year") - 1).alias("data_year"), F.col("payment").alias("after"))
    return s.select("npi", "data_year", F.col("payment").alias("before")).join(later, ["npi", "data_year"])


@query("j10_year_pairs", "SELECT from_year, npi, count(*) AS rows FROM (SELECT unnest(range(1995, 2001)) AS from_year) JOIN summary ON data_year IN (from_year, from_year + 1) GROUP BY ALL", b.SUMMARY)
def j10(spark, sf_dir):
    rows = b.summary(spark, sf_dir).select("npi", F.explode(F.array("data_year", F.col("data_year") - 1)).alias("from_year")).filter(F.col("from_year").between(1995, 2000))
    return rows.groupBy("from_year", "npi").agg(F.count("*").alias("rows")).withColumn("from_year", F.col("from_year").cast("long"))


_SCOPED = f"{a.REVIEW}, scoped AS (SELECT *, 'national' AS peer_scope, '' AS place FROM review UNION ALL SELECT *, 'supplier-address-state', upper(state) FROM review WHERE state <> '')"
_SCOPE_KEYS = ["data_year", "code", "pos", "entity", "peer_scope", "geography"]
_beside = "p.known AND NOT p.candidate AND " + " AND ".join(f"p.{k} = x.{k}" for k in ("data_year", "code", "pos", "entity", "peer_scope", "place"))


def scoped(spark, sf_dir):
    # Strata are cut before they are scored, so only what is scored may come with them.
    return peers.scopes(claims.review_cells(*a.review_parts(spark, sf_dir)).select(*KEY, "entity", "state", "known", "candidate", "services_per_beneficiary"), "state")


@query(
    "j11_r8_excluded_rank",
    f"SELECT {K}, peer_scope, place AS geography, {a._rank('services', 'services_per_beneficiary', _beside)}, round({a._share('services', 'services_per_beneficiary', _beside).rpartition(' AS ')[0]}, 9) AS services_peer_share FROM (SELECT x.*, (SELECT count(services_per_beneficiary) FROM scoped p WHERE {_beside}) AS peer_count FROM scoped x WHERE candidate) x".replace("FROM review p", "FROM scoped p"),
    _SCOPED,
)
def j11(spark, sf_dir):
    ranked = peers.excluded_rank(scoped(spark, sf_dir), _SCOPE_KEYS, {"services": "services_per_beneficiary"}, F.col("known") & ~F.col("candidate"), F.col("candidate"))
    return ranked.select(*KEY, "peer_scope", "geography", "services_high_rank", F.round("services_peer_share", 9).alias("services_peer_share"))


@query("j13_null_safe_keys", "WITH n AS (SELECT specialty, nature, count(*) AS n FROM payments GROUP BY ALL), s AS (SELECT specialty, nature, max(record_id) AS last FROM payments WHERE form = 'stock' GROUP BY ALL) SELECT n.specialty, n.nature, n, last FROM n LEFT JOIN s ON n.specialty IS NOT DISTINCT FROM s.specialty AND n.nature IS NOT DISTINCT FROM s.nature", b.PAYMENTS)
def j13(spark, sf_dir):
    rows = b.payments(spark, sf_dir)
    n = rows.groupBy("specialty", "nature").agg(F.count("*").alias("n"))
    s = rows.filter("form = 'stock'").groupBy(F.col("specialty").alias("s2"), F.col("nature").alias("n2")).agg(F.max("record_id").alias("last"))
    return n.join(s, F.col("specialty").eqNullSafe(F.col("s2")) & F.col("nature").eqNullSafe(F.col("n2")), "left").select("specialty", "nature", "n", "last")


@query("j14_membership_flag", f"SELECT {K}, candidate FROM review", a.REVIEW)
def j14(spark, sf_dir):
    return claims.review_cells(*a.review_parts(spark, sf_dir)).select(*KEY, "candidate")


# --- aggregates ------------------------------------------------------------------------------------------------------
@query("a1_a16_filtered_sums", "SELECT payer, count(*) FILTER (third) AS third, CAST(coalesce(sum(amount) FILTER (form = 'barter'), 0) AS DOUBLE) AS barter, CAST(sum(amount) FILTER (form = 'barter') AS DOUBLE) AS unknown_barter, CAST(max(amount) FILTER (form = 'cash') AS DOUBLE) AS top_cash FROM labelled GROUP BY payer", a.IDENTIFIED)
def a1(spark, sf_dir):
    rows = identified(b.payments(spark, sf_dir))
    barter = F.col("form") == "barter"
    return rows.groupBy("payer").agg(F.count_if("third").alias("third"), sum_where("amount", barter).cast("double").alias("barter"), F.sum(F.when(barter, F.col("amount"))).cast("double").alias("unknown_barter"), F.max(F.when(F.col("form") == "cash", F.col("amount"))).cast("double").alias("top_cash"))


@query("a2_distinct_counts", "SELECT payer, count(DISTINCT recipient) AS recipients, count(DISTINCT npi) AS npis, count(DISTINCT recipient) FILTER (form = 'cash') AS cash_recipients FROM labelled GROUP BY payer", a.IDENTIFIED)
def a2(spark, sf_dir):
    # One grouping to (payer, recipient) first; the distinct counts are then plain counts.
    once = identified(b.payments(spark, sf_dir)).groupBy("payer", "recipient").agg(F.max("npi").alias("npi"), F.bool_or(F.col("form") == "cash").alias("cash"))
    return once.groupBy("payer").agg(F.count("*").alias("recipients"), F.count("npi").alias("npis"), F.count_if("cash").alias("cash_recipients"))


@query("a3_quantiles", "SELECT data_year, brand, " + ", ".join(f"round(quantile_cont(claims, {p}), 9) AS q{i}" for i, p in enumerate((0.01, 0.25, 0.5, 0.75, 0.99, 0.999))) + " FROM provider_drug GROUP BY data_year, brand", b.PROVIDER_DRUG)
def a3(spark, sf_dir):
    ps = (0.01, 0.25, 0.5, 0.75, 0.99, 0.999)
    q = b.provider_drug(spark, sf_dir).groupBy("data_year", "brand").agg(F.percentile("claims", F.array(*[F.lit(p) for p in ps])).alias("q"))
    return q.select("data_year", "brand", *[F.round(F.get("q", F.lit(i)), 9).alias(f"q{i}") for i in range(len(ps))])


@query("a4_filtered_quantiles", "SELECT data_year, code, round(quantile_cont(services_per_beneficiary, 0.75) FILTER (known AND NOT candidate), 9) AS q75 FROM review GROUP BY data_year, code", a.REVIEW)
def a4(spark, sf_dir):
    rows = claims.review_cells(*a.review_parts(spark, sf_dir))
    return rows.groupBy("data_year", "code").agg(F.round(F.percentile(F.when(F.col("known") & ~F.col("candidate"), F.col("services_per_beneficiary")), 0.75), 9).alias("q75"))


_ONE = "data_year, code, pos"


@query("a5_r1_r2_peer_statistics", f"WITH {a.peer_sql('tested_rows', _ONE, {'reach': 'panel_penetration'}, 'w')} SELECT DISTINCT {_ONE}, peer_count, {a._r(['reach_q1', 'reach_median', 'reach_q3', 'reach_iqr', 'reach_mad'], 9)} FROM w", a.SCAN_ROWS)
def a5(spark, sf_dir):
    keys = ["data_year", "code", "pos"]
    rows = claims.scan_rows(*b.cells_and_summary(spark, sf_dir, needs=a.SCAN_NEEDS), a.S).filter(F.col("tested") >= a.S.minimum_tested)
    stats = peers.with_peer_stats(rows, keys, {"reach": "panel_penetration"})
    return stats.select(*keys, "peer_count", *nine("reach_q1", "reach_median", "reach_q3", "reach_iqr", "reach_mad")).distinct()


@query("a6_a7_concentration", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY data_year, code ORDER BY payment DESC, npi, pos) AS place FROM cells) SELECT data_year, code, round(sum(payment * payment) / (sum(payment) * sum(payment)), 9) AS hhi, round(max(payment) / sum(payment), 9) AS top1, round(sum(payment) FILTER (place <= 3) / sum(payment), 9) AS top3 FROM r GROUP BY data_year, code", b.CELLS)
def a6(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("data_year", "code").orderBy(F.col("payment").desc(), "npi", "pos"))
    total = F.sum("payment")
    rows = b.cells(spark, sf_dir).withColumn("place", place)
    return rows.groupBy("data_year", "code").agg(F.round(F.sum(F.col("payment") * F.col("payment")) / (total * total), 9).alias("hhi"), F.round(F.max("payment") / total, 9).alias("top1"), F.round(F.sum(F.when(F.col("place") <= 3, F.col("payment"))) / total, 9).alias("top3"))


_U = {"allowed": "allowed", "payment": "payment"}


@query("a8_u2_long_wide", "SELECT data_year, code, count(*) AS allowed_n, CAST(round(CAST(CAST(sum(CAST(allowed AS DECIMAL(28,4))) AS DOUBLE) / count(allowed) AS DECIMAL(38,12)), 3) AS DOUBLE) AS allowed_mean, count(*) AS payment_n, CAST(round(CAST(CAST(sum(CAST(payment AS DECIMAL(28,4))) AS DOUBLE) / count(payment) AS DECIMAL(38,12)), 3) AS DOUBLE) AS payment_mean FROM cells GROUP BY data_year, code", b.CELLS)
def a8(spark, sf_dir):
    long = reshape.unpivot(b.cells(spark, sf_dir), ["data_year", "code"], _U)
    return reshape.pivot(long, ["data_year", "code"], "metric", list(_U), {"n": F.count(F.lit(1)), "mean": F.round((F.sum(F.col("value").cast("decimal(28,4)")).cast("double") / F.count("value")).cast("decimal(38,12)"), 3).cast("double")})


@query("a9_boolean_aggregates", "SELECT payer, bool_and(third) AS all_third, bool_or(product) AS any_product, bool_and(product) FILTER (form = 'cash') AS cash_product FROM labelled GROUP BY payer", a.IDENTIFIED)
def a9(spark, sf_dir):
    return identified(b.payments(spark, sf_dir)).groupBy("payer").agg(F.every("third").alias("all_third"), F.bool_or("product").alias("any_product"), F.every(F.when(F.col("form") == "cash", F.col("product"))).alias("cash_product"))


@query("a10_u3_u4_values_by_kind", "WITH v AS (SELECT payer, 'type' AS kind, unnest(product_types) AS value FROM payments UNION ALL SELECT payer, 'name', unnest(product_names) FROM payments) SELECT payer, string_agg(DISTINCT value, '|' ORDER BY value) FILTER (kind = 'type') AS types, string_agg(DISTINCT value, '|' ORDER BY value) FILTER (kind = 'name') AS names FROM v GROUP BY payer", b.PAYMENTS)
def a10(spark, sf_dir):
    tagged = reshape.tagged_values(b.payments(spark, sf_dir), ["payer"], {"type": "product_types", "name": "product_names"})
    return reshape.values_by_kind(tagged, ["payer"], ["type", "name"]).select("payer", F.array_join("type_values", "|").alias("types"), F.array_join("name_values", "|").alias("names"))


@query("a11_ordered_text", "SELECT npi, data_year, string_agg(code || ':' || pos, ',' ORDER BY code, pos) AS cells FROM cells GROUP BY npi, data_year", b.CELLS)
def a11(spark, sf_dir):
    pairs = F.array_sort(F.collect_list(F.struct("code", "pos")))
    return b.cells(spark, sf_dir).groupBy("npi", "data_year").agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["code"], p["pos"])), ",").alias("cells"))


@query("a12_object_aggregate", "SELECT payer, string_agg(form || '=' || n, ';' ORDER BY form) AS by_form FROM (SELECT payer, form, count(*) AS n FROM payments GROUP BY ALL) GROUP BY payer", b.PAYMENTS)
def a12(spark, sf_dir):
    return sorted_json(b.payments(spark, sf_dir), ["payer"], "form", F.count("*"), "by_form")


@query("a13_a17_representatives", "SELECT payer, program_year, max(recipient_type) AS kind, CAST(min(paid_on) AS VARCHAR) AS first, CAST(max(paid_on) AS VARCHAR) AS last FROM payments GROUP BY payer, program_year", b.PAYMENTS)
def a13(spark, sf_dir):
    return b.payments(spark, sf_dir).groupBy("payer", "program_year").agg(F.max("recipient_type").alias("kind"), F.min("paid_on").cast("string").alias("first"), F.max("paid_on").cast("string").alias("last"))


@query("a14_largest_array", "SELECT payer, array_to_string(max(product_types), '|') AS largest FROM payments GROUP BY payer", b.PAYMENTS)
def a14(spark, sf_dir):
    return b.payments(spark, sf_dir).groupBy("payer").agg(F.array_join(F.max("product_types"), "|").alias("largest"))


@query("a15_having", "SELECT o_custkey, CAST(o_orderdate AS VARCHAR)[:10] AS day, count(*) AS n FROM orders GROUP BY o_custkey, CAST(o_orderdate AS VARCHAR)[:10] HAVING count(*) > 1")
def a15(spark, sf_dir):
    rows = b.read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return duplicates(rows, ["o_custkey", "day"]).withColumnRenamed("copies", "n")


@query("a18_visible_coverage", "WITH v AS (SELECT data_year, npi, sum(payment) AS visible FROM service_cells WHERE beneficiaries IS NOT NULL GROUP BY ALL) SELECT data_year, npi, round(visible, 5) AS visible, round(visible / nullif(payment, 0), 9) AS coverage, round(payment - visible, 5) AS unrepresented FROM summary JOIN v USING (data_year, npi)", b.CELLS_AND_SUMMARY)
def a18(spark, sf_dir):
    seen = b.service_cells(spark, sf_dir).filter("beneficiaries is not null").groupBy("data_year", "npi").agg(F.sum("payment").alias("visible"))
    rows = b.summary(spark, sf_dir).select("data_year", "npi", "payment").join(seen, ["data_year", "npi"])
    return rows.select("data_year", "npi", F.round("visible", 5).alias("visible"), F.round(m.ratio("visible", "payment"), 9).alias("coverage"), F.round(F.col("payment") - F.col("visible"), 5).alias("unrepresented"))


@query("a19_a20_levels_and_shares", "WITH c AS (SELECT npi, code, sum(services) AS s FROM cells GROUP BY ALL) SELECT npi, code, round(s / sum(s) OVER (PARTITION BY npi), 9) AS own_share, round(s / sum(s) OVER (PARTITION BY code), 9) AS code_share FROM c", b.CELLS)
def a19(spark, sf_dir):
    c = b.cells(spark, sf_dir).groupBy("npi", "code").agg(F.sum("services").alias("s"))
    share = lambda k: F.round(F.col("s") / F.sum("s").over(Window.partitionBy(k)), 9)
    return c.select("npi", "code", share("npi").alias("own_share"), share("code").alias("code_share"))


@query("a22_ratio_to_extreme", "WITH e AS (SELECT data_year, brand, quantile_cont(claims, 0.999) AS p FROM provider_drug GROUP BY ALL) SELECT data_year, npi, brand, round(claims / nullif(p, 0), 9) AS to_extreme FROM provider_drug JOIN e USING (data_year, brand)", b.PROVIDER_DRUG)
def a22(spark, sf_dir):
    rows, keys = b.provider_drug(spark, sf_dir), ["data_year", "brand"]
    return peers.attach(rows, rows.groupBy(*keys).agg(F.percentile("claims", 0.999).alias("p")), keys).select("data_year", "npi", "brand", F.round(m.ratio("claims", "p"), 9).alias("to_extreme"))


# --- peer statistics -------------------------------------------------------------------------------------------------
@query("r3_r4_r9_robust_scores", f"WITH {a.peer_sql('tested_rows', _ONE, {'units': 'units_per_day'}, 'w')} SELECT {K}, units_scale, {a._r(['units_z', 'units_ratio'], 6)}, CAST(round(CAST(abs(units_per_day - units_median) AS DECIMAL(38,12)), 9) AS DOUBLE) AS units_delta FROM w", a.SCAN_ROWS)
def r3(spark, sf_dir):
    metric = {"units": "units_per_day"}
    rows = claims.scan_rows(*b.cells_and_summary(spark, sf_dir, needs=a.SCAN_NEEDS), a.S).filter(F.col("tested") >= a.S.minimum_tested)
    out = peers.score(peers.with_peer_stats(rows, ["data_year", "code", "pos"], metric), metric)
    return out.select(*KEY, "units_scale", *a.rounded(None, 6, "units_z", "units_ratio"), *nine("units_delta"))


@query("r5_r6_w4_percentiles", f"SELECT {K}, CAST(round(CAST(cume_dist() OVER (PARTITION BY data_year, code, pos, entity ORDER BY CASE WHEN beneficiaries > 2 THEN payment END ASC NULLS LAST) AS DECIMAL(38,12)), 9) AS DOUBLE) AS own_percentile, CAST(round(CAST(cume_dist() OVER (PARTITION BY data_year, code ORDER BY CASE WHEN beneficiaries > 2 THEN payment END ASC NULLS LAST) AS DECIMAL(38,12)), 9) AS DOUBLE) AS broad_percentile FROM cells", b.CELLS)
def r5(spark, sf_dir):
    rows = b.cells(spark, sf_dir).withColumn("shown", F.when(F.col("beneficiaries") > 2, F.col("payment")))
    out = peers.percentiles(peers.percentiles(rows, ["data_year", "code", "pos", "entity"], {"own": "shown"}), ["data_year", "code"], {"broad": "shown"})
    return out.select(*KEY, *nine("own_percentile", "broad_percentile"))


@query("r7_excluded_statistics", "SELECT data_year, code, pos, entity, peer_scope, place AS geography, count(*) AS peer_count, CAST(round(CAST(quantile_cont(services_per_beneficiary, 0.5) AS DECIMAL(38,12)), 9) AS DOUBLE) AS services_median, CAST(round(CAST(quantile_cont(services_per_beneficiary, 0.75) AS DECIMAL(38,12)), 9) AS DOUBLE) AS services_q3 FROM scoped WHERE known AND NOT candidate GROUP BY ALL", _SCOPED)
def r7(spark, sf_dir):
    out = peers.excluded_stats(scoped(spark, sf_dir), _SCOPE_KEYS, {"services": "services_per_beneficiary"}, F.col("known") & ~F.col("candidate"))
    return out.select(*_SCOPE_KEYS, "peer_count", *nine("services_median", "services_q3"))


@query("r10_peer_status", f"WITH n AS (SELECT data_year, code, pos, count(*) AS n FROM cells WHERE beneficiaries >= 5 GROUP BY ALL) SELECT {K}, CASE WHEN beneficiaries < 5 THEN 'insufficient-volume-descriptive' WHEN n >= 60 THEN 'scoreable' ELSE 'insufficient-peer-descriptive' END AS status FROM cells LEFT JOIN n USING (data_year, code, pos)", b.CELLS)
def r10(spark, sf_dir):
    keys = ["data_year", "code", "pos"]
    rows = b.cells(spark, sf_dir)
    n = rows.filter("beneficiaries >= 5").groupBy(*keys).agg(F.count("*").alias("n"))
    return peers.attach(rows, n, keys, "left").select(*KEY, F.when(F.col("beneficiaries") < 5, "insufficient-volume-descriptive").when(F.col("n") >= 60, "scoreable").otherwise("insufficient-peer-descriptive").alias("status"))


@query(
    "r11_exact_product_median",
    "WITH o AS (SELECT data_year, brand, quantile_cont(claims, 0.5) AS mid, count(*) AS n FROM provider_drug WHERE CAST(npi AS BIGINT) % 5 <> 0 GROUP BY ALL) SELECT data_year, brand, npi, claims, n AS peers, round(claims / nullif(mid, 0), 9) AS to_median FROM provider_drug JOIN o USING (data_year, brand) WHERE CAST(npi AS BIGINT) % 5 = 0",
    b.PROVIDER_DRUG,
)
def r11(spark, sf_dir):
    rows, keys, own = b.provider_drug(spark, sf_dir), ["data_year", "brand"], F.col("npi").cast("long") % 5 == 0
    stats = rows.filter(~own).groupBy(*keys).agg(F.percentile("claims", 0.5).alias("mid"), F.count("*").alias("peers"))
    return peers.attach(rows.filter(own), stats, keys).select("data_year", "brand", "npi", "claims", "peers", F.round(m.ratio("claims", "mid"), 9).alias("to_median"))


@query("r12_multi_gate", "SELECT record_id, coalesce(amount >= 100000 AND number_of_payments >= 2 AND third_party = 'Entity', false) AS flag FROM payments", b.PAYMENTS)
def r12(spark, sf_dir):
    return b.payments(spark, sf_dir).select("record_id", all_gates(F.col("amount") >= 100_000, F.col("number_of_payments") >= 2, F.col("third_party") == "Entity").alias("flag"))


@query("r13_r14_r15_gates_and_routes", "SELECT npi, data_year, magnitude, tail_year, full_year, comparable_years, tail_years, full_years, latest_present, route FROM screen", a.SCREEN)
def r13(spark, sf_dir):
    return a.screen(spark, sf_dir).select("npi", "data_year", "magnitude", "tail_year", "full_year", "comparable_years", "tail_years", "full_years", "latest_present", "route")


# --- windows, sorts --------------------------------------------------------------------------------------------------
@query(
    "w1_w2_w3_w5_ranks",
    """SELECT data_year, brand, npi, claims, rank() OVER (PARTITION BY data_year, brand ORDER BY claims DESC) AS r, row_number() OVER (PARTITION BY data_year, brand ORDER BY claims DESC, npi) AS n, round(percent_rank() OVER (PARTITION BY data_year, brand ORDER BY claims), 9) AS p,
      CAST(sum(claims) OVER (PARTITION BY data_year, brand) AS BIGINT) AS total, count(*) OVER (PARTITION BY data_year, brand) AS rows FROM provider_drug""",
    b.PROVIDER_DRUG,
)
def w1(spark, sf_dir):
    w = Window.partitionBy("data_year", "brand")
    down = w.orderBy(F.col("claims").desc())
    return b.provider_drug(spark, sf_dir).select(
        "data_year", "brand", "npi", "claims", F.rank().over(down).alias("r"), F.row_number().over(w.orderBy(F.col("claims").desc(), "npi")).alias("n"), F.round(F.percent_rank().over(w.orderBy("claims")), 9).alias("p"),
        F.sum("claims").over(w).alias("total"), F.count("*").over(w).alias("rows"),
    )


@query("w6_w7_w10_filtered_windows", "SELECT npi, data_year, count(*) FILTER (beneficiaries >= 80) OVER w AS big_years, bool_or(data_year = 1999 AND payment > 1000000) OVER w AS focus, max(data_year) OVER w AS last FROM summary WINDOW w AS (PARTITION BY npi)", b.SUMMARY)
def w6(spark, sf_dir):
    w = Window.partitionBy("npi")
    return b.summary(spark, sf_dir).select("npi", "data_year", claims.count_where(F.col("beneficiaries") >= 80).over(w).alias("big_years"), F.bool_or((F.col("data_year") == 1999) & (F.col("payment") > 1_000_000)).over(w).alias("focus"), F.max("data_year").over(w).alias("last"))


@query("w8_running_sums", "SELECT npi, code, pos, data_year, coalesce(round(sum(services) OVER (PARTITION BY npi ORDER BY data_year, code, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4), 0) AS before, round(sum(services) OVER (PARTITION BY npi ORDER BY data_year, code, pos ROWS UNBOUNDED PRECEDING), 4) AS upto FROM cells", b.CELLS)
def w8(spark, sf_dir):
    rows = strata.running(b.cells(spark, sf_dir).select("npi", "code", "pos", "data_year", "services"), ["npi"], ["data_year", "code", "pos"], ["services"], F.struct("data_year", "code"))
    return rows.select("npi", "code", "pos", "data_year", F.round(F.col("services_upto") - F.col("services"), 4).alias("before"), F.round("services_upto", 4).alias("upto"))


@query("w9_guarded_lag", "SELECT npi, brand, data_year, CASE WHEN lag(data_year) OVER w = data_year - 1 THEN claims - lag(claims) OVER w END AS change FROM provider_drug WINDOW w AS (PARTITION BY npi, brand ORDER BY data_year)", b.PROVIDER_DRUG)
def w9(spark, sf_dir):
    w = Window.partitionBy("npi", "brand").orderBy("data_year")
    return b.provider_drug(spark, sf_dir).select("npi", "brand", "data_year", F.when(F.lag("data_year").over(w) == F.col("data_year") - 1, F.col("claims") - F.lag("claims").over(w)).alias("change"))


@query("t1_t2_top_k", "SELECT data_year, code, npi, pos, place FROM (SELECT *, row_number() OVER (PARTITION BY data_year, code ORDER BY payment DESC, npi, pos) AS place FROM cells) WHERE place <= 5", b.CELLS)
def t1(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("data_year", "code").orderBy(F.col("payment").desc(), "npi", "pos"))
    return b.cells(spark, sf_dir).withColumn("place", place).filter("place <= 5").select("data_year", "code", "npi", "pos", "place")


@query(
    "t3_t4_t5_priority_order",
    "SELECT payer, record_id, row_number() OVER (PARTITION BY payer ORDER BY third_party = 'Entity' DESC NULLS LAST, CASE form WHEN 'stock' THEN 1 WHEN 'cash' THEN 2 ELSE 3 END, npi DESC NULLS LAST, amount DESC, record_id) AS place FROM payments",
    b.PAYMENTS,
)
def t3(spark, sf_dir):
    order = Window.partitionBy("payer").orderBy((F.col("third_party") == "Entity").desc_nulls_last(), F.when(F.col("form") == "stock", 1).when(F.col("form") == "cash", 2).otherwise(3), F.col("npi").desc_nulls_last(), F.col("amount").desc(), "record_id")
    return b.payments(spark, sf_dir).select("payer", "record_id", F.row_number().over(order).alias("place"))


# --- sets and reshaping ----------------------------------------------------------------------------------------------
@query("u1_tagged_union", "SELECT payer, period, count(*) AS n FROM (SELECT payer, 'previous' AS period FROM payments WHERE program_year < 1998 UNION ALL SELECT payer, 'current' FROM payments WHERE program_year >= 1998) GROUP BY ALL", b.PAYMENTS)
def u1(spark, sf_dir):
    rows = b.payments(spark, sf_dir).select("payer", "program_year")
    tagged = rows.filter("program_year < 1998").withColumn("period", F.lit("previous")).unionByName(rows.filter("program_year >= 1998").withColumn("period", F.lit("current")))
    return tagged.groupBy("payer", "period").agg(F.count("*").alias("n"))


@query("u5_distinct_union", "SELECT code, brand FROM lines WHERE units >= 49 UNION SELECT code, brand FROM lines WHERE pos = 'O' AND data_year = 2001", b.LINES)
def u5(spark, sf_dir):
    rows = b.lines(spark, sf_dir)
    return rows.filter("units >= 49").select("code", "brand").union(rows.filter("pos = 'O' and data_year = 2001").select("code", "brand")).distinct()


@query("u6_zipped_arrays", "SELECT record_id, CAST(i AS INTEGER) AS i, product_types[i + 1] AS product_type, product_names[i + 1] AS product_name FROM (SELECT record_id, product_types, product_names, unnest(range(greatest(len(product_types), len(product_names)))) AS i FROM payments WHERE product_types IS NOT NULL)", b.PAYMENTS)
def u6(spark, sf_dir):
    rows = b.payments(spark, sf_dir).select("record_id", F.posexplode(F.arrays_zip("product_types", "product_names")).alias("i", "z"))
    return rows.select("record_id", "i", F.col("z.product_types").alias("product_type"), F.col("z.product_names").alias("product_name"))


@query("u7_year_spine", "SELECT CAST(y AS INTEGER) AS data_year, count(s.npi) AS suppliers FROM range(1990, 2004) t(y) LEFT JOIN summary s ON s.data_year = y GROUP BY y", b.SUMMARY)
def u7(spark, sf_dir):
    s = b.summary(spark, sf_dir)
    return reshape.year_spine(s, 1990, 2003).join(s, "data_year", "left").groupBy("data_year").agg(F.count("npi").alias("suppliers"))


@query("u8_set_difference", "WITH e AS (SELECT DISTINCT concat_ws('/', l_partkey, l_suppkey, year(l_shipdate)) AS k FROM lineitem WHERE l_returnflag = 'A'), o AS (SELECT DISTINCT concat_ws('/', l_partkey, l_suppkey, year(l_shipdate)) AS k FROM lineitem WHERE l_returnflag = 'R') SELECT k, 'missing' AS side FROM e WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'extra' FROM o WHERE k NOT IN (SELECT k FROM e)")
def u8(spark, sf_dir):
    # Suppliers' parts that came back with one flag in a year, against those of another.
    parts = b.read(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_partkey", "l_suppkey", F.year("l_shipdate")).alias("k"), "l_returnflag")
    return reshape.set_difference(parts.filter("l_returnflag = 'A'"), parts.filter("l_returnflag = 'R'"), "k")


SNAPSHOT = "SELECT o_custkey AS id, CAST(count(*) AS VARCHAR) || '/' || CAST(count(*) FILTER (o_orderstatus = 'F') AS VARCHAR) AS digest FROM orders WHERE year(o_orderdate) = {} GROUP BY o_custkey"


@query(
    "u9_three_way_diff",
    f"""WITH b AS ({SNAPSHOT.format(1996)}), c AS ({SNAPSHOT.format(1997)}), u AS ({SNAPSHOT.format(1998)}), ids AS (SELECT id FROM b UNION SELECT id FROM c UNION SELECT id FROM u)
    SELECT id, b.digest AS base, c.digest AS current, u.digest AS upstream, CASE WHEN b.digest IS NULL AND c.digest IS NULL THEN 'add-upstream-baseline' WHEN b.digest IS NULL AND u.digest IS NULL THEN 'preserve-local-only' WHEN b.digest IS NULL THEN 'namespace-collision-review-required'
      WHEN c.digest = b.digest AND u.digest IS NULL THEN 'upstream-removal-decision-required' WHEN c.digest = b.digest AND u.digest = b.digest THEN 'no-change' WHEN c.digest = b.digest THEN 'replace-unchanged-baseline'
      WHEN u.digest IS NULL OR u.digest = b.digest THEN 'preserve-local-divergence' ELSE 'conflict-review-required' END AS decision FROM ids LEFT JOIN b USING (id) LEFT JOIN c USING (id) LEFT JOIN u USING (id)""",
)
def u9(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders")
    digest = F.concat_ws("/", F.count("*").cast("string"), F.count_if(F.col("o_orderstatus") == "F").cast("string"))
    snap = lambda y: o.filter(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("id")).agg(digest.alias("digest"))
    return reshape.three_way(snap(1996), snap(1997), snap(1998), "id", "digest")


@query("c8_canonical_decimals", "SELECT p_partkey, CASE WHEN CAST(p_retailprice * 100 AS BIGINT) % 100 = 0 THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '0$', '') END AS price FROM part")
def c8(spark, sf_dir):
    return b.read(spark, sf_dir, "part").select("p_partkey", m.canonical_decimal(F.col("p_retailprice").cast("decimal(18,2)")).alias("price"))


@query("c9_marked_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2, 3) THEN NULL WHEN l_linenumber = 4 THEN NULL ELSE l_quantity END AS value, l_linenumber = 4 AS malformed FROM lineitem")
def c9(spark, sf_dir):
    n = F.col("l_linenumber")
    raw = F.when(n == 1, "*").when(n == 2, " # ").when(n == 3, "").when(n == 4, "-5").otherwise(F.col("l_quantity").cast("string"))
    value, bad = m.marked_number(raw)
    return b.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.cast("double").alias("value"), bad.alias("malformed"))
