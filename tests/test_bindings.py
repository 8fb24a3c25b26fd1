"""Bindings against their SQL on odd rows: nulls, ties, repeated suppliers; nothing is expanded before it is shuffled."""

import duckdb
import pytest

from peerscope.operators import strata
from peerscope.plans import analyses as a
from peerscope.plans import bindings as b
from peerscope.plans import registry

TABLES = "region nation supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def odd(spark, data, tmp_path_factory):
    """Few suppliers and days, so that identities repeat within and over cells; some dates, customers, flags and prices unknown; one supplier twice, in two nations."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    replaced = {
        "lineitem": "SELECT * REPLACE (l_suppkey % 3 + 1 AS l_suppkey, l_orderkey % 50 AS l_orderkey, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE date_trunc('quarter', l_shipdate) END AS l_shipdate, CASE WHEN l_linenumber = 3 AND l_partkey % 4 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus) FROM src",
        "orders": "SELECT o_orderkey % 50 AS o_orderkey, CASE WHEN min(o_custkey) % 7 = 0 THEN NULL ELSE min(o_custkey) % 11 END AS o_custkey FROM src GROUP BY 1",
        "part": "SELECT * REPLACE (CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS p_type) FROM src",
        "supplier": "SELECT * FROM src UNION ALL SELECT * REPLACE ((s_nationkey + 1) % 25 AS s_nationkey) FROM src WHERE s_suppkey = 2",
    }
    for t in TABLES:
        con.execute(f"COPY ({replaced.get(t, 'SELECT * FROM src').replace('src', repr(f'{data}/{t}.parquet'))}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def rows_of(df):
    return sorted((tuple(float(x) if type(x).__name__ in ("Decimal", "float") else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(float(r[i]) if type(r[i]).__name__ in ("Decimal", "float") else r[i] for i in order) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name, made, sql", [("cells", b.cells, b.CELLS), ("summary", b.summary, b.SUMMARY), ("drug_rows", b.drug_rows, b.DRUG_ROWS), ("lines", b.lines, b.LINES)])
def test_bindings_on_odd_rows(spark, odd, name, made, sql, monkeypatch):
    folder, con = odd
    want = rows_of_sql(con, f"WITH {sql} SELECT * FROM {name}")
    assert want and rows_of(made(spark, folder)) == want
    monkeypatch.setattr(b, "TASK_ROWS", 100)  # as for tables of many tasks
    assert rows_of(made(spark, folder)) == want


def test_cells_and_summary_share_one_evaluation(spark, odd):
    folder, con = odd
    cells, summary = b.cells_and_summary(spark, folder, exact=True)
    assert rows_of(cells) == rows_of_sql(con, f"WITH {b.EXACT_CELLS_AND_SUMMARY} SELECT * FROM cells")
    assert rows_of(summary) == rows_of_sql(con, f"WITH {b.EXACT_CELLS_AND_SUMMARY} SELECT * FROM summary")


@pytest.mark.parametrize("made, exchanges", [(b.cells, 6), (b.drug_rows, 6)])
def test_line_items_are_shuffled_once_a_join_and_once_by_supplier(spark, data, made, exchanges):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = made(spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Line items by order, part and supplier; orders, parts and suppliers; suppliers by nation, nations, and both again by region.
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") <= exchanges + 4


def test_needed_measures_and_years_are_those_of_all(spark, odd):
    """What is kept for a query agrees with the whole; what isn't kept is not there."""
    folder, con = odd
    cells, summary = b.cells_and_summary(spark, folder, needs=("beneficiaries", "bene_days", "services", "standardized"), year=1996)
    kept = "data_year, npi, entity, state, specialty, {}beneficiaries, {}services, standardized"
    assert rows_of(cells) == rows_of_sql(con, f"WITH {b.CELLS} SELECT {kept.format('code, pos, ', 'bene_days, ')} FROM cells WHERE data_year = 1996") != []
    assert rows_of(summary) == rows_of_sql(con, f"WITH {b.SUMMARY} SELECT {kept.format('', '')}, codes FROM summary WHERE data_year = 1996") != []


def cut_plans(monkeypatch, module):
    """Plans of what is cut in a module."""
    plans, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    return plans


@pytest.mark.parametrize("name", ["d1_provider_service_scan", "d2_shortlist", "r3_r4_r9_robust_scores"])
def test_the_scan_shuffles_no_money_that_it_does_not_read(spark, data, monkeypatch, name):
    plans = cut_plans(monkeypatch, b)
    registry.queries()[name](spark, data)
    assert len(plans) == 1 and "l_quantity" in plans[0]
    assert not [c for c in ("l_extendedprice", "l_discount", "l_tax", "l_returnflag") if c in plans[0]]


def test_discovery_reads_its_year_alone(spark, data, monkeypatch):
    plans = cut_plans(monkeypatch, b)
    a.candidate_parts(spark, data)
    assert f" = {a.YEAR})" in plans[0] and "l_returnflag" not in plans[0]


def test_ranks_are_cut_with_what_they_rank_alone(spark, data, monkeypatch):
    plans = cut_plans(monkeypatch, strata)
    registry.queries()["j11_r8_excluded_rank"](spark, data)
    assert plans and "l_quantity" in plans[0] and "l_extendedprice" not in plans[0] and "p_retailprice" not in plans[0]


@pytest.mark.parametrize("name", ["d25_reassignment", "d25_reassignment_pairs"])
def test_reassignment_joins_line_items_once(spark, data, name):
    assert "l_orderkey" not in registry.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_small_strata_are_dealt_out_by_rows(spark, data, odd, monkeypatch):
    """As for many rows: strata in tasks by rows, with the results that they have in one."""
    made = lambda: a.scan(spark, data).select("data_year", "npi", "code", "pos", "reach_percentile", "reach_broad_percentile", "peer_count")
    want = rows_of(made())
    monkeypatch.setattr(strata, "TASK_ROWS", 50)
    dealt = made()
    assert rows_of(dealt) == want != []
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
