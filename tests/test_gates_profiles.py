"""Gates raise with what they saw; profiles and reconciliations report each kind of problem."""

import pytest
from pyspark.sql import functions as F

from peerscope.operators import denylist, gates, profiles, reshape
from peerscope.plans import claims


def register(spark):
    return spark.createDataFrame([(1, 2000, "a", "loaded", "v1"), (2, 2001, "a", "loaded", "v2"), (3, 2001, "a", "failed", "v2"), (4, 2002, "b", "loaded", "v1")], "release_id long, data_year int, dataset string, status string, version string")


def wanted(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "release_id long")


def test_coverage_gate(spark):
    spine = reshape.year_spine(register(spark), 2000, 2001)
    good = gates.audit_releases(wanted(spark, 1, 2, 2), register(spark), ["a"], 2000, 2001)
    gates.coverage_gate(gates.year_coverage(spine, good), good)
    for ids in ((1,), (1, 2, 3), (1, 2, 99), (1, 2, 4)):
        bad = gates.audit_releases(wanted(spark, *ids), register(spark), ["a"], 2000, 2001)
        with pytest.raises(gates.GateError, match="release coverage failed"):
            gates.coverage_gate(gates.year_coverage(spine, bad), bad)


def test_grain_and_domain_gates(spark):
    df = spark.createDataFrame([("1234567890", 1.0), ("1234567891", 2.0)], "npi string, v double")
    gates.grain_gate(df, ["npi"])
    gates.domain_gate(df, required=["v"], nonnegative=["v"], patterns={"npi": "^[0-9]{10}$"})
    with pytest.raises(gates.GateError, match="first duplicate=1234567890"):
        gates.grain_gate(df.union(df.limit(1)), ["npi"])
    for row in [("x", 1.0), ("1234567892", -1.0), ("1234567892", float("nan")), ("1234567892", float("inf")), ("1234567892", None)]:
        with pytest.raises(gates.GateError, match="value domain failed"):
            gates.domain_gate(df.union(spark.createDataFrame([row], df.schema)), required=["v"], nonnegative=["v"], patterns={"npi": "^[0-9]{10}$"})
    with pytest.raises(gates.GateError):
        gates.domain_gate(df.limit(0), required=["v"])


def test_filters(spark):
    df = spark.createDataFrame([({"code": ["B", "A"]},), ({"code": ["A"]},), ({"code": ["A", "B"], "state": ["FL"]},), ({},)], "f map<string,array<string>>")
    asked = F.create_map(F.lit("code"), F.array(F.lit("A"), F.lit("B")))
    rows = df.select(gates.filters_within(F.col("f"), asked).alias("w"), gates.filters_equal(F.col("f"), "code", ["B", "A"]).alias("e")).collect()
    assert [(r.w, r.e) for r in rows] == [(True, True), (False, False), (False, False), (True, False)]


def test_pins_scope_floor_and_cap(spark):
    assert [r.release_id for r in gates.pinned_versions(register(spark), {2000: "v1", 2001: "v1"}).orderBy("release_id").collect()] == [2, 3, 4]
    problems = gates.scope_difference(wanted(spark, 1, 2, 5), wanted(spark, 1, 2, 2, 7), "release_id").collect()
    assert {r.release_id: r.problem for r in problems} == {2: "repeated", 5: "missing", 7: "extra"}
    df = spark.createDataFrame([(80.0, 100.0), (95.0, 100.0)], "a double, b double")
    assert tuple(gates.coverage_floor(df, "a", "b", 0.8).first()) == (0.8, True) and not gates.coverage_floor(df, "a", "b", 0.9).first().valid
    gates.cap_gate(df, 2)
    for frame, cap in ((df, 1), (df.limit(0), 5)):
        with pytest.raises(gates.GateError):
            gates.cap_gate(frame, cap)


def test_profile_counts(spark):
    df = spark.createDataFrame([("1", 1.5), ("1", None), ("2", -1.0)], "k string, v double")
    got = {r.check: r.observed for r in profiles.profile(df, ["k"], {"negative": F.col("v") < 0, "unknown": F.col("v").isNull()}).collect()}
    assert got == {"rows": 3, "duplicate_keys": 1, "negative": 1, "unknown": 1}


def test_cursor_chain(spark):
    def run(pages, most=100):
        df = spark.createDataFrame(pages, "page long, cursor string, rows long, next_cursor string")
        return [r.problem for r in profiles.cursor_chain(df, most).orderBy("page").collect()]

    assert run([(1, "a", 2, "b"), (2, "b", 1, None)]) == ["ok", "ok"]
    assert run([(1, "a", 2, "b"), (2, "c", 1, None)]) == ["ok", "broken-chain"]
    assert run([(1, "a", 2, "a"), (2, "a", 1, None)]) == ["ok", "repeated-cursor"]
    assert run([(1, "a", 2, None), (2, "b", 1, None)])[0] == "pages-after-end"
    assert run([(1, "a", 2, "b"), (2, "b", 1, "c")]) == ["ok", "no-terminal-page"]
    assert run([(1, "a", 2, "b"), (2, "b", 9, None)], 10) == ["ok", "over-cap"]


def test_reconciliations(spark):
    facts, runs = wanted(spark, 1, 1, 2, 9), spark.createDataFrame([(1, 2), (2, 5), (3, 1)], "release_id long, loaded_rows long")
    assert {r.release_id: r.state for r in profiles.load_reconcile(facts, runs, "release_id").collect()} == {1: "match", 2: "mismatch", 3: "no-rows", 9: "no-run"}
    batches = spark.createDataFrame([("a",), ("a",), ("b",)], "batch string")
    assert all(r.reconciled for r in profiles.union_reconcile(batches, batches).collect()) and not profiles.union_reconcile(batches, batches.limit(2)).first().reconciled


def test_three_way_decisions(spark):
    snap = lambda **kv: spark.createDataFrame(list(kv.items()), "k string, d string")
    base = snap(same="1", ours="1", theirs="1", both="1", gone="1", dropped="1")
    current = snap(same="1", ours="2", theirs="1", both="2", gone="1", local="x", clash="x")
    upstream = snap(same="1", ours="1", theirs="2", both="3", new="x", clash="y", dropped="1")
    got = {r.k: r.decision for r in reshape.three_way(base, current, upstream, "k", "d").collect()}
    assert got == {
        "same": "no-change", "ours": "preserve-local-divergence", "theirs": "replace-unchanged-baseline", "both": "conflict-review-required", "gone": "upstream-removal-decision-required", "dropped": "preserve-local-divergence",
        "local": "preserve-local-only", "new": "add-upstream-baseline", "clash": "namespace-collision-review-required",
    }


def test_npi_like_values(spark):
    texts = spark.createDataFrame([(1, "id 1234567893 and 1234567890"), (2, "a" * 22 + "1234567893"), (3, None), (4, "12345678931")], "id long, text string")
    assert [(r.id, r.candidate) for r in profiles.npi_like(texts, "id", "text").collect()] == [(1, "1234567893")]


def test_frozen_identities_must_be_exact(spark):
    known = spark.createDataFrame([("a", "A"), ("b", "B")], "npi string, name string")
    assert claims.frozen_identities(known.limit(1), known, ["npi"], ["name"]).count() == 1
    for broken in (known.union(known), known.filter("npi = 'b'")):
        with pytest.raises(ValueError, match="identities are not exact"):
            claims.frozen_identities(known.filter("npi = 'a'"), broken, ["npi"], ["name"])


def observed(df):
    return {r.check: r.observed for r in df.collect()}


def test_supplier_profile_reads_cells(spark):
    rows = [
        ("1234567890", "I", "12", "10", "0.5", "70", False), ("1234567890", "O", "*", "1.5", "1.5", "121", False), ("123", "X", "", "", "#", "", False), ("1234567891", None, "-1", "1e3", "nan", None, False), (None, "I", "3", "inf", "5", "70", True),
    ]
    df = spark.createDataFrame(rows, "npi string, entity string, benes string, clms string, share string, age string, torn boolean")
    got = observed(profiles.supplier_profile(df, "npi", "entity", "benes", ["clms"], ["benes", "share", "age"], ["benes", "clms"], ["share"], "age", F.col("torn")))
    # Invalid: a fraction, an age of 121, a blank required cell, a negative count and a share that is no number.
    assert got == {"rows": 5, "duplicate_keys": 1, "malformed_rows": 1, "invalid_npi": 1, "invalid_entity": 2, "invalid_numbers": 5, "suppressed_numbers": 2, "unknown_beneficiaries": 2, "shares_above_one": 1}
    assert observed(profiles.supplier_profile(df.limit(0), "npi", "entity", "benes", ["clms"], ["benes"]))["rows"] == 0


def test_geography_rule(spark):
    rows = [("National", "", "National", False), ("National", None, "National", False), ("National", "US", "National", True), ("State", "FL", "Florida", False), ("State", "f1", "x", True), ("State", "FL", "", True), ("County", "FL", "x", True), (None, None, None, True)]
    df = spark.createDataFrame(rows, "l string, c string, d string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", profiles.geography_rule(F.col("l"), F.col("c"), F.col("d"))).collect())


def test_relationship_profile(spark):
    rows = [({"Record_ID": "1", "YEAR": "2020", "payer": "7"},), ({"record_id": "1", "year": "2019", "payer": "7"},), ({"record_id": " ", "year": "2020", "PAYER": "8"},), ({"record_id": "2", "Record_Id": "3", "year": "2020", "payer": "7"},), ({},)]
    got = observed(profiles.relationship_profile(spark.createDataFrame(rows, "f map<string,string>"), "f", "record_id", "year", "2020", {"payer": "7"}, []))
    assert got == {"rows": 5, "duplicate_keys": 1, "blank_ids": 2, "year_mismatch": 2, "filter_mismatch": 2, "missing_required": 1, "case_collisions": 1}


def test_status_profile(spark):
    rows = [("1", "I" * 15, "Y", "r", "2020-02-29"), ("1", "I" * 15, "N", "", "2021-02-29"), ("9", "I", "y", None, "02/03/2020"), ("2", None, None, "r", None)]
    df = spark.createDataFrame(rows, "npi string, e string, f string, r string, d string")
    got = observed(profiles.status_profile(df, df.filter("npi != '9'"), "npi", "e", "f", "r", ["d"]))
    assert got == {"rows": 4, "duplicate_keys": 1, "not_requested": 1, "invalid_enrollment": 2, "invalid_flag": 2, "missing_reason": 2, "invalid_dates": 3}


def test_service_and_provider_profiles(spark):
    df = spark.createDataFrame([("1234567890", "a", "F", 3, 1.0), ("1234567890", "a", "F", None, -1.0), ("x", "b", "Z", 2, None)], "npi string, code string, pos string, benes int, v double")
    got = observed(profiles.service_profile(df, ["npi", "code"], ["npi", "pos", "code", "benes", "v", "w"], {"npi": profiles.NPI}, {"pos": ["F"]}, ["v"], "benes", {"code": (F.col("code"), ["A"])}))
    assert got == {"rows": 3, "duplicate_keys": 1, "suppressed": 1, "invalid_npi": 1, "invalid_pos": 1, "invalid_numbers": 2, "filter_mismatch": 1, "columns_out_of_place": 3}
    assert observed(profiles.provider_profile(df, "npi", ["v", "benes"], {"pos": (F.col("pos"), ["f"])})) == {"rows": 3, "duplicate_keys": 1, "missing_required": 2, "invalid_npi": 1, "filter_mismatch": 1}


def test_stored_pages(spark):
    pages = spark.createDataFrame([(0, 1, 0, 5, "a"), (1, 1, 1, 5, "a"), (2, 1, 2, 5, "a"), (3, 1, 9, 5, "a"), (4, 1, 10, 5, "a")], "page int, declared_rows long, offset long, bytes long, sha256 string")
    rows = spark.range(5).select(F.col("id").cast("int").alias("page"))
    files = spark.createDataFrame([(0, 5, "a"), (1, 6, "a"), (2, 5, "b"), (3, 5, "a")], "page int, bytes long, sha256 string")
    found = profiles.page_reconcile(pages, rows, files)
    assert [r.problem for r in found.orderBy("page").collect()] == ["ok", "byte-count", "hash", "offset-gap", "no-file"]
    assert tuple(profiles.page_total(found).first()) == (5, 5, 5, 4, False) and profiles.page_total(found.filter("page = 0")).first().valid


def test_file_rollup_and_deny_rules(spark):
    states = spark.createDataFrame([("a", "match"), ("a", "missing"), ("b", "match"), ("c", "hash-mismatch")], "release string, state string")
    assert {r.release: r.state for r in profiles.status_rollup(states, "release").collect()} == {"a": "incomplete", "b": "complete", "c": "mismatched", None: "mismatched"}
    files = spark.createDataFrame([("x/Private/1", "hello"), ("y", "ＳＥＣＲＥＴ straße"), ("z", None)], "path string, text string")
    rules = [("r1", "exact-text", "hell"), ("r2", "casefold-text", "Secret STRASSE"), ("r3", "file-sha256", "2CF24DBA5FB0A30E26E83B2AC5B9E29E1B161E5C1FA7425E73043362938B9824"), ("r4", "path-fragment", "/private/")]
    assert sorted((r.path, r.rule_id) for r in denylist.deny_scan(files, "path", "text", rules).collect()) == [("x/Private/1", "r1"), ("x/Private/1", "r3"), ("x/Private/1", "r4"), ("y", "r2")]


def test_filter_gate(spark):
    asked = spark.createDataFrame([(2020, "A"), (2020, "B")], "data_year int, code string")
    rows = [(1, 2020, {"code": ["A"]}, True), (2, 2020, {"code": ["B"], "kind": ["K"]}, True), (3, 2020, {"state": ["FL"]}, False)]
    schema = "release_id long, data_year int, filters map<string,array<string>>, eligible boolean"
    gate = lambda r: gates.filter_gate(asked, spark.createDataFrame(r, schema), "code", "code", {"kind": ["K"]})
    gate(rows)
    with pytest.raises(gates.GateError, match="2020/B=0"):
        gate(rows[:1])
    with pytest.raises(gates.GateError, match="2020/A=2;2020/B=2"):
        gate([*rows, (4, 2020, {}, True)])
    with pytest.raises(gates.GateError, match="unexpected narrowed releases 5"):
        gate([*rows, (5, 2020, {"code": ["A"], "state": ["FL"]}, True)])


def test_label_disagreement(spark):
    detail, summary = spark.createDataFrame([("1", "I"), ("1", "I"), ("2", "O"), ("3", None)], "npi string, e string"), spark.createDataFrame([("1", "I"), ("2", "I"), ("3", "O")], "npi string, e string")
    assert sorted(r.npi for r in gates.label_disagreement(detail, summary, ["npi"], "e").collect()) == ["2", "3"]


def test_numbers_longer_than_an_id_are_looked_at_by_their_first_ten_digits(spark):
    import duckdb

    from peerscope.plans import quality, registry

    con, keys = duckdb.connect(), [*range(1, 300), *range(1_136_400, 1_137_000), *range(7_200_000, 7_200_300)]
    con.execute("CREATE TABLE part (p_partkey BIGINT)")
    con.executemany("INSERT INTO part VALUES (?)", [[k] for k in keys])
    want = con.execute(registry.oracle_sql()["v18_npi_like"]).fetchall()
    got = quality.npi_like_parts(spark.createDataFrame([(k,) for k in keys], "p_partkey long")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(len(c) == 11 for _, c, _ in want)


@pytest.mark.parametrize("name", ["v2_v4_profile_service", "k4_quality_results"])
def test_service_profiles_report_columns_out_of_place(spark, data, name):
    from peerscope.plans import registry

    found = {r["check"]: r["observed"] for r in registry.queries()[name](spark, data).collect()}
    assert len(found) == 9 and found["columns_out_of_place"] == 2
