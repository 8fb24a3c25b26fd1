"""Typed reading, suppression marks, malformed rows, and sinks."""

import json
import re

import pytest
from pyspark.sql import functions as F

from peerscope.sources import readers, relationship, sinks


def test_supplier_csv_with_bom_marks_and_bad_rows(spark, tmp_path):
    columns = readers._sources(readers.SUPPLIER)
    row = dict.fromkeys(columns, "1") | {"Suplr_NPI": "0000000001", "Suplr_Prvdr_Ent_Cd": " o ", "Tot_Suplr_Benes": "*", "DME_Suplr_Mdcr_Pymt_Amt": "#", "Suplr_Mdcr_Pymt_Amt": "12.5000000001"}
    lines = [",".join(columns), ",".join(row.values()), ",".join((row | {"Tot_Suplr_Clms": "1.5"}).values()), ",".join((row | {"Tot_Suplr_Srvcs": "-3"}).values()), "1,2,3"]
    (tmp_path / "s.csv").write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode())
    rows = readers.read_supplier_csv(spark, str(tmp_path / "s.csv"), 2024, 9).collect()
    assert [r.malformed for r in rows] == [False, True, True, True]
    good = rows[0]
    assert (good.entity_code, good.total_beneficiaries, good.dme_medicare_payment_amount, good.data_year, good.source_release_id) == ("O", None, None, 2024, 9)
    assert str(good.total_medicare_payment_amount) == "12.5000000001"


def test_json_pages(spark, tmp_path):
    for i in range(2):
        page = [{"Prscrbr_NPI": f"{i}{j}", "Tot_Clms": str(j), "Tot_Benes": "", "Prscrbr_Type_Src": "S", "Brnd_Name": "B"} for j in range(3)]
        (tmp_path / f"p{i}.json").write_text(json.dumps(page, indent=1))
    rows = readers.read_json_file(spark, str(tmp_path), readers.PROVIDER_DRUG, 2020, 1).collect()
    assert len(rows) == 6 and {r.total_beneficiaries for r in rows} == {None} and sorted(r.total_claims for r in rows) == [0, 0, 1, 1, 2, 2]


def relationship_file(spark, rows, names):
    return relationship.relationship_rows(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)), 3, 2020)


PAYER = ["Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_ID", "Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_Name"]


def test_relationship_rows(spark):
    names = ["RECORD_id", "Date_of_Payment", "Total_Amount_of_Payment_USDollars", "program_YEAR", *PAYER, "Covered_Recipient_Specialty_1", "Covered_Recipient_Specialty_2", "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1", "Associated_Drug_or_Biological_NDC_1", "Associated_Drug_or_Biological_NDC_2", "Note"]
    rows = [("r1", "01/31/2020", "1.50", "2020", "1", "P", "A", " ", "pill", "", "N1", "n"), ("r2", "13/45/2020", "abc", "2019", " ", "P", None, "B", "", "", "", None), (None, None, "-1", "x", "1", "P", "", "", "", "", "", "")]
    a, b, c = relationship_file(spark, rows, names).orderBy(F.col("record_id").asc_nulls_last()).collect()
    assert str(a.payment_date) == "2020-01-31" and str(a.total_amount_usd) == "1.5000000000" and not a.malformed and a.other == {"note": "n"} and a.travel_city is None
    assert a.recipient_specialties == ["A"] and b.recipient_specialties == ["B"] and a.product_ndcs == ["N1"]
    assert [(s.slot, s.name, s.ndc) for s in a.product_slots] == [(1, "pill", None), (2, None, "N1")] and b.product_slots == []
    assert b.malformed and b.payment_date is None and sorted(map(tuple, b.bad_fields)) == [("paying_entity_id", None, "missing"), ("payment_date", "13/45/2020", "malformed"), ("program_year", "2019", "out-of-bounds"), ("total_amount_usd", "abc", "malformed")]
    assert sorted((f.field, f.problem) for f in c.bad_fields) == [("payment_date", "missing"), ("program_year", "malformed"), ("record_id", "missing"), ("total_amount_usd", "malformed")]


def test_relationship_schema_is_the_same_for_all_years(spark):
    old = relationship_file(spark, [("1", "A", "x", "12345")], ["Record_ID", "Physician_Specialty", "Physician_License_State_code2", "physician_npi"])
    new = relationship_file(spark, [("1", "A")], ["Record_ID", "Covered_Recipient_Specialty_3"])
    assert old.schema == new.schema and set(relationship.FIELDS) < set(old.columns)
    r = old.first()
    assert (r.recipient_specialties, r.recipient_license_states, r.covered_recipient_npi) == (["A"], ["x"], "12345") and ("covered_recipient_npi", "12345", "out-of-bounds") in map(tuple, r.bad_fields)


def test_relationship_files_with_torn_rows(spark, tmp_path):
    header = ",".join(["Record_ID", "Date_of_Payment", "Total_Amount_of_Payment_USDollars", *PAYER])
    (tmp_path / "a.csv").write_text(f"{header}\n1,01/02/2020,5,7,P\n2,01/02/2020\n3,01/02/2020,6,7,P,extra,more\n")
    (tmp_path / "b.csv").write_text("\ufefftotal_amount_of_payment_usdollars,RECORD_ID,Other\n5,9,o\n")
    rows = relationship.read_relationship_payments(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], 1)
    good, bad = relationship.split_malformed(rows)
    assert [r.record_id for r in good.collect()] == ["1"]
    found = {(r.record_id, r.field, r.problem) for r in bad.collect()}
    assert {("2", "row", "malformed"), ("2", "total_amount_usd", "missing"), ("3", "row", "malformed"), ("9", "payment_date", "missing")} <= found
    assert {r.raw for r in bad.filter("field = 'row'").collect()} == {"2,01/02/2020", "3,01/02/2020,6,7,P,extra,more"}


def test_page_ceiling(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"a": "x" * 200}]))
    with pytest.raises(ValueError, match="ceiling of 100"):
        readers.read_pages(spark, str(tmp_path), ["a"], ceiling=100)
    assert readers.read_pages(spark, str(tmp_path), ["a"], ceiling=1000).count() == 1


def releases_of(spark, path, **how):
    return sorted((r.source_release_id, r.v) for r in sinks.read_releases(spark, path, **how).collect())


def test_replace_release_is_idempotent(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1, "a"), (2, "b")], "source_release_id long, v string")
    with pytest.raises(ValueError, match="no release"):
        sinks.read_releases(spark, path)
    assert sinks.replace_release(df.limit(0), path) == 0
    assert [sinks.replace_release(df, path) for _ in range(2)] == [1, 2] and releases_of(spark, path) == [(1, "a"), (2, "b")]
    assert sinks.replace_release(df.limit(0), path) == 2
    sinks.replace_release(spark.createDataFrame([(2, "c"), (2, "d")], df.schema), path)
    assert releases_of(spark, path) == [(1, "a"), (2, "c"), (2, "d")] and releases_of(spark, path, version=1) == [(1, "a"), (2, "b")]


def test_a_failed_load_changes_nothing_and_readers_see_one_version(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(i, "old") for i in range(4)], "source_release_id long, v string")
    sinks.replace_release(df, path)
    reader = sinks.read_releases(spark, path)  # opened before the loads, read after them
    broken = df.withColumn("v", F.when(F.col("source_release_id") < 3, "new").otherwise(F.raise_error(F.lit("half-way"))))
    with pytest.raises(Exception, match="half-way"):
        sinks.replace_release(broken.repartition(4, "source_release_id"), path)
    assert releases_of(spark, path) == [(i, "old") for i in range(4)]

    def gate(seen):
        if seen["rows"] > 3:
            raise ValueError(f"{seen['rows']} rows")

    new = df.withColumn("v", F.lit("new"))
    with pytest.raises(ValueError, match="4 rows"):
        sinks.replace_release(new, path, measures={"rows": F.count("*")}, check=gate)
    with pytest.raises(ValueError, match="1 rows have no"):
        sinks.replace_release(df.unionByName(spark.createDataFrame([(None, "x")], df.schema)), path)
    assert releases_of(spark, path) == [(i, "old") for i in range(4)]
    sinks.replace_release(new.filter("source_release_id > 0"), path, measures={"rows": F.count("*")}, check=gate)
    assert releases_of(spark, path) == [(0, "old"), (1, "new"), (2, "new"), (3, "new")]
    assert sorted((r.source_release_id, r.v) for r in reader.collect()) == [(i, "old") for i in range(4)]


def test_bounded_csv_evaluates_its_input_once(spark, tmp_path):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    df = spark.range(50).repartition(3).mapInArrow(counted, "id long")
    assert sinks.write_bounded_csv(df, str(tmp_path / "a"), ["id"], 100) == 50 and rows.value == 50
    got = spark.read.option("header", True).csv(str(tmp_path / "a")).collect()
    assert [int(r.id) for r in got] == list(range(50)) and [p.name for p in tmp_path.iterdir()] == ["a"]


def test_bounded_csv(spark, tmp_path):
    df = spark.range(5)
    with pytest.raises(ValueError, match="cap of 4"):
        sinks.write_bounded_csv(df, str(tmp_path / "a"), ["id"], 4)
    assert not (tmp_path / "a").exists() and sinks.write_bounded_csv(df, str(tmp_path / "b"), ["id"], 5) == 5
    with pytest.raises(ValueError, match="already exists"):
        sinks.write_bounded_csv(df, str(tmp_path / "b"), ["id"], 5)


def test_csv_parts_hold_all_rows_in_files_under_the_cap(spark, tmp_path):
    df = spark.range(1000).repartition(7)
    assert sinks.write_csv_parts(df, str(tmp_path / "a"), ["id"], 90) == 1000
    files = [[int(x) for x in p.read_text().split()[1:]] for p in sorted((tmp_path / "a").glob("*.csv"))]
    assert [x for f in files for x in f] == list(range(1000)) and max(map(len, files)) <= 90
    assert [p.name for p in tmp_path.iterdir()] == ["a"]
    with pytest.raises(ValueError, match="already exists"):
        sinks.write_csv_parts(df, str(tmp_path / "a"), ["id"], 90)


def test_fingerprint_ignores_order_not_content(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string"), spark.createDataFrame([(2, "y"), (1, "x")], "i int, s string")
    assert sinks.fingerprint(a).first() == sinks.fingerprint(b.repartition(3)).first() != sinks.fingerprint(a.filter("i = 1")).first()


def test_bounded_csv_bytes(spark, tmp_path):
    df = spark.createDataFrame([(i, "ä" * 10) for i in range(5)], "i int, s string")
    with pytest.raises(ValueError, match="cap of 100 bytes"):
        sinks.write_bounded_csv(df, str(tmp_path / "a"), ["i"], 5, 100)
    assert not (tmp_path / "a").exists() and sinks.write_bounded_csv(df, str(tmp_path / "b"), ["i"], 5, 200) == 5


def test_fingerprint_tells_nulls_and_bounds_apart(spark):
    rows = [("x", None), (None, "x"), ("x", ""), ("", "x"), ("n;", None), (None, None), ("x1:y", "z"), ("x", "1:yz")]
    one = lambda r: sinks.fingerprint(spark.createDataFrame([r], "a string, b string")).first().content_hash
    assert len({one(r) for r in rows}) == len(rows)


def test_target_names_are_the_stated_ones():
    assert len(readers.SUPPLIER) == 93 and {"beneficiary_adhd_other_conduct_disorder_percent", "tobacco_pct", "dme_total_hcpcs_codes", "supplier_address_line1", "supplier_ruca_description", "average_risk_score"} <= set(readers.SUPPLIER)
    assert {"supplier_ruca_category", "supplier_specialty_code", "rbcs_level"} <= set(readers.SUPPLIER_SERVICE)
    assert {"provider_credentials", "medicare_participation_indicator", "medical_medicare_standardized_amount", "drug_total_services", "beneficiary_race_native_indian_count"} <= set(readers.PART_B_PROVIDER)
    assert {"prescriber_last_org_name", "ge65_total_30day_fills", "ge65_beneficiary_suppression_flag"} <= set(readers.PROVIDER_DRUG)
    assert {"long_acting_opioid_drug_flag", "nonlis_beneficiary_cost_share", "antipsychotic_drug_flag"} <= set(readers.GEOGRAPHY_DRUG)
    files = (readers.SUPPLIER, readers.SUPPLIER_SERVICE, readers.PART_B_PROVIDER, readers.PART_B_SERVICE, readers.PROVIDER_DRUG, readers.GEOGRAPHY_DRUG)
    assert not [t for f in files for t in f if re.search("organization_name|supplier_provider|rendering_provider|_v[12]_", t)]


def test_rows_of_pages_are_computed_once(spark, tmp_path):
    from peerscope.plans import quality

    evaluated = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            evaluated.add(b.num_rows)
            yield b

    df = spark.range(100).mapInArrow(counted, "id long").select(F.lit(2000).alias("data_year"), F.lpad(F.col("id").cast("string"), 10, "0").alias("npi"), F.col("id").alias("n"))
    got = quality.pages_read_back(df, readers.PROVIDER_DRUG, {"prescriber_npi": F.col("npi"), "total_claims": F.col("n")}, str(tmp_path / "pages"))
    assert sorted(r.total_claims for r in got.collect()) == list(range(100)) and evaluated.value == 100
