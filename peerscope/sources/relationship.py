"""Relationship records from yearly files of differing headers: one fixed schema, and for each row the fields that don't fit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import BAD, convert, text_schema

#: Target column = kind = published name, and former names after it.
_FIELDS = """
record_id = text = Record_ID
change_type = text = Change_Type
program_year = year = Program_Year
covered_recipient_type = text = Covered_Recipient_Type
covered_recipient_profile_id = text = Covered_Recipient_Profile_ID Physician_Profile_ID
covered_recipient_npi = text = Covered_Recipient_NPI Physician_NPI
covered_recipient_first_name = text = Covered_Recipient_First_Name Physician_First_Name
covered_recipient_middle_name = text = Covered_Recipient_Middle_Name Physician_Middle_Name
covered_recipient_last_name = text = Covered_Recipient_Last_Name Physician_Last_Name
covered_recipient_name_suffix = text = Covered_Recipient_Name_Suffix Physician_Name_Suffix
recipient_address_line1 = text = Recipient_Primary_Business_Street_Address_Line1
recipient_address_line2 = text = Recipient_Primary_Business_Street_Address_Line2
recipient_city = text = Recipient_City
recipient_state = text = Recipient_State
recipient_zip_code = text = Recipient_Zip_Code
recipient_country = text = Recipient_Country
recipient_province = text = Recipient_Province
recipient_postal_code = text = Recipient_Postal_Code
teaching_hospital_ccn = text = Teaching_Hospital_CCN
teaching_hospital_id = text = Teaching_Hospital_ID
teaching_hospital_name = text = Teaching_Hospital_Name
submitting_entity_name = text = Submitting_Applicable_Manufacturer_or_Applicable_GPO_Name
paying_entity_id = text = Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_ID
paying_entity_name = text = Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_Name
paying_entity_state = text = Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_State
paying_entity_country = text = Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_Country
total_amount_usd = amount = Total_Amount_of_Payment_USDollars
payment_date = date = Date_of_Payment
number_of_payments = count = Number_of_Payments_Included_in_Total_Amount
form_of_payment = text = Form_of_Payment_or_Transfer_of_Value
nature_of_payment = text = Nature_of_Payment_or_Transfer_of_Value
travel_city = text = City_of_Travel
travel_state = text = State_of_Travel
travel_country = text = Country_of_Travel
physician_ownership_indicator = text = Physician_Ownership_Indicator
third_party_payment_recipient_indicator = text = Third_Party_Payment_Recipient_Indicator Indicate_Third_Party_Payment_Recipient
third_party_entity_name = text = Name_of_Third_Party_Entity_Receiving_Payment_or_Transfer_of_Value
charity_indicator = text = Charity_Indicator
third_party_equals_covered_recipient_indicator = text = Third_Party_Equals_Covered_Recipient_Indicator
contextual_information = text = Contextual_Information
delay_in_publication_indicator = text = Delay_in_Publication_Indicator
dispute_status = text = Dispute_Status_for_Publication
related_product_indicator = text = Related_Product_Indicator
payment_publication_date = date = Payment_Publication_Date
"""
FIELDS = {t: (names.split(), kind) for t, kind, names in (line.split(" = ") for line in _FIELDS.strip().splitlines())}
#: Fields that a record can't do without.
REQUIRED = ("record_id", "paying_entity_id", "paying_entity_name", "total_amount_usd", "payment_date")
#: Target array = how many numbered columns = their stems, and columns that stand in where none has a value.
LISTS = {
    "recipient_primary_types": (6, ("Covered_Recipient_Primary_Type", "Physician_Primary_Type"), ("Physician_Primary_Type",)),
    "recipient_specialties": (6, ("Covered_Recipient_Specialty", "Physician_Specialty"), ("Physician_Specialty",)),
    "recipient_license_states": (5, ("Covered_Recipient_License_State_code", "Physician_License_State_code"), ()),
}
#: Field of a product slot = stem of its numbered columns = array of its values.
PRODUCTS = {
    "coverage_indicator": ("Covered_or_Noncovered_Indicator", "product_coverage_indicators"), "product_type": ("Indicate_Drug_or_Biological_or_Device_or_Medical_Supply", "product_types"),
    "category_or_therapeutic_area": ("Product_Category_or_Therapeutic_Area", "product_categories"), "name": ("Name_of_Drug_or_Biological_or_Device_or_Medical_Supply", "product_names"),
    "ndc": ("Associated_Drug_or_Biological_NDC", "product_ndcs"), "pdi": ("Associated_Device_or_Medical_Supply_PDI", "product_pdis"),
}
SLOTS = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


class _Header:
    """A file's columns, in any case, and which of them have been used."""

    def __init__(self, columns: Sequence[str]):
        self.have, self.used = {c.lower(): c for c in columns}, {BAD.lower()}

    def raw(self, *names: str) -> Column:
        """The first of these columns with a value; null where the file has none of them."""
        known = [n.lower() for n in names if n.lower() in self.have]
        self.used |= set(known)
        cells = [F.nullif(F.trim(F.col(f"`{self.have[n]}`")), F.lit("")) for n in known]
        return F.coalesce(*cells) if cells else F.lit(None).cast("string")

    def at(self, stems: Sequence[str], i: int) -> Column:
        return self.raw(*[f"{s}{sep}{i}" for s in stems for sep in ("_", "")])

    def rest(self) -> Column:
        """All columns that weren't used, as a map of those with a value."""
        pairs = [x for k, c in self.have.items() if k not in self.used for x in (F.lit(k), F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")))]
        found = F.create_map(*pairs) if pairs else F.create_map()
        return F.map_filter(found.cast("map<string,string>"), lambda k, v: v.isNotNull())


def relationship_rows(df: DataFrame, release_id: int, program_year: int | None = None) -> DataFrame:
    """Relationship records from text columns, the same columns whatever the file has.

    Scalars are FIELDS, null where the file lacks them; numbered columns are arrays, product slots also structs; what is
    not named goes to the map `other`. `bad_fields` lists (field, raw, problem) of each value that isn't of its kind
    (malformed; the value is null then), isn't there though required, or is out of bounds: a negative amount, no payments, an
    identifier that isn't ten digits, another program year than the stated one. A row of another shape than its
    header has the field `row` with its text. `malformed` says whether there is any.
    """
    file = _Header(df.columns)
    raw = {t: file.raw(*names) for t, (names, _) in FIELDS.items()}
    lists = {}
    for name, (most, stems, stand_in) in LISTS.items():
        values = F.filter(F.array(*[file.at(stems, i) for i in range(1, most + 1)]), lambda v: v.isNotNull())
        one = file.raw(*stand_in) if stand_in else F.lit(None).cast("string")
        lists[name] = F.when((F.size(values) == 0) & one.isNotNull(), F.array(one)).otherwise(values)
    product = {f: [file.at((stem,), i) for i in range(1, SLOTS + 1)] for f, (stem, _) in PRODUCTS.items()}
    slots = [F.struct(F.lit(i + 1).alias("slot"), *[cells[i].alias(f) for f, cells in product.items()]) for i in range(SLOTS)]
    some = [F.when(F.coalesce(*[cells[i] for cells in product.values()]).isNotNull(), s) for i, s in enumerate(slots)]
    lists |= {array: F.filter(F.array(*product[f]), lambda v: v.isNotNull()) for f, (_, array) in PRODUCTS.items()}
    lists["product_slots"] = F.filter(F.array(*some), lambda s: s.isNotNull())
    torn = F.col(BAD) if BAD in df.columns else F.lit(None).cast("string")

    checked = [t for t, (_, kind) in FIELDS.items() if kind != "text"]
    parsed = {}
    for t in checked:
        value, bad = convert(F.col(t), FIELDS[t][1])
        parsed[t] = F.struct(F.when(~F.coalesce(bad, F.lit(False)), value).alias("value"), F.coalesce(bad, F.lit(False)).alias("bad"))
    made = df.select(*[r.alias(t) for t, r in raw.items()], *[c.alias(k) for k, c in lists.items()], file.rest().alias("other"), torn.alias("__torn")).withColumns({f"__{t}": c for t, c in parsed.items()})
    value = lambda t: F.col(f"__{t}.value") if t in parsed else F.col(t)
    bounds = {"total_amount_usd": value("total_amount_usd") >= 0, "number_of_payments": value("number_of_payments") > 0, "covered_recipient_npi": F.col("covered_recipient_npi").rlike("^[0-9]{10}$")}
    if program_year is not None:
        bounds["program_year"] = value("program_year") == program_year
    problems = [F.when(F.col("__torn").isNotNull(), _problem("row", F.col("__torn"), F.lit("malformed")))]
    for t in FIELDS:
        tests = [(F.col(f"__{t}.bad"), "malformed")] * (t in parsed) + [(value(t).isNull(), "missing")] * (t in REQUIRED) + [(~bounds[t], "out-of-bounds") for _ in (t,) if t in bounds]
        if tests:
            problem = reduce(lambda held, x: held.when(*x), tests[1:], F.when(*tests[0]))
            problems.append(let(problem, _named(t)))
    made = made.withColumn("bad_fields", F.array_compact(F.array(*problems)))
    out = made.select(F.lit(release_id).cast("long").alias("source_release_id"), *[value(t).alias(t) for t in FIELDS], *lists, "other", "bad_fields")
    return out.withColumn("malformed", F.size("bad_fields") > 0)


def _named(field: str) -> Callable[[Column], Column]:
    return lambda problem: F.when(problem.isNotNull(), _problem(field, F.col(field), problem))


def _problem(field: str, raw: Column, problem: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), raw.alias("raw"), problem.alias("problem"))


def read_relationship_payments(spark: SparkSession, paths: str | list[str], release_id: int, program_year: int | None = None) -> DataFrame:
    """Relationship CSVs by header names in any case, each path under its own header; see `relationship_rows`."""
    parts = []
    for path in [paths] if isinstance(paths, str) else paths:
        header = spark.read.options(header=True, inferSchema=False).csv(path).columns
        file = spark.read.schema(text_schema(header)).options(header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD).csv(path)
        parts.append(relationship_rows(file, release_id, program_year))
    return reduce(DataFrame.unionByName, parts)


def split_malformed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to be loaded, and (record_id, field, raw, problem) of those that aren't, a row for each bad field."""
    return rows.filter(~F.col("malformed")).drop("malformed", "bad_fields"), rows.filter("malformed").select("source_release_id", "record_id", F.inline("bad_fields"))
