"""Typed readers of the source files. Nothing is inferred: each has its schema, and rows that don't fit are kept aside."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import marked_number
from .columns import NAMED

BAD = "_malformed"
#: Fixed value: most bytes of a page.
PAGE_BYTES = 64 << 20


def text_schema(columns: Sequence[str]) -> T.StructType:
    """All text, so that suppression marks survive reading; typing comes after."""
    return T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField(BAD, T.StringType())])


def read_csv(spark: SparkSession, paths: str | list[str], columns: Sequence[str]) -> DataFrame:
    """A CSV with exactly this header; a BOM is taken off, rows of another shape go to the malformed column."""
    return spark.read.schema(text_schema(columns)).options(header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, encoding="UTF-8").csv(paths)


def read_pages(spark: SparkSession, paths: str | list[str], columns: Sequence[str], ceiling: int = PAGE_BYTES) -> DataFrame:
    """JSON pages, each an array of rows; names count in any case, and a page that isn't such an array is one malformed row.

    A page, some thousand rows, is parsed as a whole, as the publisher sends it; one beyond `ceiling` bytes raises before
    it is read. Columns that a row lacks are null.
    """
    large = spark.read.format("binaryFile").load(paths).select("path", "length").filter(F.col("length") > ceiling).first()
    if large is not None:
        raise ValueError(f"page {large['path']} of {large['length']} bytes exceeds the ceiling of {ceiling}")
    pages = spark.read.text(paths, wholetext=True).withColumn("rows", F.from_json("value", "array<map<string,string>>"))
    rows = pages.select(F.explode(F.coalesce("rows", F.array(F.lit(None).cast("map<string,string>")))).alias("r"), F.when(F.col("rows").isNull(), F.left("value", F.lit(200))).alias(BAD))
    rows = rows.withColumn("r", F.transform_keys("r", lambda k, v: F.lower(k)))
    return rows.select(*[F.try_element_at("r", F.lit(c.lower())).alias(c) for c in dict.fromkeys(columns)], BAD)


def typed(df: DataFrame, mapping: Mapping[str, tuple[str | Sequence[str], str]], **constants) -> DataFrame:
    """Columns by target name from (source or aliases, kind); kinds: text, upper, count, amount, year, date.

    Suppressed numbers are null; a number that is neither a value nor a suppression mark makes the row malformed.
    """
    have = {c.lower(): c for c in df.columns}
    raw = {}
    for name, (source, kind) in mapping.items():
        aliases = [source] if isinstance(source, str) else list(source)
        known = [F.col(f"`{c}`") for c in dict.fromkeys(have[a.lower()] for a in aliases if a.lower() in have)]
        if not known:
            raise ValueError(f"none of {aliases} is a column")
        raw[name] = (F.coalesce(*known), kind)
    # Numbers are parsed in one array, as code for a hundred columns one by one would be too long to be compiled.
    numbers = [n for n, (_, kind) in raw.items() if kind in ("count", "year", "amount")]

    def parsed(cell: Column) -> Column:
        value, bad = marked_number(cell["raw"])
        return F.struct(value.alias("value"), F.coalesce(bad | (cell["whole"] & (value != F.floor(value))), F.lit(False)).alias("bad"))

    cells = F.array(*[F.struct(raw[n][0].alias("raw"), F.lit(raw[n][1] != "amount").alias("whole")) for n in numbers])
    wrong = F.col(BAD).isNotNull() if BAD in df.columns else F.lit(False)
    if numbers:
        df = df.withColumn("_numbers", F.transform(cells, parsed))
        wrong = wrong | F.exists("_numbers", lambda c: c["bad"])
    out = []
    for name, (cell, kind) in raw.items():
        if name in numbers:
            value = F.get("_numbers", F.lit(numbers.index(name)))["value"]
            out.append((value if kind == "amount" else value.cast("int" if kind == "year" else "long")).alias(name))
        else:
            value, bad = convert(cell, kind)
            out.append(value.alias(name))
            wrong = wrong | F.coalesce(bad, F.lit(False)) if kind == "date" else wrong
    return df.select(*[F.lit(v).alias(k) for k, v in constants.items()], *out, wrong.alias("malformed"))


def convert(raw: Column, kind: str) -> tuple[Column, Column]:
    blank = F.nullif(F.trim(raw), F.lit(""))
    if kind == "text":
        return blank, F.lit(False)
    if kind == "upper":
        return F.upper(blank), F.lit(False)
    if kind == "date":
        return F.try_to_date(blank, "MM/dd/yyyy"), blank.isNotNull() & F.try_to_date(blank, "MM/dd/yyyy").isNull()
    value, bad = marked_number(raw)
    if kind in ("count", "year"):
        return value.cast("int" if kind == "year" else "long"), bad | (value != F.floor(value))
    return value, bad


#: Abbreviations in published column names.
ABBREVIATED = dict(x.split("=") for x in """
Suplr=supplier Prvdr=provider Rndrng=rendering Prscrbr=prescriber Prscrbrs=prescribers Org=organization MI=middle_initial Crdntls=credentials Ent=entity Cd=code Cds=codes St1=street_1 St2=street_2 Abrvtn=abbreviation
Desc=description Cntry=country Spclty=specialty Srce=source Src=source Prtcptg=participating Ind=indicator Tot=total Benes=beneficiaries Bene=beneficiary Clms=claims Srvcs=services Srvc=service Sbmtd=submitted
Chrgs=charge Chrg=charge Mdcr=medicare Alowd=allowed Amt=amount Pymt=payment Stdzd=standardized Sprsn=suppression Avg=average Cnt=count Pct=percent Scre=score Feml=female Wht=white Hspnc=hispanic Natind=native
NatInd=native Othr=other Ndual=nondual Rentl=rental Lvl=level Id=id Cat=category Brnd=brand Gnrc=generic Suply=supply Cst=cost Geo=geography Shr=share Antbtc=antibiotic Antpsyct=antipsychotic Med=medical""".split())
#: Kinds by the last word of a column's name; averages, ages and scores are amounts, what isn't listed is text.
KINDS = {"amount": "Amt Chrg Chrgs Srvcs Pct Scre Fills Cst Shr Age Stdzd_Amt", "count": "Cnt Cds Benes Clms Prscrbrs Suply", "upper": "Ind Abrvtn"}
_KIND = {w: k for k, words in KINDS.items() for w in words.split()}


def by_rule(column: str) -> tuple[str, str]:
    """Target name and kind of a published column: the stated name, or else one made of its words."""
    words = column.split("_")
    return NAMED.get(column.lower()) or "_".join(ABBREVIATED.get(w, w.lower()) for w in words), _KIND.get(words[-1], "text")


def whole(header: str, named: Mapping[str, tuple]) -> dict[str, tuple]:
    """Target -> (source column or aliases, kind) of every column of a header: named ones as stated, the others by rule."""
    target = {a.lower(): t for t, (s, _) in named.items() for a in ([s] if isinstance(s, str) else s)}
    out = {}
    for column in header.split():
        t = target.get(column.lower())
        name, kind = by_rule(column)
        out[t or name] = named[t] if t else (column, kind)
    if missing := set(named) - set(out):
        raise ValueError(f"not in the header: {sorted(missing)}")
    return out


#: The published headers, in their order.
_BENEFICIARIES = """Bene_Avg_Age Bene_Age_LT_65_Cnt Bene_Age_65_74_Cnt Bene_Age_75_84_Cnt Bene_Age_GT_84_Cnt Bene_Feml_Cnt Bene_Male_Cnt Bene_Race_Wht_Cnt Bene_Race_Black_Cnt Bene_Race_API_Cnt Bene_Race_Hspnc_Cnt Bene_Race_NatInd_Cnt Bene_Race_Othr_Cnt"""
_CONDITIONS = """Bene_CC_BH_ADHD_OthCD_V1_Pct Bene_CC_BH_Alcohol_Drug_V1_Pct Bene_CC_BH_Tobacco_V1_Pct Bene_CC_BH_Alz_NonAlzdem_V2_Pct Bene_CC_BH_Anxiety_V1_Pct Bene_CC_BH_Bipolar_V1_Pct Bene_CC_BH_Mood_V2_Pct Bene_CC_BH_Depress_V1_Pct Bene_CC_BH_PD_V1_Pct Bene_CC_BH_PTSD_V1_Pct
Bene_CC_BH_Schizo_OthPsy_V1_Pct Bene_CC_PH_Asthma_V2_Pct Bene_CC_PH_Afib_V2_Pct Bene_CC_PH_Cancer6_V2_Pct Bene_CC_PH_CKD_V2_Pct Bene_CC_PH_COPD_V2_Pct Bene_CC_PH_Diabetes_V2_Pct Bene_CC_PH_HF_NonIHD_V2_Pct Bene_CC_PH_Hyperlipidemia_V2_Pct Bene_CC_PH_Hypertension_V2_Pct
Bene_CC_PH_IschemicHeart_V2_Pct Bene_CC_PH_Osteoporosis_V2_Pct Bene_CC_PH_Parkinson_V2_Pct Bene_CC_PH_Arthritis_V2_Pct Bene_CC_PH_Stroke_TIA_V2_Pct Bene_Avg_Risk_Scre"""
_SUPPLIER_NAME = "Suplr_NPI Suplr_Prvdr_Last_Name_Org Suplr_Prvdr_First_Name Suplr_Prvdr_MI Suplr_Prvdr_Crdntls Suplr_Prvdr_Ent_Cd Suplr_Prvdr_St1 Suplr_Prvdr_St2 Suplr_Prvdr_City Suplr_Prvdr_State_Abrvtn Suplr_Prvdr_State_FIPS Suplr_Prvdr_Zip5"
_SUPPLIER_SUMS = "Tot_Suplr_HCPCS_Cds Tot_Suplr_Benes Tot_Suplr_Clms Tot_Suplr_Srvcs Suplr_Sbmtd_Chrgs Suplr_Mdcr_Alowd_Amt Suplr_Mdcr_Pymt_Amt Suplr_Mdcr_Stdzd_Pymt_Amt"
_PROVIDER_NAME = """Rndrng_NPI Rndrng_Prvdr_Last_Org_Name Rndrng_Prvdr_First_Name Rndrng_Prvdr_MI Rndrng_Prvdr_Crdntls Rndrng_Prvdr_Ent_Cd Rndrng_Prvdr_St1 Rndrng_Prvdr_St2 Rndrng_Prvdr_City Rndrng_Prvdr_State_Abrvtn Rndrng_Prvdr_State_FIPS Rndrng_Prvdr_Zip5
Rndrng_Prvdr_RUCA Rndrng_Prvdr_RUCA_Desc Rndrng_Prvdr_Cntry Rndrng_Prvdr_Type Rndrng_Prvdr_Mdcr_Prtcptg_Ind"""
_PROVIDER_SUMS = "Tot_HCPCS_Cds Tot_Benes Tot_Srvcs {}Sbmtd_Chrg {}Mdcr_Alowd_Amt {}Mdcr_Pymt_Amt {}Mdcr_Stdzd_Amt"


def _of_part(part: str, sums: str) -> str:
    return f"{part}_Sprsn_Ind " + " ".join(f"{part}_{c}" for c in sums.split())


_HEADERS = {
    "supplier": f"{_SUPPLIER_NAME} Suplr_Prvdr_RUCA Suplr_Prvdr_RUCA_Desc Suplr_Prvdr_Cntry Suplr_Prvdr_Spclty_Desc Suplr_Prvdr_Spclty_Srce {_SUPPLIER_SUMS} {' '.join(_of_part(p, _SUPPLIER_SUMS) for p in ('DME', 'POS', 'Drug'))} "
    f"{_BENEFICIARIES.replace('_API_', '_Api_').replace('_NatInd_', '_Natind_')} Bene_Ndual_Cnt Bene_Dual_Cnt {_CONDITIONS}",
    "supplier_service": f"{_SUPPLIER_NAME} Suplr_Prvdr_RUCA_Cat Suplr_Prvdr_RUCA Suplr_Prvdr_RUCA_Desc Suplr_Prvdr_Cntry Suplr_Prvdr_Spclty_Cd Suplr_Prvdr_Spclty_Desc Suplr_Prvdr_Spclty_Srce RBCS_Lvl RBCS_Id RBCS_Desc HCPCS_Cd HCPCS_Desc Suplr_Rentl_Ind Tot_Suplr_Benes Tot_Suplr_Clms Tot_Suplr_Srvcs "
    "Avg_Suplr_Sbmtd_Chrg Avg_Suplr_Mdcr_Alowd_Amt Avg_Suplr_Mdcr_Pymt_Amt Avg_Suplr_Mdcr_Stdzd_Amt",
    "part_b_provider": f"{_PROVIDER_NAME} {_PROVIDER_SUMS.replace('{}', 'Tot_')} {' '.join(_of_part(p, _PROVIDER_SUMS.replace('{}', '')) for p in ('Drug', 'Med'))} {_BENEFICIARIES} Bene_Dual_Cnt Bene_Ndual_Cnt {_CONDITIONS}",
    "part_b_service": f"{_PROVIDER_NAME} HCPCS_Cd HCPCS_Desc HCPCS_Drug_Ind Place_Of_Srvc Tot_Benes Tot_Srvcs Tot_Bene_Day_Srvcs Avg_Sbmtd_Chrg Avg_Mdcr_Alowd_Amt Avg_Mdcr_Pymt_Amt Avg_Mdcr_Stdzd_Amt",
    "provider_drug": "Prscrbr_NPI Prscrbr_Last_Org_Name Prscrbr_First_Name Prscrbr_City Prscrbr_State_Abrvtn Prscrbr_State_FIPS Prscrbr_Type Prscrbr_Type_Src Brnd_Name Gnrc_Name Tot_Clms Tot_30day_Fills Tot_Day_Suply Tot_Drug_Cst Tot_Benes GE65_Sprsn_Flag GE65_Tot_Clms GE65_Tot_30day_Fills "
    "GE65_Tot_Day_Suply GE65_Tot_Drug_Cst GE65_Bene_Sprsn_Flag GE65_Tot_Benes",
    "geography_drug": "Prscrbr_Geo_Lvl Prscrbr_Geo_Cd Prscrbr_Geo_Desc Brnd_Name Gnrc_Name Tot_Prscrbrs Tot_Clms Tot_30day_Fills Tot_Drug_Cst Tot_Benes GE65_Sprsn_Flag GE65_Tot_Clms GE65_Tot_30day_Fills GE65_Tot_Drug_Cst GE65_Bene_Sprsn_Flag GE65_Tot_Benes LIS_Bene_Cst_Shr NonLIS_Bene_Cst_Shr "
    "Opioid_Drug_Flag Opioid_LA_Drug_Flag Antbtc_Drug_Flag Antpsyct_Drug_Flag",
}
#: Columns of each file whose target names are stated: target -> (source column or aliases, kind).
SUPPLIER = whole(_HEADERS["supplier"], {
    "supplier_npi": ("Suplr_NPI", "text"), "supplier_last_org_name": ("Suplr_Prvdr_Last_Name_Org", "text"), "entity_code": ("Suplr_Prvdr_Ent_Cd", "upper"), "supplier_city": ("Suplr_Prvdr_City", "text"), "supplier_state": ("Suplr_Prvdr_State_Abrvtn", "upper"),
    "supplier_specialty_description": ("Suplr_Prvdr_Spclty_Desc", "text"), "supplier_specialty_source": ("Suplr_Prvdr_Spclty_Srce", "text"), "total_hcpcs_codes": ("Tot_Suplr_HCPCS_Cds", "count"), "total_beneficiaries": ("Tot_Suplr_Benes", "count"),
    "total_claims": ("Tot_Suplr_Clms", "count"), "total_services": ("Tot_Suplr_Srvcs", "amount"), "total_submitted_charge": ("Suplr_Sbmtd_Chrgs", "amount"), "total_medicare_allowed_amount": ("Suplr_Mdcr_Alowd_Amt", "amount"),
    "total_medicare_payment_amount": ("Suplr_Mdcr_Pymt_Amt", "amount"), "total_medicare_standardized_payment_amount": ("Suplr_Mdcr_Stdzd_Pymt_Amt", "amount"), "dme_medicare_payment_amount": ("DME_Suplr_Mdcr_Pymt_Amt", "amount"),
    "pos_medicare_payment_amount": ("POS_Suplr_Mdcr_Pymt_Amt", "amount"), "drug_medicare_payment_amount": ("Drug_Suplr_Mdcr_Pymt_Amt", "amount"),
})
SUPPLIER_SERVICE = whole(_HEADERS["supplier_service"], {
    "supplier_npi": ("Suplr_NPI", "text"), "entity_code": ("Suplr_Prvdr_Ent_Cd", "upper"), "supplier_state": ("Suplr_Prvdr_State_Abrvtn", "upper"), "hcpcs_code": ("HCPCS_Cd", "upper"), "hcpcs_description": ("HCPCS_Desc", "text"), "supplier_rental_indicator": ("Suplr_Rentl_Ind", "upper"),
    "total_beneficiaries": ("Tot_Suplr_Benes", "count"), "total_claims": ("Tot_Suplr_Clms", "count"), "total_services": ("Tot_Suplr_Srvcs", "amount"), "average_submitted_charge": ("Avg_Suplr_Sbmtd_Chrg", "amount"), "average_medicare_allowed_amount": ("Avg_Suplr_Mdcr_Alowd_Amt", "amount"),
    "average_medicare_payment_amount": ("Avg_Suplr_Mdcr_Pymt_Amt", "amount"), "average_medicare_standardized_amount": ("Avg_Suplr_Mdcr_Stdzd_Amt", "amount"),
})
PART_B_PROVIDER = whole(_HEADERS["part_b_provider"], {
    "rendering_npi": ("Rndrng_NPI", "text"), "provider_last_org_name": ("Rndrng_Prvdr_Last_Org_Name", "text"), "provider_first_name": ("Rndrng_Prvdr_First_Name", "text"), "entity_code": ("Rndrng_Prvdr_Ent_Cd", "upper"), "provider_state": ("Rndrng_Prvdr_State_Abrvtn", "upper"), "provider_type": ("Rndrng_Prvdr_Type", "text"),
    "total_hcpcs_codes": ("Tot_HCPCS_Cds", "count"), "total_beneficiaries": ("Tot_Benes", "count"), "total_services": ("Tot_Srvcs", "amount"), "total_submitted_charge": ("Tot_Sbmtd_Chrg", "amount"), "total_medicare_allowed_amount": ("Tot_Mdcr_Alowd_Amt", "amount"),
    "total_medicare_payment_amount": ("Tot_Mdcr_Pymt_Amt", "amount"), "total_medicare_standardized_amount": ("Tot_Mdcr_Stdzd_Amt", "amount"), "average_risk_score": ("Bene_Avg_Risk_Scre", "amount"),
})
PART_B_SERVICE = whole(_HEADERS["part_b_service"], {
    "rendering_npi": ("Rndrng_NPI", "text"), "entity_code": ("Rndrng_Prvdr_Ent_Cd", "upper"), "hcpcs_code": ("HCPCS_Cd", "upper"), "hcpcs_description": ("HCPCS_Desc", "text"), "hcpcs_drug_indicator": ("HCPCS_Drug_Ind", "upper"), "place_of_service": ("Place_Of_Srvc", "upper"), "total_beneficiaries": ("Tot_Benes", "count"),
    "total_services": ("Tot_Srvcs", "amount"), "total_beneficiary_day_services": ("Tot_Bene_Day_Srvcs", "amount"), "average_submitted_charge": ("Avg_Sbmtd_Chrg", "amount"), "average_medicare_allowed_amount": ("Avg_Mdcr_Alowd_Amt", "amount"), "average_medicare_payment_amount": ("Avg_Mdcr_Pymt_Amt", "amount"), "average_medicare_standardized_amount": ("Avg_Mdcr_Stdzd_Amt", "amount"),
})
PROVIDER_DRUG = whole(_HEADERS["provider_drug"], {
    "prescriber_npi": ("Prscrbr_NPI", "text"), "prescriber_state": ("Prscrbr_State_Abrvtn", "upper"), "prescriber_type": ("Prscrbr_Type", "text"), "prescriber_type_source": (("Prscrbr_Type_Src", "Prscrbr_Type_src"), "text"), "brand_name": ("Brnd_Name", "text"), "generic_name": ("Gnrc_Name", "text"),
    "total_claims": ("Tot_Clms", "count"), "total_30day_fills": ("Tot_30day_Fills", "amount"), "total_day_supply": ("Tot_Day_Suply", "count"), "total_drug_cost": ("Tot_Drug_Cst", "amount"), "total_beneficiaries": ("Tot_Benes", "count"), "ge65_suppression_flag": ("GE65_Sprsn_Flag", "text"), "ge65_total_claims": ("GE65_Tot_Clms", "count"),
})
GEOGRAPHY_DRUG = whole(_HEADERS["geography_drug"], {
    "prescriber_geography_level": ("Prscrbr_Geo_Lvl", "text"), "prescriber_geography_code": ("Prscrbr_Geo_Cd", "text"), "prescriber_geography_description": ("Prscrbr_Geo_Desc", "text"), "brand_name": ("Brnd_Name", "text"), "generic_name": ("Gnrc_Name", "text"), "total_prescribers": ("Tot_Prscrbrs", "count"),
    "total_claims": ("Tot_Clms", "count"), "total_drug_cost": ("Tot_Drug_Cst", "amount"), "total_beneficiaries": ("Tot_Benes", "count"),
})


def _sources(mapping: Mapping[str, tuple]) -> list[str]:
    found = [a for s, _ in mapping.values() for a in ([s] if isinstance(s, str) else s)]
    return list({a.lower(): a for a in reversed(found)}.values())[::-1]


def read_supplier_csv(spark: SparkSession, paths, year: int, release_id: int) -> DataFrame:
    return typed(read_csv(spark, paths, _sources(SUPPLIER)), SUPPLIER, source_release_id=release_id, data_year=year)


def read_json_file(spark: SparkSession, paths, mapping: Mapping[str, tuple], year: int, release_id: int) -> DataFrame:
    """Pages of a file with the given mapping (SUPPLIER_SERVICE, PART_B_PROVIDER, PART_B_SERVICE, PROVIDER_DRUG, GEOGRAPHY_DRUG)."""
    return typed(read_pages(spark, paths, _sources(mapping)), mapping, source_release_id=release_id, data_year=year)


def read_release_register(register: DataFrame, datasets: DataFrame) -> DataFrame:
    """Loaded releases with their dataset's slug."""
    return register.filter("status = 'loaded'").join(datasets, "dataset")
