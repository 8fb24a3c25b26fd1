"""Payments of an organisation: yearly summary, recipient panel, roster transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import identity_key, ratio
from ..operators.reshape import tagged_values, values_by_kind


#: How well a recipient is identified, by the identity that its key is made of.
QUALITIES = {"npi": "npi", "profile": "profile-id", "hospital": "teaching-hospital-id", "record": "record-only"}
#: Attributes of a recipient of which the panel shows the largest value, where the payments have them.
ATTRIBUTES = (
    "npi", "profile", "hospital", "hospital_ccn", "hospital_name", "first_name", "middle_name", "last_name", "name_suffix", "recipient_type", "address_line1", "address_line2", "city", "state", "zip_code", "country", "province", "postal_code", "payer_name",
)


def identified(payments: DataFrame) -> DataFrame:
    """Payments with the recipient's identity key, its quality, and whether a third party was reported."""
    key, quality = identity_key(npi=F.col("npi"), profile=F.col("profile"), hospital=F.col("hospital"), record=F.col("record_id"))
    third = F.col("third_party").isNotNull() & (F.lower("third_party") != "no third party payment")
    labels = F.create_map(*[F.lit(x) for pair in QUALITIES.items() for x in pair])
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    product = (F.lower(F.coalesce("related_product", F.lit(""))) == "yes") | some("product_names") | some("product_ndcs")
    return payments.withColumns({"recipient": key, "quality": F.element_at(labels, quality), "third": third, "product": product})


def sum_where(value: str, condition: Column) -> Column:
    """Sum over the rows of a category; a category without rows is structurally zero."""
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0).cast("decimal(18,2)"))


def sorted_json(df: DataFrame, keys: list[str], name: str, value: Column, out: str) -> DataFrame:
    """{name: value} of an inner grouping as key-sorted text, one row per key."""
    inner = df.groupBy(*keys, name).agg(value.alias("v"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col("v"))))
    return inner.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["k"], p["v"].cast("string"))), ";").alias(out))


PRODUCT_ARRAYS = {"type": "product_types", "category": "product_categories", "name": "product_names", "ndc": "product_ndcs"}
RECIPIENT_ARRAYS = {"primary_type": "primary_types", "specialty": "specialties", "license_state": "license_states"}


def cohort_measures(nature: str) -> dict[str, Column]:
    """Measures that the yearly summary and the recipient panel share; `nature` is the payment nature in focus.

    The releases that a group's records come from are few.
    """
    focus = F.lower("nature") == nature.lower()
    values = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return {
        "records": F.count("*"), "amount": F.sum("amount"), "payments": F.sum("number_of_payments"), "records_missing_payments": F.count_if(F.col("number_of_payments").isNull()),
        "first_paid": F.min("paid_on"), "last_paid": F.max("paid_on"), "focus_records": F.count_if(focus), "focus_amount": sum_where("amount", focus),
        "indicator_records": F.count("third_party"), "third_party_records": F.count_if("third"), "third_party_amount": sum_where("amount", F.col("third")), "named_third_party_records": F.count("third_party_name"), "product_records": F.count_if("product"),
        "natures": values("nature"), "forms": values("form"), "third_party_values": values("third_party"), "third_party_names": values("third_party_name"),
        "source_release_ids": F.array_sort(F.collect_set("source_release_id")),
    }


MEASURE_NAMES = (
    "records", "amount", "payments", "records_missing_payments", "first_paid", "last_paid", "focus_records", "focus_amount", "indicator_records", "third_party_records", "third_party_amount", "named_third_party_records", "product_records", "natures", "forms", "third_party_values", "third_party_names", "source_release_ids",
)


def annual_summary(payments: DataFrame, nature: str) -> DataFrame:
    """Per payer and year: records, amounts by category, distinct identities, spans, values, and records and amounts by label.

    Distinct identities are exploded to (kind, value) and grouped once to the distinct values, so that each kind is
    counted without expanding the payments once per distinct key.
    """
    rows, keys = identified(payments), ["payer", "program_year"]
    by_quality = {f"{k}_amount": sum_where("amount", F.col("quality") == q) for k, q in QUALITIES.items()}
    totals = rows.groupBy(*keys).agg(
        *[c.alias(n) for n, c in {**cohort_measures(nature), **by_quality}.items()], sum_where("amount", F.col("form") == "cash").alias("cash_amount"), sum_where("amount", F.col("form") == "stock").alias("stock_amount"),
        F.array_join(F.array_sort(F.collect_set("recipient_type")), "|").alias("recipient_types"), F.count_if(F.col("quality") == QUALITIES["record"]).alias("records_missing_stable_recipient_identifier"),
    )
    tag = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    focus = F.when(F.lower("nature") == nature.lower(), F.col("npi"))
    kinds = [*[tag(f"{k}_recipients", F.when(F.col("quality") == q, F.col("recipient"))) for k, q in QUALITIES.items()], tag("recipients", F.col("recipient")), *[tag(f"distinct_{k}s", F.col(k)) for k in ("npi", "profile", "hospital")], tag("focus_npis", focus), tag("distinct_third_party_names", F.col("third_party_name"))]
    names = [*[f"{k}_recipients" for k in QUALITIES], "recipients", "distinct_npis", "distinct_profiles", "distinct_hospitals", "focus_npis", "distinct_third_party_names"]
    ids = rows.select(*keys, F.inline(F.array(*kinds))).filter("value is not null").groupBy(*keys, "kind", "value").agg(F.lit(1).alias("one"))
    counted = ids.groupBy(*keys).agg(*[F.count_if(F.col("kind") == n).alias(n) for n in names])
    out = totals.join(counted, keys).join(values_by_kind(tagged_values(rows, keys, PRODUCT_ARRAYS), keys, list(PRODUCT_ARRAYS)), keys, "left")
    label = lambda c: F.coalesce(F.col(c), F.lit("[missing]"))
    labelled = rows.withColumns({"nature": label("nature"), "recipient_type": label("recipient_type")})
    for name, value, target in (("nature", F.count("*"), "records_by_nature"), ("nature", F.sum("amount"), "amounts_by_nature"), ("recipient_type", F.count("*"), "records_by_recipient_type")):
        out = out.join(sorted_json(labelled, keys, name, value, target), keys)
    return out


def recipient_panel(payments: DataFrame, payer: str, nature: str) -> DataFrame:
    """Recipient x year of one payer: representative attributes, amounts, dates, sorted values of recipient and products."""
    rows = identified(payments.filter(F.col("payer") == payer))
    keys = ["program_year", "recipient", "quality"]
    base = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ATTRIBUTES if c in rows.columns], *[c.alias(n) for n, c in cohort_measures(nature).items()])
    arrays = {**RECIPIENT_ARRAYS, **PRODUCT_ARRAYS}
    return base.join(values_by_kind(tagged_values(rows, keys, arrays), keys, list(arrays)), keys, "left")


def roster_transitions(payments: DataFrame, nature: str, scope: str = "all") -> DataFrame:
    """Recipients retained, added or exited between each payer's adjacent years, with roster sizes and overlap.

    The identifier scope applies before any count. A year's roster is once the earlier and once the later of a pair.
    """
    if scope not in ("all", "npi-only"):
        raise ValueError(f"unknown identifier scope {scope!r}")
    rows = identified(payments.filter(F.lower("nature") == nature.lower()))
    rows = rows.filter(F.col("npi").isNotNull()) if scope == "npi-only" else rows
    roster = rows.groupBy("payer", "program_year", "recipient", "quality").agg(F.count("*").alias("records"), F.sum("amount").alias("amount"), F.max("third").alias("third"))
    years = roster.select("payer", "program_year").distinct()
    pairs = years.join(years.select("payer", (F.col("program_year") - 1).alias("program_year")), ["payer", "program_year"]).select("payer", F.col("program_year").alias("previous_year"))
    previous = roster.withColumn("previous_year", F.col("program_year")).withColumn("period", F.lit("previous"))
    current = roster.withColumn("previous_year", F.col("program_year") - 1).withColumn("period", F.lit("current"))
    both = previous.unionByName(current).join(pairs, ["payer", "previous_year"], "left_semi")
    was, now = F.col("period") == "previous", F.col("period") == "current"
    at = lambda c, when: F.max(F.when(when, F.col(c)))
    paired = both.groupBy("payer", "previous_year", "recipient").agg(
        F.max("quality").alias("quality"), F.bool_or(was).alias("was"), F.bool_or(now).alias("now"), at("records", was).alias("previous_records"), at("records", now).alias("current_records"),
        at("amount", was).alias("previous_amount"), at("amount", now).alias("current_amount"), at("third", was).alias("previous_third"), at("third", now).alias("current_third"),
    )
    paired = paired.withColumn("status", F.when(F.col("was") & F.col("now"), "retained").when(F.col("now"), "added").otherwise("exited"))
    pair = Window.partitionBy("payer", "previous_year")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(pair)
    sized = paired.withColumns({
        "previous_size": n(F.col("was")), "current_size": n(F.col("now")), **{f"{s}_count": n(F.col("status") == s) for s in ("retained", "added", "exited")},
        "third_changes": n(F.col("was") & F.col("now") & ~F.col("previous_third").eqNullSafe(F.col("current_third"))),
    })
    return sized.withColumns({
        "retained_percent": 100 * ratio("retained_count", "previous_size"),
        "jaccard_percent": 100 * ratio(F.col("retained_count"), F.col("retained_count") + F.col("added_count") + F.col("exited_count")),
        "status_order": F.when(F.col("status") == "added", 1).when(F.col("status") == "exited", 2).otherwise(3),
    })
