"""Context of attributed activity: shares over time, reassignment, roles, status timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import ratio
from ..operators import strata
from ..operators.peers import attach


def attribution_shares(drug: DataFrame, national: DataFrame) -> DataFrame:
    """For every product and actor: yearly share of the national total, growth, and the gap between visible and national."""
    order = Window.partitionBy("npi", "brand", "generic").orderBy("data_year")
    visible = F.sum("claims").over(Window.partitionBy("data_year", "brand", "generic"))
    rows = attach(drug.withColumn("visible_claims", visible), national, ["data_year", "brand", "generic"], "left")
    return rows.withColumns({
        "claim_share": ratio("claims", "national_claims"), "growth": ratio(F.col("claims"), F.lag("claims").over(order)) - 1,
        "claims_per_beneficiary": ratio("claims", "beneficiaries"), "fills_per_beneficiary": ratio("fills", "beneficiaries"), "visible_gap": F.col("national_claims") - F.col("visible_claims"),
    })


PRODUCT = ["brand", "generic"]


def _verdict(offsets: Column) -> Column:
    return F.when(offsets, "offsetting-attribution-discontinuity-for-review").otherwise("no-offsetting-reassignment-pattern-established")


def last_changes(series: DataFrame) -> DataFrame:
    """(brand, generic, npi, now, before, change) of the actors that are there in both of their product's last two years."""
    last = attach(series, series.groupBy(*PRODUCT).agg(F.max("data_year").alias("last")), PRODUCT)
    now = F.max(F.when(F.col("data_year") == F.col("last"), F.col("claims")))
    before = F.max(F.when(F.col("data_year") == F.col("last") - 1, F.col("claims")))
    rows = last.filter(F.col("data_year") >= F.col("last") - 1).groupBy(*PRODUCT, "npi").agg(now.alias("now"), before.alias("before"))
    return rows.dropna(subset=["now", "before"]).withColumn("change", F.col("now") - F.col("before"))


def reassignment(series: DataFrame, parts: int = 10) -> DataFrame:
    """For every product and actor whose claims rose or fell: how many moved the other way, and how many of these offset it.

    A rise r and a fall -f offset each other if |r - f| is at most 1 / `parts` of both actors' claims before, b and c. In
    parts * r - b <= parts * f + c and parts * r + b >= parts * f - c that is an overlap of two intervals. An actor meets
    all of the other side but those whose interval ends before its own starts or starts after its own ends, so two running
    counts over interval ends per product are enough; no pair is made, and a product is split by ranges of the ends.
    """
    moved = last_changes(series).filter("change != 0").withColumn("up", F.col("change") > 0)
    size, reach = F.abs("change") * parts, F.col("before")
    moved = moved.withColumns({"lo": size - reach, "hi": size + reach})
    # Sorted events: of ends and starts at one place starts come first, as touching intervals overlap.
    ends = F.array(F.struct(F.col("lo").cast("double").alias("at"), F.lit(0).alias("end")), F.struct(F.col("hi").cast("double").alias("at"), F.lit(1).alias("end")))
    events = moved.select(*PRODUCT, "npi", "up", F.inline(ends))
    kinds = {f"{'up' if up else 'down'}_{end}": (F.col("up") == F.lit(up)) & (F.col("end") == end) for up in (True, False) for end in (0, 1)}
    places = events.groupBy(*PRODUCT, "at", "end").agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])
    places = strata.running(places, PRODUCT, ["at", "end"], list(kinds)).select(*PRODUCT, "at", "end", *[f"{n}_upto" for n in kinds])
    counted = events.join(places, [*PRODUCT, "at", "end"])
    # Ended before an actor's start, strictly, as ends at that place come after it; started up to its end.
    ended, started = (F.when(F.col("up"), F.col(f"down_{k}_upto")).otherwise(F.col(f"up_{k}_upto")) for k in (1, 0))
    per = counted.groupBy(*PRODUCT, "npi").agg(F.max(F.when(F.col("end") == 0, ended)).alias("ended"), F.max(F.when(F.col("end") == 1, started)).alias("started"))
    sides = moved.groupBy(*PRODUCT).agg(F.count_if("up").alias("risers"), F.count_if(~F.col("up")).alias("fallers"))
    rows = attach(attach(moved, per, [*PRODUCT, "npi"]), sides, PRODUCT)
    rows = rows.withColumns({"opposite": F.when(F.col("up"), F.col("fallers")).otherwise(F.col("risers")), "offsetting": F.col("started") - F.col("ended")})
    return rows.withColumn("classification", _verdict(F.col("offsetting") > 0)).select(*PRODUCT, "npi", "now", "before", "change", "opposite", "offsetting", "classification")


def reassignment_pairs(series: DataFrame, actors: DataFrame, parts: int = 10) -> DataFrame:
    """The stated rising actors (brand, generic, npi) with every falling actor of their product."""
    change = last_changes(series)
    up = change.filter("change > 0").join(actors.select(*PRODUCT, "npi").distinct(), [*PRODUCT, "npi"], "left_semi").select(*PRODUCT, F.col("npi").alias("rising"), F.col("before").alias("b"), F.col("change").alias("rise"))
    down = change.filter("change < 0").select(*PRODUCT, F.col("npi").alias("falling"), F.col("before").alias("c"), F.col("change").alias("fall"))
    pairs = up.join(down, PRODUCT)
    combined, base = F.col("rise") + F.col("fall"), F.col("b") + F.col("c")
    return pairs.withColumns({"combined_ratio": combined / base, "classification": _verdict(F.abs(combined) * parts <= base)}).drop("b", "c")


def role_completeness(assignments: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Per product: actors by role, roles that are missing, and whether a protocol attribution is plausible."""
    role = F.col("role")
    out = assignments.groupBy(key).agg(
        F.array_sort(F.collect_set("role")).alias("roles"), F.count_distinct(F.when(role == "dispenser", F.col("actor"))).alias("dispensers"),
        F.coalesce(F.bool_or((role == "prescriber") & (F.col("basis") == "standing-order-protocol")), F.lit(False)).alias("protocol"),
    )
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), F.col("roles")))
    plausible = F.col("protocol") & (F.col("dispensers") > 1)
    return out.withColumns({"missing_roles": missing, "classification": F.when(F.size(missing) > 0, "incomplete-roles").when(plausible, "protocol-attribution-plausible-not-proven").otherwise("ordinary-clinical-attribution-unresolved")})


def status_timeline(snapshots: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Per requested id the statuses by date; an id without any is absent, which clears nothing."""
    found = snapshots.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("as_of", "status"))).alias("s"))
    text = F.array_join(F.transform("s", lambda s: F.concat_ws("=", s["as_of"].cast("string"), s["status"])), ";")
    return requested.select(key).distinct().join(found, key, "left").select(key, F.when(F.col("s").isNull(), "absent").otherwise("present").alias("presence"), F.coalesce(F.size("s"), F.lit(0)).alias("assertions"), text.alias("timeline"))
