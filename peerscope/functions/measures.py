"""Derived measures and labels as column expressions. Every ratio is null where its denominator is null or zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column | str, bottom: Column | str) -> Column:
    top, bottom = (F.col(c) if isinstance(c, str) else c for c in (top, bottom))
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def band(value: Column | str, edges: Sequence[int], top: str | None = None) -> Column:
    """Half-open integer bands: edges (100, 250, 500) label 100-249, 250-499 and 500+, which also takes what is below."""
    value = F.col(value) if isinstance(value, str) else value
    label = F.lit(top or f"{edges[-1]}+")
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        label = F.when((value >= low) & (value < high), f"{low}-{high - 1}").otherwise(label)
    return label


def dominant_component(parts: Mapping[str, Column], total: Column, floor: float = 0.8) -> Column:
    """none / unclassified (visible parts below the floor) / the part that reaches the floor of the total / mixed."""
    known = {k: F.coalesce(c, F.lit(0)) for k, c in parts.items()}
    together = sum(known.values(), F.lit(0))
    empty = F.lit(True)
    for c in known.values():
        empty = empty & (c == 0)
    label = F.lit("mixed")
    for k, c in reversed(known.items()):
        label = F.when(c / total >= floor, k).otherwise(label)
    return F.when((total <= 0) | empty, "none").when(together / total < floor, "unclassified").otherwise(label)


def visible_dominance(parts: Mapping[str, Column], total: Column, coverage: float = 0.8, floor: float = 0.8) -> Column:
    """As above, but dominance is measured against what is visible, after the coverage check."""
    known = [F.coalesce(c, F.lit(0)) for c in parts.values()]
    visible = sum(known, F.lit(0))
    largest = F.coalesce(ratio(F.greatest(*known), visible), F.lit(0.0))
    return F.when(F.coalesce(ratio(visible, total), F.lit(0.0)) < coverage, "unclassified-insufficient-component-coverage").when(largest >= floor, "dominant-visible-component").otherwise("mixed-visible-components")


def identity_key(**columns: Column) -> tuple[Column, Column]:
    """First non-null of the columns with its name as prefix, and that name; the last column must not be null."""
    key = F.coalesce(*[F.concat(F.lit(f"{k}:"), c.cast("string")) for k, c in columns.items()])
    quality = F.coalesce(*[F.when(c.isNotNull(), k) for k, c in columns.items()])
    return key, quality


def censored_change(before: Column, after: Column, hidden: int = 10) -> dict[str, Column]:
    """Change of a count that is null where it was suppressed, that is, somewhere in 0..hidden. One side is visible."""
    both = before.isNotNull() & after.isNotNull()
    change = after - before
    return {
        "change": F.when(both, change),
        "change_low": F.when(both, change).when(before.isNull(), after - hidden).otherwise(-before),
        "change_high": F.when(both, change).when(before.isNull(), after).otherwise(F.lit(hidden) - before),
        "ranking_magnitude": F.abs(F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0))),
        "visibility_status": F.when(both, "both-visible-exact").when(before.isNull(), f"became-visible-prior-0-to-{hidden}-or-absent").otherwise(f"became-nonvisible-current-0-to-{hidden}-or-absent"),
        "change_percent": F.when(both, 100 * ratio(change, before)),
    }


def display_name(first: Column, last: Column) -> Column:
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" ", part(first), part(last))


def reasons(separator: str, **rules: Column) -> Column:
    """Names of the rules that hold, in the given order."""
    return F.concat_ws(separator, *[F.when(c, k) for k, c in rules.items()])


def exposure(total: Column, beneficiaries: Column, quartile: Column) -> Column:
    """What exceeds beneficiaries times the peers' third quartile; null where that is unknown."""
    return F.when(quartile.isNotNull() & beneficiaries.isNotNull(), F.greatest(F.lit(0.0), total - beneficiaries * quartile))


def denominator_status(value: Column) -> Column:
    return F.when(value.isNull() | (value <= 0), "missing").otherwise("available")


def canonical_decimal(value: Column) -> Column:
    """Decimal text without exponent or trailing zeros."""
    text = value.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def marked_number(text: Column) -> tuple[Column, Column]:
    """Value of a source cell and whether it is malformed; blank, * and # mean suppressed, so null and not malformed."""
    clean = F.trim(text)
    hidden = text.isNull() | clean.isin("", "*", "#")
    value = F.when(~hidden & clean.rlike(r"^[0-9]+(\.[0-9]+)?$"), clean.try_cast("decimal(38,10)"))
    return value, ~hidden & value.isNull()


def provenance(algorithm: str, version: str, **caveats: str) -> dict[str, Column]:
    return {"screen_algorithm": F.lit(algorithm), "screen_algorithm_version": F.lit(version), **{f"{k}_caveat": F.lit(v) for k, v in caveats.items()}}
