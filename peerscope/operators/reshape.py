"""Reshaping: long and wide forms, spines, tagged unions, set and snapshot comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, keep: Sequence[str], metrics: Mapping[str, str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row per metric, unknown values included."""
    pairs = F.array(*[F.struct(F.lit(n).alias(name), F.col(c).cast("double").alias(value)) for n, c in metrics.items()])
    return df.select(*keep, F.inline(pairs))


def pivot(df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Statistics of a long table side by side, as <value>_<stat>."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(*[c.alias(n) for n, c in stats.items()])


def year_spine(df: DataFrame, first: int, last: int, name: str = "data_year") -> DataFrame:
    """Every year of the range once, from the session of df."""
    return df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def tagged_values(df: DataFrame, keep: Sequence[str], arrays: Mapping[str, str]) -> DataFrame:
    """(kind, value) rows of several arrays; blank values are left out."""
    tag = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    rows = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), tag(k)) for k, c in arrays.items()]
    out = df.select(*keep, F.inline(F.concat(*rows)))
    return out.filter(F.coalesce(F.trim("value"), F.lit("")) != "")


def values_by_kind(tagged: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Sorted distinct values per kind; null where a kind has none."""
    got = {k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value")))) for k in kinds}
    return tagged.groupBy(*keys).agg(*[F.when(F.size(c) > 0, c).alias(f"{k}_values") for k, c in got.items()])


def set_difference(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side: missing or extra."""
    missing = expected.select(key).distinct().join(observed, key, "left_anti").select(key, F.lit("missing").alias("side"))
    extra = observed.select(key).distinct().join(expected, key, "left_anti").select(key, F.lit("extra").alias("side"))
    return missing.unionByName(extra)


def three_way(base: DataFrame, current: DataFrame, upstream: DataFrame, key: str, digest: str) -> DataFrame:
    """Decision per key from the digests of a common base, our current state and the upstream state.

    Keys that the base lacks are added, kept as ours, or collide. Where we did not change the base, upstream decides;
    where only we changed it, ours stays; where both did, someone has to look.
    """
    pick = lambda df, n: df.select(key, F.col(digest).alias(n))
    rows = pick(base, "base").join(pick(current, "current"), key, "full_outer").join(pick(upstream, "upstream"), key, "full_outer")
    b, c, u = F.col("base"), F.col("current"), F.col("upstream")
    unknown = F.when(c.isNull() & u.isNotNull(), "add-upstream-baseline").when(c.isNotNull() & u.isNull(), "preserve-local-only").otherwise("namespace-collision-review-required")
    unchanged = F.when(u.isNull(), "upstream-removal-decision-required").when(u == b, "no-change").otherwise("replace-unchanged-baseline")
    decision = F.when(b.isNull(), unknown).when(c.eqNullSafe(b), unchanged).when(u.isNull() | (u == b), "preserve-local-divergence").otherwise("conflict-review-required")
    return rows.select(key, "base", "current", "upstream", decision.alias("decision"))
