"""Fail-closed gates: eager one-row aggregates that raise with what they observed. A gate inside a lazy column would be
pruned with it and never fire."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """Input that an analysis must not run on."""


def audit_releases(requested: DataFrame, register: DataFrame, datasets: Sequence[str], first: int, last: int) -> DataFrame:
    """Requested ids with their register entry and whether they may be used."""
    found = requested.select("release_id").distinct().join(register, "release_id", "left")
    fit = (F.col("status") == "loaded") & F.col("dataset").isin(list(datasets)) & F.col("data_year").between(first, last)
    return found.withColumn("eligible", F.coalesce(fit, F.lit(False)))


def year_coverage(spine: DataFrame, audited: DataFrame) -> DataFrame:
    """Per requested year the eligible releases: how many, the largest id, all ids."""
    fit = audited.filter("eligible").select("data_year", "release_id")
    ids = F.array_sort(F.collect_list("release_id"))
    return spine.join(fit, "data_year", "left").groupBy("data_year").agg(F.count("release_id").alias("releases"), F.max("release_id").alias("largest"), ids.alias("ids"))


def coverage_gate(coverage: DataFrame, audited: DataFrame, exactly_one: bool = True) -> None:
    wrong = F.col("releases") != 1 if exactly_one else F.col("releases") < 1
    bad = coverage.agg(F.count_if(wrong).alias("n"), F.min(F.when(wrong, F.col("data_year"))).alias("y")).first()
    unfit = audited.agg(F.count_if(~F.col("eligible")).alias("n")).first()["n"]
    if bad["n"] or unfit:
        raise GateError(f"release coverage failed: years without the right releases={bad['n']}, first={bad['y']}, ineligible ids={unfit}")


def pinned_versions(register: DataFrame, pins: Mapping[int, str]) -> DataFrame:
    """Releases whose year has no pin or another version."""
    table = F.create_map(*[F.lit(x) for pair in pins.items() for x in pair])
    return register.filter(~F.coalesce(F.try_element_at(table, F.col("data_year")) == F.col("version"), F.lit(False)))


def filters_within(filters: Column, requested: Column) -> Column:
    """Whether every key of a release's retrieval filters is requested with the same values."""
    return F.forall(F.map_entries(filters), lambda e: F.coalesce(F.array_sort(F.element_at(requested, e["key"])) == F.array_sort(e["value"]), F.lit(False)))


def filters_equal(filters: Column, key: str, values: Sequence[str]) -> Column:
    """Whether the filters are the one key with exactly these values."""
    wanted = F.array(*[F.lit(v) for v in sorted(values)])
    return (F.size(filters) == 1) & F.coalesce(F.array_sort(F.element_at(filters, F.lit(key))) == wanted, F.lit(False))


def filter_coverage(requests: DataFrame, register: DataFrame, key: str, name: str, fixed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per requested (data_year, key) the eligible releases that cover it, whose filters are within {name: key} and `fixed`."""
    joined = requests.select("data_year", key).distinct().join(register.filter("eligible").select("data_year", "release_id", "filters"), "data_year", "left")
    covers = filters_within(F.col("filters"), _asked(key, name, fixed))
    return joined.groupBy("data_year", key).agg(F.count_if(F.coalesce(covers, F.lit(False))).alias("covering_releases"))


def _asked(key: str, name: str, fixed: Mapping[str, Sequence[str]]) -> Column:
    pairs = [x for k, v in fixed.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]
    return F.create_map(*pairs, F.lit(name), F.array(F.col(key)))


def unexpected_releases(requests: DataFrame, register: DataFrame, key: str, name: str, fixed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Eligible releases that cover no requested key of their year: narrower than, or beside, what was asked for."""
    eligible = register.filter("eligible")
    joined = eligible.select("data_year", "release_id", "filters").join(requests.select("data_year", key).distinct(), "data_year")
    used = joined.filter(filters_within(F.col("filters"), _asked(key, name, fixed))).select("release_id").distinct()
    return eligible.join(used, "release_id", "left_anti").select("release_id", "data_year")


def filter_gate(requests: DataFrame, register: DataFrame, key: str, name: str, fixed: Mapping[str, Sequence[str]], shown: int = 20) -> None:
    """Raises, with examples, unless one release covers each requested key of a year and no eligible release is unexpected."""
    wrong = filter_coverage(requests, register, key, name, fixed).filter("covering_releases != 1").orderBy("data_year", key).limit(shown)
    failed = [f"{r[0]}/{r[1]}={r[2]}" for r in wrong.collect()]
    odd = [str(r[0]) for r in unexpected_releases(requests, register, key, name, fixed).orderBy("release_id").limit(shown).collect()]
    if failed or odd:
        raise GateError(f"retrieval filters do not cover the request: {';'.join(failed) or '[none]'}; unexpected narrowed releases {','.join(odd) or '[none]'}")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def grain_gate(df: DataFrame, keys: Sequence[str]) -> None:
    """Raises, naming the first, where keys repeat."""
    first = duplicates(df, keys).agg(F.count("*").alias("n"), F.min(F.concat_ws("/", *keys)).alias("k")).first()
    if first["n"]:
        raise GateError(f"rows repeat at grain {'/'.join(keys)}: {first['n']} keys, first duplicate={first['k']}")


def domain_counts(df: DataFrame, required: Sequence[str] = (), nonnegative: Sequence[str] = (), patterns: Mapping[str, str] | None = None) -> DataFrame:
    """One row of counts of rule breaks: missing_<c>, negative_<c>, malformed_<c>."""
    bad = {f"missing_{c}": F.col(c).isNull() for c in required}
    for c in nonnegative:
        v = F.col(c).cast("double")
        bad[f"negative_{c}"] = (v < 0) | F.isnan(v) | (F.abs(v) == float("inf"))
    bad |= {f"malformed_{c}": ~F.coalesce(F.col(c).rlike(p), F.lit(False)) for c, p in (patterns or {}).items()}
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in bad.items()])


def domain_gate(df: DataFrame, **rules) -> None:
    found = domain_counts(df, **rules).first().asDict()
    broken = {k: v for k, v in found.items() if k != "rows" and v}
    if broken or not found["rows"]:
        raise GateError(f"value domain failed: rows={found['rows']}, {broken}")


def inconsistent_labels(df: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Keys with more than one value of a label that should be theirs alone."""
    counts = df.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"{c}_values") for c in labels])
    several = F.lit(False)
    for c in labels:
        several = several | (F.col(f"{c}_values") > 1)
    return counts.filter(several)


def label_disagreement(detail: DataFrame, summary: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Keys whose detail rows have another label than their summary row, with both."""
    mine = detail.select(*keys, F.col(label).alias("detail_label")).distinct()
    return mine.join(summary.select(*keys, F.col(label).alias("summary_label")).distinct(), list(keys)).filter(~F.col("detail_label").eqNullSafe(F.col("summary_label")))


def coverage_floor(df: DataFrame, part: str, whole: str, floor: float) -> DataFrame:
    """One row: lowest coverage, and whether all totals are positive and covered."""
    share = F.col(part) / F.nullif(F.col(whole), F.lit(0.0))
    return df.agg(F.min(share).alias("lowest"), F.coalesce(F.every((F.col(part) > 0) & (F.col(whole) > 0) & (share >= floor)), F.lit(False)).alias("valid"))


def scope_difference(candidates: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are missing from `found`, not asked for, or there more than once."""
    wanted, have = candidates.select(key).distinct().withColumn("asked", F.lit(True)), found.groupBy(key).agg(F.count("*").alias("copies"))
    both = wanted.join(have, key, "full_outer")
    problem = F.when(F.col("copies").isNull(), "missing").when(F.col("asked").isNull(), "extra").when(F.col("copies") > 1, "repeated")
    return both.select(key, problem.alias("problem")).filter("problem is not null")


def cap_gate(df: DataFrame, cap: int) -> None:
    n = df.limit(cap + 1).count()
    if not 1 <= n <= cap:
        raise GateError(f"selected rows out of bounds: {'more than ' if n > cap else ''}{min(n, cap)} of at most {cap}")
