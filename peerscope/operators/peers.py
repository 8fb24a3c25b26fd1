"""Exact peer-group statistics.

Rows of small strata are scored in windows: quartiles, deviations and percentiles all share one shuffle by the stratum's
keys, and nothing is joined back. Strata of more than `strata.SPLIT_ROWS` rows are split by ranges of values instead. Both
forms, `Windows` and `Split`, give the same results; `scored` chooses by a stratum's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.robust import median_ratio, robust_z, scale_source
from . import strata


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join statistics to their rows on the stratum; rows with a null key have no stratum and match nothing.

    No hint: the statistics' size is known when their stage ends, and adaptive execution broadcasts them only then, if
    they are below the session's threshold.
    """
    return df.join(stats, list(keys), how)


def quartiles(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """peer_count and <name>_q1, _median, _q3, _iqr, _mad per stratum, whatever its size."""
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("peer_count"))
    return attach(counts, strata.robust(df, keys, metrics), keys, "left")


class Windows:
    """Rows of a stratum are one partition of a window."""

    @staticmethod
    def with_peer_stats(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
        """Rows with their stratum's count, quartiles, IQR and MAD; rows with a null key have no stratum and are left out."""
        w = Window.partitionBy(*keys)
        three = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        known = df.dropna(subset=list(keys)).withColumns({"peer_count": F.count("*").over(w), **{f"__{n}": F.percentile(m, three).over(w) for n, m in metrics.items()}})
        at = lambda n, i: F.get(f"__{n}", F.lit(i))
        named = {f"{n}_{k}": c for n in metrics for k, c in (("q1", at(n, 0)), ("median", at(n, 1)), ("q3", at(n, 2)), ("iqr", at(n, 2) - at(n, 0)))}
        known = known.withColumns(named).drop(*[f"__{n}" for n in metrics])
        return known.withColumns({f"{n}_mad": F.percentile(F.abs(F.col(m) - F.col(f"{n}_median")), 0.5).over(w) for n, m in metrics.items()})

    @staticmethod
    def percentiles(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], suffix: str = "percentile") -> DataFrame:
        """Empirical percentile (share of the stratum at or below), nulls ranking last and counted."""
        return df.withColumns({f"{n}_{suffix}": F.cume_dist().over(Window.partitionBy(*keys).orderBy(F.col(m).asc_nulls_last())) for n, m in metrics.items()})

    @staticmethod
    def with_excluded_stats(cells: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], is_peer: Column, count: str = "peer_count") -> DataFrame:
        """All rows with the statistics of their stratum's peers alone, in windows, so that several scopes and ranks share one shuffle."""
        w, three = Window.partitionBy(*keys), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        of = lambda value: F.when(is_peer, value)
        out = cells.withColumns({count: F.count(of(F.lit(1))).over(w), **{f"__{n}": F.percentile(of(F.col(m)), three).over(w) for n, m in metrics.items()}})
        at = lambda n, i: F.get(f"__{n}", F.lit(i))
        out = out.withColumns({f"{n}_{k}": c for n in metrics for k, c in (("q1", at(n, 0)), ("median", at(n, 1)), ("q3", at(n, 2)), ("iqr", at(n, 2) - at(n, 0)))}).drop(*[f"__{n}" for n in metrics])
        return out.withColumns({f"{n}_mad": F.percentile(of(F.abs(F.col(m) - F.col(f"{n}_median"))), 0.5).over(w) for n, m in metrics.items()})

    @staticmethod
    def excluded_rank(cells: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], is_peer: Column, is_candidate: Column) -> DataFrame:
        """Candidates with <name>_high_rank (1 + peers above) and <name>_peer_share (peers at or below over peers).

        Candidates and peers of a stratum are counted in one ordered window, not joined pair by pair, so the work does not
        grow with candidates times peers.
        """
        peer = F.when(is_peer, 1).otherwise(0)
        out = cells.withColumn("__peer", peer)
        for n, m in metrics.items():
            counted = F.when(F.col(m).isNotNull(), F.col("__peer")).otherwise(0)
            upto = Window.partitionBy(*keys).orderBy(F.col(m).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
            out = out.withColumn("__upto", F.sum(counted).over(upto)).withColumn("__all", F.sum(counted).over(Window.partitionBy(*keys)))
            known = F.col(m).isNotNull() & (F.col("__all") > 0)
            out = out.withColumn(f"{n}_high_rank", F.when(known, 1 + F.col("__all") - F.col("__upto"))).withColumn(f"{n}_peer_share", F.when(known, F.col("__upto") / F.col("__all")))
        return out.filter(is_candidate).drop("__peer", "__upto", "__all")


class Split:
    """Strata are split by ranges of values, with the results of `Windows`. Rows with a null in the keys have no statistics."""

    @staticmethod
    def with_peer_stats(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
        known = df.dropna(subset=list(keys))
        return attach(attach(known, known.groupBy(*keys).agg(F.count("*").alias("peer_count")), keys), strata.robust(known, keys, metrics), keys, "left")

    @staticmethod
    def percentiles(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], suffix: str = "percentile") -> DataFrame:
        shares = {f"{n}_{suffix}": F.coalesce(F.col(f"__{n}_upto") / F.col(f"__{n}_total"), F.lit(1.0)) for n in metrics}
        return strata.ranked(df, keys, metrics, nulls=True).withColumns(shares).drop(*[f"__{n}_{k}" for n in metrics for k in ("upto", "total")])

    @staticmethod
    def with_excluded_stats(cells: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], is_peer: Column, count: str = "peer_count") -> DataFrame:
        peer = F.coalesce(is_peer, F.lit(False))
        out = attach(cells, cells.groupBy(*keys).agg(F.count_if(peer).alias(count)), keys, "left")
        return attach(out, strata.robust(cells.filter(peer), keys, metrics), keys, "left")

    @staticmethod
    def excluded_rank(cells: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], is_peer: Column, is_candidate: Column) -> DataFrame:
        out = strata.ranked(cells, keys, metrics, F.when(is_peer, 1).otherwise(0))
        for n in metrics:
            some = F.col(f"__{n}_total") > 0
            out = out.withColumn(f"{n}_high_rank", F.when(some, 1 + F.col(f"__{n}_total") - F.col(f"__{n}_upto"))).withColumn(f"{n}_peer_share", F.when(some, F.col(f"__{n}_upto") / F.col(f"__{n}_total")))
        return out.filter(is_candidate).drop(*[f"__{n}_{k}" for n in metrics for k in ("upto", "total")])


Form = type[Windows] | type[Split]


def scored(df: DataFrame, keys: Sequence[str], use: Callable[[Form, DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """use(form, rows) with the windowed form for small strata of `keys` and the split form for large ones."""
    return strata.by_size(df, keys, lambda rows: use(Windows, rows), lambda rows: use(Split, rows), most)


def with_peer_stats(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], most: int | None = None) -> DataFrame:
    return scored(df, keys, lambda form, rows: form.with_peer_stats(rows, keys, metrics), most)


def percentiles(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], suffix: str = "percentile", most: int | None = None) -> DataFrame:
    return scored(df, keys, lambda form, rows: form.percentiles(rows, keys, metrics, suffix), most)


def with_excluded_stats(cells: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], is_peer: Column, count: str = "peer_count", most: int | None = None) -> DataFrame:
    return scored(cells, keys, lambda form, rows: form.with_excluded_stats(rows, keys, metrics, is_peer, count), most)


def excluded_rank(cells: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], is_peer: Column, is_candidate: Column, most: int | None = None) -> DataFrame:
    return scored(cells, keys, lambda form, rows: form.excluded_rank(rows, keys, metrics, is_peer, is_candidate), most)


def score(df: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """<name>_z, _scale, _ratio and _delta from the statistics that the rows carry."""
    out = {}
    for n, m in metrics.items():
        x, med, mad, iqr = F.col(m), F.col(f"{n}_median"), F.col(f"{n}_mad"), F.col(f"{n}_iqr")
        out |= {f"{n}_z": robust_z(x, med, mad, iqr), f"{n}_scale": scale_source(x, med, mad, iqr), f"{n}_ratio": median_ratio(x, med), f"{n}_delta": F.abs(x - med)}
    return df.withColumns(out)


def scopes(df: DataFrame, state: str) -> DataFrame:
    """Rows once for the nation (blank geography) and once for their state, by `peer_scope` and `geography`; blank states have no own scope."""
    place = F.nullif(F.upper(state), F.lit(""))
    scope = lambda name, where: F.struct(F.lit(name).alias("peer_scope"), where.alias("geography"))
    both = F.array(scope("national", F.lit("")), scope("supplier-address-state", place))
    return df.select("*", F.inline(F.when(place.isNull(), F.slice(both, 1, 1)).otherwise(both)))


def excluded_stats(cells: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], is_peer: Column) -> DataFrame:
    """Statistics per stratum over its peers alone, such as the cells outside a candidate cohort."""
    return quartiles(cells.filter(is_peer), keys, metrics)
