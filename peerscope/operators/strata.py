"""Order statistics, ranks and running sums of strata that are larger than a task.

Values are put into buckets that don't depend on the data and keep their order: some 256 to each doubling of a value's
size. Rows are counted per stratum, bucket and value, with partial aggregation, so ties cost nothing. Sums per bucket
are put in order (a stratum has some thousand buckets), which gives each bucket what comes before it; order inside a
bucket is a window over stratum and bucket. So no task holds a stratum:

- an order statistic only needs the buckets that hold its ranks, and all other rows stay out of the second step;
- a rank or a running sum is what comes before the bucket plus what comes before the value in it.

No bounds are collected. A stratum whose values all lie within a quarter of a percent of each
other is one bucket; its distinct values are then one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import cut

#: Rows above which a stratum is split.
SPLIT_ROWS = 1_000_000
#: Rows of small strata that a task is dealt on average, where these make more tasks than run at a time.
TASK_ROWS = 250_000
STEPS = 256
_BEFORE = (Window.unboundedPreceding, -1)


def bucket(value: Column) -> Column:
    """An integer that never falls as the value rises; null comes after all values, NaN before null."""
    v = value.cast("double")
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * STEPS).cast("long") + 1200 * STEPS
    finite = F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)
    return F.when(v.isNull(), 2402 * STEPS).when(F.isnan(v), 2401 * STEPS).otherwise(finite)


def by_size(df: DataFrame, keys: Sequence[str], windowed: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """`windowed` over the rows of small strata and `split` over those of strata above `most` rows, put together.

    Both must return the same rows and columns. The rows are cut first, so that they are computed once for the counts and
    for what follows. Rows with a null key are no stratum to be split, and go to `windowed`.
    Small strata are dealt out by rows, as windows widen their rows, of which the compressed size that adaptive execution
    goes by says little.
    """
    rows = cut(df)
    per = rows.groupBy(*keys).agg(F.count("*").alias("__rows"))
    is_large = F.col("__rows") > (SPLIT_ROWS if most is None else most)
    for k in keys:
        is_large = is_large & F.col(k).isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    small, big = per.agg(total(F.when(~is_large, F.col("__rows"))), total(F.when(is_large, F.col("__rows")))).first()
    tasks = -(-small // TASK_ROWS)
    dealt = lambda part: part.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else part
    if not big:
        return windowed(dealt(rows))
    large = per.filter(is_large).select(*keys)
    return windowed(dealt(rows.join(large, list(keys), "left_anti").select(*rows.columns))).unionByName(split(rows.join(large, list(keys), "left_semi").select(*rows.columns)))


def running(table: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str], by: Column | None = None) -> DataFrame:
    """table with <s>_upto and <s>_total for each of `sums`: over all rows of its keys up to it, itself included, and all.

    `order` is ascending; no two rows of a key may agree on all of it. Its first column is a number that buckets are made of,
    unless `by` states another bucket, a value that never falls along the order. Rows with a null key are left out.
    """
    named = table.withColumn("__bucket", bucket(F.col(order[0])) if by is None else by)
    per = named.groupBy(*keys, "__bucket").agg(*[F.sum(s).alias(f"__in_{s}") for s in sums])
    over = Window.partitionBy(*keys)
    before = over.orderBy("__bucket").rowsBetween(*_BEFORE)
    known = {f"{s}_total": F.sum(f"__in_{s}").over(over) for s in sums} | {f"__before_{s}": F.sum(f"__in_{s}").over(before) for s in sums}
    per = per.withColumns(known).drop(*[f"__in_{s}" for s in sums])
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = named.join(per, [*keys, "__bucket"]).withColumns({f"{s}_upto": F.coalesce(F.col(f"__before_{s}"), F.lit(0)) + F.sum(s).over(inside) for s in sums})
    return out.drop("__bucket", *[f"__before_{s}" for s in sums])


def counted(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str | Column], weight: Column | None = None, nulls: bool = False) -> DataFrame:
    """(keys, __metric, __value, __n): how many rows, or how much of `weight`, have each value of each metric."""
    cells = [F.struct(F.lit(n).alias("__metric"), (F.col(m) if isinstance(m, str) else m).cast("double").alias("__value"), (F.lit(1) if weight is None else weight).cast("long").alias("__n")) for n, m in metrics.items()]
    rows = df.select(*keys, F.inline(F.array(*cells)))
    return (rows if nulls else rows.filter("__value IS NOT NULL")).groupBy(*keys, "__metric", "__value").agg(F.sum("__n").alias("__n"))


def quantiles(table: DataFrame, keys: Sequence[str], ps: Mapping[str, float]) -> DataFrame:
    """(keys, __metric, one column for each of `ps`) of what `counted` returns, interpolated as `percentile` does it."""
    by = [*keys, "__metric"]
    named = table.filter("__n > 0").withColumn("__bucket", bucket(F.col("__value")))
    per = named.groupBy(*by, "__bucket").agg(F.sum("__n").alias("__in"))
    over = Window.partitionBy(*by)
    per = per.withColumns({"__total": F.sum("__in").over(over), "__before": F.coalesce(F.sum("__in").over(over.orderBy("__bucket").rowsBetween(*_BEFORE)), F.lit(0))})
    places = {n: (F.col("__total") - 1) * p for n, p in ps.items()}
    ranks = {n: (F.floor(place) + 1, F.ceil(place) + 1) for n, place in places.items()}
    hit = lambda rank, low, high: (rank > low) & (rank <= high)
    wanted = F.lit(False)
    for r in (x for two in ranks.values() for x in two):
        wanted = wanted | hit(r, F.col("__before"), F.col("__before") + F.col("__in"))
    inside = Window.partitionBy(*by, "__bucket").orderBy("__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = named.join(per.filter(wanted).drop("__in"), [*by, "__bucket"]).withColumn("__upto", F.col("__before") + F.sum("__n").over(inside))
    at = lambda rank: F.max(F.when(hit(rank, F.col("__upto") - F.col("__n"), F.col("__upto")), F.col("__value")))
    picked = rows.groupBy(*by).agg(F.max("__total").alias("__total"), *[at(r).alias(f"__{n}_{k}") for n, two in ranks.items() for k, r in zip(("low", "high"), two)])
    value = lambda n: (F.ceil(places[n]) - places[n]) * F.col(f"__{n}_low") + (places[n] - F.floor(places[n])) * F.col(f"__{n}_high")
    return picked.select(*by, *[F.when(F.col(f"__{n}_low") == F.col(f"__{n}_high"), F.col(f"__{n}_low")).otherwise(value(n)).alias(n) for n in ps])


THREE = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def robust(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], weight: Column | None = None) -> DataFrame:
    """(keys, <name>_q1, _median, _q3, _iqr, _mad for each metric) per stratum; a metric without values has nulls."""
    table = counted(df, keys, metrics, weight)
    first = quantiles(table, keys, THREE)
    by = [*keys, "__metric"]
    spread = table.join(first.select(*by, "median"), by).withColumn("__value", F.abs(F.col("__value") - F.col("median"))).groupBy(*by, "__value").agg(F.sum("__n").alias("__n"))
    both = first.join(quantiles(spread, keys, {"mad": 0.5}), by).withColumn("iqr", F.col("q3") - F.col("q1"))
    of = lambda n, k: F.max(F.when(F.col("__metric") == n, F.col(k))).alias(f"{n}_{k}")
    return both.groupBy(*keys).agg(*[of(n, k) for n in metrics for k in (*THREE, "iqr", "mad")])


def ranked(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], weight: Column | None = None, nulls: bool = False) -> DataFrame:
    """df with __<name>_upto and __<name>_total of each metric: rows (or weight) of its stratum at or below its value, and all.

    Null values have no `upto`. With `nulls` they count towards the total. Rows of a frequent value are a skewed key of a
    join with one row for each value, which adaptive execution splits.
    """
    ladder = running(counted(df, keys, metrics, weight, nulls), [*keys, "__metric"], ["__value"], ["__n"])
    for n, m in metrics.items():
        own = ladder.filter((F.col("__metric") == n) & F.col("__value").isNotNull()).select(*keys, F.col("__value").alias(f"__{n}_at"), F.col("__n_upto").alias(f"__{n}_upto"), F.col("__n_total").alias(f"__{n}_total"))
        df = df.withColumn(f"__{n}_at", F.col(m).cast("double")).join(own, [*keys, f"__{n}_at"], "left").drop(f"__{n}_at")
    return df
