"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sources, in code-point order with null last, take the weights in turn and share the total size; no target exceeds
   `repeats` times its source's size, and the excess is shared again by weight (a water level over size / weight).
2. The total is cut into blocks of `block` words, one by default whatever the input's size. Each source gets as many as
   its quotients target / (2j + 1) among the highest. Only quotients near the last one are listed, so small blocks cost
   nothing; with blocks above a source's target that source could get none.
3. The words of a source's blocks are apportioned the same way to its shards, which hold about `shard_rows` documents
   each, so a hot source is spread over many tasks. A block may span shards, so it may be larger than one.
4. In a shard the documents stand in an order seeded by the md5 of seed and id, and form a ring. A quota of q words takes
   the ring from its start, going round as often as needed. As a source takes at most `repeats` times its size, so do
   its shards: at the divisor 1 / repeats each shard would get exactly that, and fewer seats mean a larger divisor.

Defined results: null text has size 0 and takes 0; sources of size 0 have target 0; repeated rows count each for
itself; rows that tie on id and size are interchangeable; an empty table gives an empty result. Only doc_id, text and
source are read. Per-source aggregates, one short row each, are ordered in one task; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, body, cut, join_small

WEIGHTS = (5.0, 2.0, 1.0)
#: Words in a block.
BLOCK = 1


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """sources(source, source_size) with rank, weight and target.

    The level L at which sum(min(cap, L * weight)) reaches the total is found from running sums over cap / weight: the
    sources that reach their cap are a prefix of that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1))
    by_level = Window.orderBy("level", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    ranked = (
        sources.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * repeats).cast("double"))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = ranked.withColumn("open", rest).withColumn("capped", F.col("level") <= F.col("open"))
    # Capped sources come first; the level is what the first source below its cap sees.
    level = F.min(F.when(~F.col("capped"), F.struct("level", "rank", "open"))).over(whole)["open"]
    return full.withColumn("water", level).withColumn("target", F.when(F.col("capped") | F.col("water").isNull(), F.col("cap")).otherwise(F.col("water") * F.col("weight"))).select("source", "source_size", "rank", "target")


def sainte_lague(groups: DataFrame, within: list[str], share: str, seats: str, order: str, out: str) -> DataFrame:
    """Seats for every row in proportion to `share` among the rows that agree on `within`, by highest quotients.

    With divisor d a row has floor(share / d + 1/2) quotients of at least d / 2, within half a seat of share / d.
    So with n rows the divisors total / (seats - n / 2) and total / (seats + n / 2) give too few and enough seats; only
    quotients between the two, about n, are ranked.
    """
    w = Window.partitionBy(*(within or [F.lit(1)]))
    some = groups.withColumn("__total", F.sum(share).over(w)).withColumn("__n", F.sum(F.when(F.col(share) > 0, 1).otherwise(0)).over(w))
    seat_count = lambda extra: F.when(F.col("__total") > 0, F.floor(F.col(share) / F.col("__total") * F.greatest(extra, F.lit(0.0)) + 0.5)).otherwise(F.lit(0)).cast("long")
    some = some.withColumn("__low", seat_count(F.col(seats) - F.col("__n") / 2 - 1)).withColumn("__high", F.greatest(seat_count(F.col(seats) + F.col("__n") / 2 + 1), F.col("__low")))
    some = some.withColumn("__left", F.col(seats) - F.sum("__low").over(w))
    keys = [*within, order]
    open_ = some.filter("__high > __low").select(*keys, share, "__left", F.explode(F.sequence(F.col("__low"), F.col("__high") - 1)).alias("__j"))
    by_quotient = w.orderBy((F.col(share) / (2 * F.col("__j") + 1)).desc(), F.col(order), F.col("__j"))
    won = open_.withColumn("__r", F.row_number().over(by_quotient)).filter(F.col("__r") <= F.col("__left")).groupBy(*keys).agg(F.count("*").alias("__more"))
    return some.join(won, keys, "left").withColumn(out, F.col("__low") + F.coalesce(F.col("__more"), F.lit(0))).drop("__total", "__n", "__low", "__high", "__left", "__more")


def overlap(start: Column, end: Column, stop: Column) -> Column:
    """Length of [start, end) inside [0, stop)."""
    return F.greatest(F.least(end, stop) - start, F.lit(0))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = 3, block: int = BLOCK, shard_rows: int = 4096, seed: str = "mix-1", carry: list[str] | None = None, shards: bool = True) -> DataFrame:
    """Per document: the columns `carry` (only doc_id by default), size, source_size, target, taken and, if asked for, shard.

    Sizes and orders are computed once and kept; only if more columns are carried are they computed again with them.
    """
    carry = carry or ["doc_id"]
    seeded = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # A source stands for its name with a mark before it, so that a null source needs no care.
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    measures = [key.alias("__k"), F.regexp_count(body(), F.lit(WORD)).cast("long").alias("__size"), seeded.alias("__h")]
    carried = lambda names: F.struct(*[F.col(f"`{c}`") for c in names]).alias("__carry")  # noqa: E731  (their names can't clash)
    narrow = cut(docs.select(carried(["doc_id"]), F.col("doc_id").alias("__id"), *measures))
    wide = narrow if carry == ["doc_id"] else docs.select(carried(carry), F.col("doc_id").alias("__id"), *measures)
    sources = narrow.groupBy("__k").agg(F.sum("__size").alias("source_size"), F.count("*").alias("__docs"))
    sources = cut(sources.select(F.when(F.col("__k") != "", F.expr("substring(__k, 2)")).alias("source"), "source_size", "__docs"))
    whole = Window.partitionBy(F.lit(1))
    counts = sources.select(key.alias("__k"), "__docs")
    targets = (
        source_targets(sources.select("source", "source_size"), weights, repeats)
        .withColumn("__block", F.lit(block).cast("long"))
        .withColumn("__seats", F.floor(F.sum("source_size").over(whole) / F.col("__block")))
    )
    quotas = sainte_lague(targets, [], "target", "__seats", "rank", "__quota").select(key.alias("__k"), "rank", "source_size", "target", "__block", "__quota")
    quotas = cut(quotas.join(counts, "__k").withColumn("__shards", F.greatest(F.ceil(F.col("__docs") / shard_rows), F.lit(1))))
    place = lambda df: join_small(df, quotas, ["__k"]).withColumn("__shard", F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") % F.col("__shards"))
    words = F.least(F.col("__quota") * F.col("__block"), F.col("source_size") * repeats)  # a last block may pass the limit
    parts = place(narrow).groupBy("rank", "__shard").agg(F.sum("__size").alias("__len"), F.first(words).alias("__words"))
    shares = sainte_lague(parts, ["rank"], "__len", "__words", "__shard", "__take").select("rank", "__shard", "__len", "__take")
    ring = Window.partitionBy("rank", "__shard").orderBy("__h", "__id", "__size")
    stood = place(wide).withColumn("__end", F.sum("__size").over(ring.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rounds, part = F.floor(F.col("__take") / F.greatest(F.col("__len"), F.lit(1))), F.col("__take") % F.greatest(F.col("__len"), F.lit(1))
    taken = rounds * F.col("__size") + overlap(F.col("__end") - F.col("__size"), F.col("__end"), part)
    return stood.join(shares, ["rank", "__shard"]).select(*[F.col(f"__carry.`{c}`").alias(c) for c in carry], F.col("__size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"), *([F.col("__shard").alias("shard")] if shards else []))
