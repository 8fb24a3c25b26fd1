"""Quality rules whose cutoffs carry a finite-sample guarantee.

Every rule rejects a document whose rate exceeds a cutoff. The cutoffs of a stratum are chosen on labelled good
documents, in two parts dealt by a hash of the id:

1. The tuning part sets where each rule's path ends: the lowest bin above which at most a fraction TAIL of the stratum's
   good documents lie. The path of all rules together goes from BINS bins above these ends, where nothing is rejected,
   down to the ends, one bin at a time.
2. The holdout part tests the path in that fixed sequence, from the loosest step on. A step passes when the exact binomial
   tail P(Bin(n, alpha) <= k) is at most the stratum's share of delta, where any rule rejects k of the n good documents.
   The sequence stops at its first failure and the last step that passed holds, so steps need no correction among each
   other, and rules none, as they are tested together. As k only grows along the path, the last step that passes is the
   strictest that passes at all.

Multiple testing is corrected over strata (Bonferroni): half of delta is shared by the strata, half goes to a pool of all
labelled good documents. A stratum with too few labels to certify a step takes the pool's cutoffs; without those its rules
stay off. So with probability 1 - delta no certified stratum loses more than `alpha` of its good documents to the rules,
nor do all strata together under the pool's cutoffs; for one stratum under them the pool guarantees nothing on its own.

Defined results: null text counts as empty; an empty or blank text has no words, so it fails the base rule; repeated
rows are judged alike; a null stratum is a stratum of its own; an empty table gives an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, body, cut, held_out, join_small, let

#: Name and rate of each rule, over the columns of text_statistics().
RULES = {
    "symbols": lambda: F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeats": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "word_length": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) / 100,
    "capitals": lambda: F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
}
#: Cutoffs are multiples of 1 / BINS.
BINS = 50
#: Share of a stratum's tuning documents that may lie above the end of one rule's path.
TAIL = 0.002
#: One labelled good document in TUNING sets the path's end, the others test the path.
TUNING = 4
_POOL = "\1"


def repeated_words(words: Column) -> Column:
    """Number of words that stand in a three-word window found at least twice."""

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        return F.aggregate(at, zero, step, lambda acc: acc["n"])

    def found_twice(h: Column) -> Column:
        """Positions of hashes that occur again; a few by lookup, many by sorting hash and position together."""
        positions = F.sequence(F.lit(0), F.size(h) - 1)
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = lambda t: F.filter(t, lambda x, i: F.coalesce(F.get(t, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(t, i + 1)["h"] == x["h"], F.lit(False)))
        by_sort = F.sort_array(F.transform(let(tagged, twins), lambda x: x["i"]))
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False)))))
        return let(again, lambda d: F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= 16, covered(F.filter(positions, lambda i: F.array_contains(d, F.get(h, i))))).otherwise(covered(by_sort)))

    windows = lambda w: F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 2), F.get(w, i - 1), F.get(w, i)))
    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), found_twice))).cast("long")


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and the counts the rules are made of, from one pass over the whole text."""
    text, blank = F.col("__t"), r"[\x20\x09-\x0D]+"
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    named = [F.col(f"`{c}`") for c in keep]
    return (
        docs.select(*named, body().alias("__t"))
        .select(*named, text, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__w"), lines.alias("__l"))
        .select(
            *named,
            F.size("__w").cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, blank, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("__w")).alias("n_repeat_words"),
            F.size("__l").cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        )
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms; 1 where k is at or above the mean and the tail is of no use."""
    n, ratio = n.cast("double"), math.log(p / (1 - p))
    start = n * math.log1p(-p)

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(ratio)
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(acc["total"], term) - high))).alias("total"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(terms, F.struct(start.alias("term"), start.alias("total")), step, lambda acc: acc["total"])))


def stratum_key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("\0"))


def certified_cutoffs(good: DataFrame, stratum: str, doc_id: str = "doc_id", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per stratum: __k (its key), certified ('stratum', 'pool' or null) and a column cut_<rule> each.

    good: statistics of labelled good documents. Both parts are reduced to histograms with partial aggregation, so what
    is shuffled is strata x rules x BINS rows a task, whatever the number of labels.
    """
    bins = F.array(*[F.greatest(F.least(F.ceil(v() * BINS), F.lit(BINS + 1)), F.lit(0)).cast("int") for v in RULES.values()])
    tuning = F.pmod(F.xxhash64(F.lit("tuning"), F.col(doc_id)), F.lit(TUNING)) == 0
    rows = good.select(F.explode(F.array(stratum_key(stratum), F.lit(_POOL))).alias("__k"), bins.alias("bins"), tuning.alias("tuning"))
    hist = rows.filter("tuning").select("__k", F.posexplode("bins").alias("rule", "bin")).groupBy("__k", "rule", "bin").agg(F.count("*").alias("c"))
    above = Window.partitionBy("__k", "rule").orderBy(F.col("bin").desc())
    whole = Window.partitionBy("__k", "rule")
    over = F.coalesce(F.sum("c").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = hist.withColumn("over", over).withColumn("n", F.sum("c").over(whole)).filter(F.col("over") <= F.col("n") * TAIL).groupBy("__k", "rule").agg(F.min("bin").alias("bin"))
    ends = ends.groupBy("__k").pivot("rule", list(range(len(RULES)))).agg(F.first("bin")).select("__k", F.array(*[F.col(str(i)) for i in range(len(RULES))]).alias("ends"))
    # A document is rejected at every step that is less than `beyond` bins above the ends.
    beyond = F.greatest(F.array_max(F.zip_with("bins", "ends", lambda b, e: b - e)), F.lit(0))
    steps = join_small(rows.filter("not tuning"), ends, ["__k"]).groupBy("__k", beyond.alias("beyond")).agg(F.count("*").alias("c"))
    n = Window.partitionBy("__k")
    later = n.orderBy(F.col("beyond").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("__k", "beyond", F.coalesce(F.sum("c").over(later), F.lit(0)).alias("k"), F.sum("c").over(n).alias("n"))
    strata = F.greatest(F.count_if(F.col("__k") != _POOL).over(Window.partitionBy(F.lit(1))), F.lit(1))
    level = rows.select("__k").distinct().select("__k", F.when(F.col("__k") == _POOL, delta / 2).otherwise(delta / 2 / strata).alias("level"))
    # What lies between two occupied steps rejects as the lower one does, so occupied steps are all there is to test.
    passed = steps.join(level, "__k").filter(binomial_tail(F.col("n"), F.col("k"), alpha) <= F.col("level")).groupBy("__k").agg(F.min("beyond").alias("step"))
    found = level.join(ends, "__k", "left").join(passed, "__k", "left").select("__k", F.when(F.col("step").isNotNull(), F.struct("ends", "step")).alias("own"))
    pool = F.max(F.when(F.col("__k") == _POOL, F.col("own"))).over(Window.partitionBy(F.lit(1)))
    held = found.withColumn("pool", pool).withColumn("used", F.coalesce("own", "pool")).filter(F.col("__k") != _POOL)
    by = F.when(F.col("own").isNotNull(), "stratum").when(F.col("pool").isNotNull(), "pool")
    return held.select("__k", by.alias("certified"), *[((F.get("used.ends", F.lit(i)) + F.col("used.step")) / BINS).alias(f"cut_{r}") for i, r in enumerate(RULES)])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Per document: its counts, base_failed, kept, whose certificate its cutoffs have, and the cutoffs.

    Labels are read only where the id is not held out, so the guarantee can be checked on the rest. An id that is
    labelled more than once counts as good if all its labels say so. A stratum without labels has no cutoffs.
    """
    stats = cut(text_statistics(docs.select("doc_id", F.col(stratum).alias("__s"), "text"), ["doc_id", "__s"]))
    marked = labels.filter(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    cuts = cut(certified_cutoffs(stats.join(marked, "doc_id", "left_semi"), "__s", alpha=alpha, delta=delta))
    judged = join_small(stats.withColumn("__k", stratum_key("__s")), cuts, ["__k"], "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = F.lit(False)
    for name, rate in RULES.items():
        # Compared in bins, as the cutoffs were tested.
        broken = broken | F.coalesce(F.ceil(rate() * BINS) > F.round(F.col(f"cut_{name}") * BINS), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~broken).alias("kept"), "certified", *[f"cut_{r}" for r in RULES],
    )
