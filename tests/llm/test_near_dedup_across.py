"""The exact join across components: members of one component never meet, all links between components are found."""

import random

from pyspark.sql import functions as F

from peerscope.llm import near_dedup


def crossings(entries):
    """Pairs that a join of both bits would make, for each shingle."""
    sides = entries.groupBy("s", "j", "above").agg(F.count_if(F.col("bit") == 0).alias("x"), F.count_if(F.col("bit") == 1).alias("y"))
    return {r.s: r.n for r in sides.groupBy("s").agg(F.sum(F.col("x") * F.col("y")).alias("n")).collect()}


def test_entries_of_one_component_never_meet(spark):
    r = random.Random(2)
    rows = [(s, node, r.choice([1, 1, 1, 1, 2, 3, 9, 20 + node])) for s in range(6) for node in range(r.choice([1, 5, 40]))]
    rows += [(77, node, 5) for node in range(50)]
    want = {}
    for s in {row[0] for row in rows}:
        owns = [o for t, _, o in rows if t == s]
        want[s] = sum(owns[i] != owns[j] for i in range(len(owns)) for j in range(i))
    found = near_dedup.apart(spark.createDataFrame(rows, "s long, node long, own long"))
    assert crossings(found) == {s: n for s, n in want.items() if n} and 77 in want and want[77] == 0


def test_a_hot_template_costs_no_pairs_within_its_component(spark):
    n, outliers = 100_000, 10
    first = spark.range(n + outliers).select(F.lit(1).cast("long").alias("s"), F.col("id").alias("node"), F.when(F.col("id") < n, -1).otherwise(F.col("id")).alias("own"))
    found = near_dedup.apart(first)
    assert found.count() <= 4 * (n + outliers) and crossings(found) == {1: n * outliers + outliers * (outliers - 1) // 2}


def test_links_across_are_those_of_all_pairs(spark):
    r = random.Random(5)
    template = [r.getrandbits(60) for _ in range(60)]
    sets, own = {}, {}
    for node in range(140):
        kind = node % 7
        base = template[: 60 if kind < 4 else 45]
        sets[node] = sorted(set(base) - {r.choice(base) for _ in range(r.randint(0, 9))} | {r.getrandbits(60) for _ in range(r.choice([0, 3, 8, 15]))})
        own[node] = 0 if kind < 3 else 1 if kind == 3 else node + 10
    want = set()
    for b in sets:
        for a in range(b):
            common = len(set(sets[a]) & set(sets[b]))
            if own[a] != own[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                want.add((a, b))
    nodes = spark.createDataFrame(list(own.items()), "node long, own long")
    got = near_dedup.links_across(nodes, spark.createDataFrame(list(sets.items()), "node long, shingles array<long>"))
    assert want and sorted((r.a, r.b) for r in got.collect()) == sorted(want)
