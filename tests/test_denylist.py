"""Deny lists: each kind of rule against a search rule by rule, and a cost that doesn't grow with the list."""

import hashlib
import random
import time
import unicodedata

import pytest

from peerscope.operators import denylist


def brute(path, text, rules):
    fold = lambda t: unicodedata.normalize("NFKC", t).casefold()
    hit = {
        "exact-text": lambda v: text is not None and v in text, "casefold-text": lambda v: text is not None and fold(v) in fold(text),
        "file-sha256": lambda v: text is not None and hashlib.sha256(text.encode()).hexdigest() == v.lower(), "path-fragment": lambda v: path is not None and fold(v) in fold(path),
    }
    return sorted((path, i, k) for i, k, v in rules if hit[k](v))


def many(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcÄßﬁé ") for _ in range(r.randint(1, 5)))
    return [(f"r{i}", r.choice(denylist.KINDS[:2] + denylist.KINDS[3:]), word()) for i in range(n)]


def test_five_thousand_rules_find_what_each_finds_alone(spark):
    r = random.Random(4)
    rules = many(5000) + [("empty", "exact-text", ""), ("none", "file-sha256", hashlib.sha256(b"").hexdigest().upper()), ("twice", "exact-text", "ab"), ("again", "exact-text", "ab"), ("within", "exact-text", "b")]
    text = lambda: "".join(r.choice("abcäÄßſﬁé ") for _ in range(r.randint(0, 30)))
    files = [(f"/{text()}/{i}", text()) for i in range(60)] + [("/p", None), (None, "ab"), ("/p", ""), ("/p", "ab"), ("/p", "ab")]
    got = denylist.deny_scan(spark.createDataFrame(files, "path string, text string").repartition(3), "path", "text", rules).collect()
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, got), key=key) == sorted((x for p, t in files for x in brute(p, t, rules)), key=key)


def test_cost_of_a_text_does_not_grow_with_the_list():
    text = "lorem ipsum dolor sit amet " * 20_000

    def seconds(n):
        rules = denylist.Rules([(str(i), "exact-text", f"{hashlib.md5(str(i).encode()).hexdigest()}") for i in range(n)])
        took = []
        for _ in range(3):
            start = time.perf_counter()
            assert rules.broken("p", text) == []
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(5000) < 10 * seconds(10)


def test_edges(spark):
    none = spark.createDataFrame([], "path string, text string, kind int")
    assert denylist.deny_scan(none, "path", "text", many(3)).count() == 0
    assert denylist.deny_scan(spark.createDataFrame([("p", "x")], "path string, text string"), "path", "text", []).count() == 0
    with pytest.raises(ValueError, match="unknown kinds"):
        denylist.Rules([("r", "regex", "x")])
