"""The two classifiers' features and scores against plain loops over their definitions, whole texts included."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from peerscope.llm import quality_gam, toxicity

SPACES = " \t\v\f\r\n"


def sample_texts():
    r = random.Random(11)
    pieces = ["The", "you", "YOU!", "d*mn", "b.a.d", "dumm", "Idiot,", "idiotic", "été", "日本語", "naïve", "x", "42", "#$%", "a-b", "tu", "?!", "no.", "\x00", "é"]
    out = [None, "", " ", "\n\n", "a", "a b", "same same same same", "l\nl\nl\n\n x \n x "]
    for n in (1, 3, 30, 400):
        out += ["".join(r.choice(pieces) + r.choice([" ", " ", "\n", "\t", "  "]) for _ in range(n)) for _ in range(12)]
    return out


def count(text, chars):
    return sum(text.count(c) for c in chars)


def slow_quality(text):
    """Letters beyond ASCII are bytes that lead a character; words are those of str.split, but n_words splits at ASCII space only."""
    t = text or ""
    words, split = [w for w in re.split("[\x20\x09-\x0d]+", t) if w], t.split()
    upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    lead = sum(ord(c) > 127 for c in t)
    letters, size = max(upper + lower + lead, 1), max(len(t), 1)
    stops, shouts, breaks = count(t, ".,;:"), count(t, "!?"), t.count("\n")
    lines = [x for x in t.split("\n") if x.strip()]
    return [
        math.log1p(len(t)), math.log1p(len(words)), (len(t) - count(t, SPACES)) / max(len(words), 1), upper / letters, sum("0" <= c <= "9" for c in t) / size, count(t, "#*$%&|<>") / size, stops / size, shouts / size, lead / letters, breaks / size,
        sum(len(w) <= 3 for w in split) / len(split) if split else 0, len(set(split)) / len(split) if split else 0, len({tuple(split[i : i + 3]) for i in range(len(split) - 2)}) / max(len(split) - 2, 1) if split else 0,
        1 - len(set(lines)) / max(len(lines), 1) if split else 0, len(words) / (stops + shouts + 1), count(t, "\"'()+-/=@[]\\^_`{}~") / size,
    ]


def slow_toxicity(text, lexicon):
    t = text or ""
    split, n_words = t.split(), len([w for w in re.split("[\x20\x09-\x0d]+", t) if w])
    hit, strong, second, hidden = [], 0, [], 0
    for i, w in enumerate(split):
        b = re.sub(r"^[\W_]+|[\W_]+$", "", w.lower())
        forms = {b, *(b[:k] + "*" for k in (4, 5) if len(b) > k)} if len(b) > 2 else set()
        hit += [i] * bool(forms & lexicon)
        strong += b in lexicon
        second += [i] * (b in toxicity.SECOND_PERSON)
        hidden += bool(re.search(r"[^\W\d_][*@$!0-9_.-]+[^\W\d_]", b)) and len(re.sub(r"[*@$!0-9_.-]", "", b)) > 2
    places = set(second)
    near = sum(any(i + d in places for d in range(-4, 5)) for i in hit)
    n, size = max(len(split), 1), max(len(t), 1)
    upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    return [math.log1p(len(hit)), len(hit) / n, strong / n, near / n, len(second) / n, math.log1p(near), upper / max(upper + lower, 1), count(t, "!?") / size, count(t, ".,;:") / size, count(t, "#*$%&|<>") / size, hidden / n, math.log1p(n_words)]


LEXICON = frozenset(["idiot", "dumm", "idio*", "b.a.d", "d*mn"])


@pytest.mark.parametrize("fast,slow", [(quality_gam.features, slow_quality), (lambda t: toxicity.features(t, LEXICON), lambda t: slow_toxicity(t, LEXICON))])
def test_features_are_those_of_plain_loops(fast, slow):
    texts = sample_texts()
    assert fast(pa.array(texts)) == pytest.approx(np.array([slow(t) for t in texts]), abs=1e-12)
    long = "You IDIOT, é\n dumm. " * 50_000  # 200,000 words: whole texts count, and steps of the byte counts don't show
    assert fast(pa.array(["x", long, "y"]))[1] == pytest.approx(slow(long), abs=1e-12)


def training(n=600):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, 5))
    return x, ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) | (x[:, 2] > 1.5)).astype(float)


def test_additive_scores_are_sums_of_table_entries():
    x, y = training()
    model = quality_gam.Additive(rounds=15, pair_rounds=8, pairs=3).fit(x, y)
    for row, got in zip(x[:80], model.score(x[:80])):
        bins = [sum(c < v for c in cuts) for v, cuts in zip(row, model.cuts)]
        margin = model.start + sum(table[b] for table, b in zip(model.tables, bins)) + sum(t[dj[bins[j]], dk[bins[k]]] for j, k, dj, dk, t in model.pair_tables)
        assert got == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)
    assert ((model.score(x) > 0.5) == y).mean() > 0.85


def test_tree_scores_are_sums_of_leaves_and_calibration_is_the_best_monotone_fit():
    x, y = training()
    trees = toxicity.Trees(rounds=12).fit(x, y)

    def leaf(tree, row):
        while isinstance(tree, tuple):
            j, cut, left, right = tree
            tree = left if row[j] <= cut else right
        return tree

    margin = trees.margin(x)
    assert margin[:80] == pytest.approx(np.array([trees.start + sum(leaf(t, row) for t in trees.trees) for row in x[:80]]), abs=1e-12)
    knots, level = toxicity.isotonic(margin, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(level) >= 0).all()
    # Pooled blocks: the max-min formula of the least-squares monotone fit gives the same means.
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], y[order]
    firsts, lasts = [i for i in range(len(m)) if i == 0 or m[i] > m[i - 1]], [i for i in range(len(m)) if i + 1 == len(m) or m[i + 1] > m[i]]
    sums = np.concatenate([[0], np.cumsum(t)])
    for i in range(0, len(m), 37):
        best = max(min((sums[b + 1] - sums[a]) / (b + 1 - a) for b in lasts if b >= i) for a in firsts if a <= i)
        k = int(np.flatnonzero((knots[::2] <= m[i]) & (m[i] <= knots[1::2]))[0])
        inside = (m >= knots[2 * k]) & (m <= knots[2 * k + 1])
        assert t[inside].mean() == pytest.approx(best, abs=1e-12)
    model = toxicity.Model(LEXICON, trees, knots, level, 0.5)
    assert (np.diff(model.score(x)[order]) >= -1e-12).all()
