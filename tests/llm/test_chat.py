"""Reply trees and conversations against a walk in Python, and the exact round trip of the template."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from peerscope.llm import chat, queries

SCHEMA = "tree_id string, message_id long, parent_id long, role string, text string, score double"


def escaped(t, role=False):
    t = (t or "").replace("\\", "\\b").replace("<", "\\l")
    return t.replace("\n", "\\n") if role else t


def written(turns):
    return "".join(f"<turn>{escaped(r, True)}\n{escaped(t)}</turn>\n" for r, t in turns)


def brute(rows, branches):
    by = defaultdict(dict)
    for tree, i, parent, role, text, score in rows:
        at = by[tree].setdefault(i, [[], [], []])
        at[0].append(parent if parent != i else None), at[1].append(score or 0.0), at[2].append((role or "", text or ""))
    out = {}
    for tree, nodes in by.items():
        up = {i: min((p for p in a[0] if p is not None), default=None) for i, a in nodes.items()}
        up = {i: p if p in nodes else None for i, p in up.items()}
        paths = []
        for leaf in set(nodes) - {p for p in up.values() if p is not None}:
            path, i = [leaf], up[leaf]
            while i is not None and i not in path:
                path.append(i)
                i = up[i]
            if i is None:
                paths.append((-sum(max(nodes[x][1]) for x in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(paths, key=lambda p: (round(p[0], 9), p[1]))[:branches]):
            out[tree, leaf] = (rank + 1, len(path), written([min(nodes[x][2]) for x in path]))
    return out


@pytest.mark.parametrize("branches", [1, 3, None])
def test_trees(spark, branches):
    r = random.Random(7)
    rows = []
    for tree in ["a", "b", None, "deep", "star"]:
        for i in range(70):
            parent = None if i == 0 else i - 1 if tree == "deep" else 0 if tree == "star" else r.randint(0, i - 1)
            rows.append((tree, i, parent, r.choice(["user", "assistant", None]), r.choice(["x", "", None, "<turn>\\l", "é\n</turn>\n"]), r.choice([None, 1.0, 2.0, 0.5])))
    rows += [("b", 200, 999, "user", "orphan", 9.0), ("b", 201, 201, "user", "own parent", 9.0), ("b", 300, 301, "user", "cycle", 9.0), ("b", 301, 300, "user", "cycle", 9.0), ("b", 302, 301, "user", "hangs on it", 9.0)]
    rows += rows[:20] + [("a", 5, 0, "zz", "another text of one id", 7.0), ("none", None, None, "user", "no id", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit(1)).withColumn("branch", F.lit("x"))
    got = {(x.tree, x.leaf): (x.branch, x.n_turns, x.formatted) for x in chat.format_trees(df, branches=branches).collect()}
    assert got == brute(rows, branches)
    assert chat.format_trees(df.limit(0)).count() == 0


def test_round_trip_and_mask(spark):
    texts = ["", None, "\\", "\\\\l", "<", "\\l\\b\\n", "</turn>\n", "<turn>assistant\n", "🙂é\n\n", "a" * 10_000 + "🙂<" * 3_000, "\r\n\x00"]
    rows = [(c, i, "assistant" if (i + c) % 2 else f"ro\\n<le\n{i}", t) for c in range(2) for i, t in enumerate(texts)] + [(9, None, None, "x"), (None, 0, "assistant", "y"), (5, 1, "user", None)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3))
    made = made.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in made.collect()}
    for conv in (0, 1, 9, None, 5):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert [tuple(x) for x in got[conv].back] == own and got[conv].formatted == written(own)
        assert got[conv].learned == "".join(t for r, t in own if r == "assistant") and got[conv].n_turns == len(own)
        assert [got[conv].formatted[s.start : s.start + s.length] for s in got[conv].loss_spans] == [escaped(t) for r, t in own if r == "assistant"]


def test_long_conversations_repeats_and_ties(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(500)] * 2 + [(2, 1, "user", "b"), (2, 1, "assistant", "a"), (2, 0, "system", "s")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got[1].n_turns == 500 and got[1].formatted == written([r[2:] for r in rows[:500]])
    assert got[2].formatted == written([("system", "s"), ("assistant", "a"), ("user", "b")])


def test_marks_are_checked():
    with pytest.raises(ValueError):
        chat.Template(opening="[turn]")
    with pytest.raises(ValueError):
        chat.Template(closing="</turn><")


def test_query(spark, data):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{data}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn, r.role, r.text or ""))
    by[-7] = [(0, "user", r"\### Assistant: </turn> ok"), (1, "assistant", r"\### Assistant: </turn> ok")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for conv, turns in by.items():
        turns = [t[1:] for t in sorted(turns)]
        learned = "".join(t for r, t in turns if r == "assistant")
        want.add((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(written(turns))))
    assert {tuple(r) for r in queries.op13_chat_formatting(spark, data).collect()} == want
