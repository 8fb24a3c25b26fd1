"""Corpus operators on tables: WARC round trip, mixing, classifiers, the pipeline and the query contracts."""

import base64
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerscope.llm import mixing, quality_gam, queries, toxicity, warc


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é</p>", "", None, "dup", "dup", "x" * 100_000, "dup", "\r\n\r\nWARC/1.1\r\n"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", t, 1) for i, t in enumerate(html)] + [(3, "http://h/3", "dup", 1), (None, "u", "dup", 1)], "page_id long, url string, html string, record_type int")
    path = f"file://{tmp_path}/archive"
    warc.write_pages(pages.repartition(3), path)
    rows = warc.read_warc(spark, path).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.record_id].append(r)
    assert len(rows) == 10 and len(by["<urn:page:3>"]) == 2 and all(r.record_type == "response" for r in by["<urn:page:3>"])
    for i, t in enumerate(html):
        r, raw = by[f"<urn:page:{i}>"][0], (t or "").encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = min(j for j, u in enumerate(html) if (u or "") == (t or ""))
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", f"<urn:page:{first}>"))
        assert r.payload == (raw if first == i else None)
    assert by["<urn:page:>"][0].refers_to == "<urn:page:3>"


def test_warc_pushdown_and_skipping(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    pages = spark.createDataFrame([(i, f"http://h/{i % 3}/{i}", f"page {i % 5}") for i in range(40)], "page_id long, url string, html string")
    warc.write_pages(pages, path)
    df = warc.read_warc(spark, path, payload=False).filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://h/1/"))
    assert sorted(r.target_uri for r in df.collect()) == sorted(f"http://h/{i % 3}/{i}" for i in range(5, 40) if i % 3 == 1)
    reader = warc.Reader({"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.StringStartsWith(("target_uri",), "http://h/1/")])) == []
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == df.count()
    assert all(r.payload is None for r in df.collect())
    part = warc.Reader({"path": path}).partitions()
    assert sum(p.end - p.start for p in part) > 0 and all(os.path.exists(p.path) for p in part)


def test_warc_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(empty, f"file://{tmp_path}/empty")
    assert warc.read_warc(spark, f"file://{tmp_path}/empty").count() == 0
    same = spark.createDataFrame([(2, "u", "ab"), (1, "u", "ab"), (4, "u", "abc"), (3, "u", "abc")], "page_id long, url string, html string")
    rows = {r.page_id: r.record_type for r in warc.records(same, min_bytes=3).collect()}
    assert rows == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_warc_reads_foreign_and_compressed_files(spark, tmp_path):
    import gzip

    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:a>\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:b>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 25\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody!!\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    rows = Counter((r.record_id, bytes(r.payload)) for r in warc.read_warc(spark, f"file://{tmp_path}").collect())
    assert rows == Counter({("<urn:a>", b"hello"): 2, ("<urn:b>", b"body!!"): 2})


def test_warc_skips_what_is_malformed(spark, tmp_path):
    import gzip

    def record(name, body=b"x", length=None, kind=b"resource", extra=b""):
        return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:" + name + b">\r\n" + extra + b"Content-Length: " + (str(len(body)).encode() if length is None else length) + b"\r\n\r\n" + body + b"\r\n\r\n"

    http = b"Content-Type: application/http\r\n"
    parts = {
        "a": record(b"1") + record(b"bad", length=b"many") + record(b"2") + record(b"worse", length=b"-5") + record(b"3", b"") + b"noise\r\n\r\n" + record(b"4", b"WARC/"),
        "b": record(b"5") + record(b"cut", b"abc", length=b"999999"),
        "c": record(b"6") + record(b"7", b"HTTP/1.1 200 OK\r\nContent-Length: \xff\r\n\r\n", kind=b"revisit", extra=http) + record(b"no-http", b"zz", extra=http) + record(b"8"),
        "d": record(b"9") + b"WARC/1.0\r\nWARC-Type: res",
        "e": b"",
        "f": record(b"no-length").replace(b"Content-Length: 1\r\n", b"") + record(b"10"),
    }
    for name, raw in parts.items():
        (tmp_path / f"{name}.warc").write_bytes(raw)
    whole = gzip.compress(record(b"11")) + gzip.compress(record(b"12", os.urandom(3000)))
    (tmp_path / "g.warc.gz").write_bytes(whole[:-900])
    (tmp_path / "h.warc.gz").write_bytes(b"not gzip at all")
    found = {payload: sorted(int(r.record_id[5:-1]) for r in warc.read_warc(spark, f"file://{tmp_path}", payload).collect() if r.record_id[5:-1].isdigit()) for payload in (True, False)}
    assert found[True] == found[False] == list(range(1, 12))
    assert not {r.record_id for r in warc.read_warc(spark, f"file://{tmp_path}").collect()} & {"<urn:cut>", "<urn:bad>", "<urn:worse>", "<urn:no-length>"}


def test_warc_decides_alike_without_broadcasts(spark, monkeypatch):
    rows = [(i % 70 if i % 9 else None, "u", None if i % 5 == 0 else f"t{i % 13}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    small = Counter(map(tuple, warc.records(pages).collect()))
    monkeypatch.setattr("peerscope.llm.common.BROADCAST_ROWS", 1)
    assert Counter(map(tuple, warc.records(pages).collect())) == small
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = Counter((i, "response", None) if i == first[t or ""] else (i, "revisit", first[t or ""]) for i, _, t in rows)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in small.elements() for r in [warc_row(r)]) == want


def warc_row(r):
    from types import SimpleNamespace

    return SimpleNamespace(page_id=r[0], record_type=r[2], refers_to=r[3])


def mix_frame(spark, rows):
    return spark.createDataFrame([(i, " ".join(["w"] * n) if n is not None else None, s, 1, 2) for i, n, s in rows], "doc_id long, text string, source string, size int, target int")


def waterfill(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed, rest = sum(sizes.values()), {}, set(names)
    while rest:
        level = (total - sum(fixed.values())) / sum(w[s] for s in rest)
        over = [s for s in rest if level * w[s] > repeats * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in rest}
        for s in over:
            fixed[s] = repeats * sizes[s]
            rest.discard(s)
    return fixed


@pytest.mark.parametrize("shard_rows", [5, 4096])
def test_mixing(spark, shard_rows):
    rnd = np.random.default_rng(5)
    rows = [(i, int(rnd.integers(0, 60)), rnd.choice(["b", "B", "é", "a", "zz", "hot", "hot", "hot"])) for i in range(600)] + [(601, 7, None), (602, None, "a"), (603, 0, "none"), (604, 1, "tiny"), (5, 9, "a"), (5, 9, "a")]
    out = mixing.mix(mix_frame(spark, rows), shard_rows=shard_rows)
    got = out.collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, out.collect()))
    source = {i: s for i, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    targets = waterfill(dict(sizes))
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(targets[source[r.doc_id]])
    assert all(abs(taken[s] - targets[s]) <= max(1, 0.01 * targets[s]) for s in sizes)


def test_mixing_keeps_small_sources_of_large_tables(spark):
    # Ten million words in all: small sources come near their targets as they do in a small table.
    sizes = {"a": [3_000_000] * 3, "b": [400_000] * 3, "c": [1], "d": [2, 3], "e": [40] * 5}
    rows = [(10 * k + i, n, s) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    docs = spark.createDataFrame(rows, "doc_id long, n int, source string").selectExpr("doc_id", "repeat('w ', n) text", "source")
    source, taken = {i: s for i, _, s in rows}, defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[source[r.doc_id]] += r.taken
    targets = waterfill({s: sum(ns) for s, ns in sizes.items()})
    assert min(targets.values()) == 3 and all(abs(taken[s] - t) <= 1 for s, t in targets.items()), (taken, targets)


def test_mixing_by_blocks_of_some_words(spark):
    rows = [(i, 30, "ab"[i % 2]) for i in range(200)]
    taken, source = defaultdict(int), {i: s for i, _, s in rows}
    for r in mixing.mix(mix_frame(spark, rows), block=7).collect():
        taken[source[r.doc_id]] += r.taken
    targets = waterfill({"a": 3000, "b": 3000})
    assert all(taken[s] % 7 == 0 and abs(taken[s] - t) <= 7 for s, t in targets.items())


@pytest.mark.parametrize("block", [1, 40, 2_000])
def test_mixing_by_blocks_far_larger_than_a_shard(spark, block):
    rnd = np.random.default_rng(block)
    rows = [(i, int(rnd.integers(1, 200)), "abc"[i % 3]) for i in range(3000)]
    sizes, taken, source = defaultdict(int), defaultdict(int), {i: s for i, _, s in rows}
    for _, n, s in rows:
        sizes[s] += n
    for r in mixing.mix(mix_frame(spark, rows), block=block, shard_rows=5).collect():
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    targets = waterfill(dict(sizes))
    assert all(abs(taken[s] - t) <= max(0.01 * t, block) for s, t in targets.items()) and (block > 40 or all(abs(taken[s] - t) <= 0.01 * t for s, t in targets.items()))


def test_mixing_of_empty_and_wordless_tables(spark):
    assert mixing.mix(mix_frame(spark, [])).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.mix(mix_frame(spark, [(1, None, None), (2, 0, "a")])).collect()] == [(0, 0.0, 0)] * 2


def test_sainte_lague(spark):
    shares = [53.0, 24.0, 23.0, 0.0, 1e-9, 7.5, 7.5]
    df = spark.createDataFrame([(i, s, 1, 37) for i, s in enumerate(shares)], "k long, share double, g int, seats int")
    got = {r.k: r.won for r in mixing.sainte_lague(df, ["g"], "share", "seats", "k", "won").collect()}
    best = sorted(((s / (2 * j + 1), -i) for i, s in enumerate(shares) for j in range(40)), reverse=True)[:37]
    assert got == {i: sum(-k == i for _, k in best) for i in range(len(shares))}


def test_quality_model_learns_an_interaction():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.Additive().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    assert {0, 1} in [{j, k} for j, k, *_ in model.pair_tables]


def test_trees_and_isotonic():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(3000, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(float)
    trees = toxicity.Trees().fit(x[:2000], y[:2000])
    assert ((trees.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    knots, level = toxicity.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 0, 1, 1.0]))
    assert np.all(np.diff(level) >= 0) and level[0] < 0.5 < level[-1] and np.all(np.diff(knots) >= 0)


CLEAN = "the quiet river runs past green hills and small towns where people walk slowly in the evening light"


@pytest.mark.parametrize("operator,label", [(quality_gam, "quality"), (toxicity, "toxic")])
def test_classifiers_on_edge_tables(spark, operator, label):
    docs = spark.createDataFrame([(0, None, 9.0), (1, "", 9.0), (2, " \n", 9.0), (3, "é" * 3000, 9.0), (3, "é" * 3000, 9.0), (None, "a b", 9.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in operator.score(docs, operator.fit(docs, none)).collect()} == {0.5}
    rows = operator.score(docs, operator.fit(docs, one)).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id == 3}) == 1 and all(0.5 <= r.score <= 1 for r in rows)
    assert operator.score(docs.limit(0), operator.fit(docs, one)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rnd = np.random.default_rng(9)
    words, bad = CLEAN.split(), ["idiotface", "moronix", "scumbag", "trashman"]

    def text(toxic):
        w = [rnd.choice(words) + str(rnd.integers(50)) for _ in range(60)]
        for _ in range(3 * toxic):
            w[rnd.integers(60)] = f"you {rnd.choice(bad)}"
        return " ".join(w)

    rows = [(i, text(i % 6 == 0), int(i % 6 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(scored[i] >= 0.5, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(p == bool(y) for p, y in held) / len(held) > 0.97


COLUMNS = {
    "op1_quality_classifier": ["doc_id", "held_out", "score", "predicted"], "op2_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op3_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"], "op5_token_counts": ["doc_id", "n_words", "n_tokens"], "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op8_lm_scoring": ["doc_id", "n_words", "log_score", "mean_log_score"],
    "op9_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_contract(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    table = "pages" if name == "op2_warc" else "documents"
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert df.count() == spark.read.parquet(f"{data}/{table}.parquet").count()


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES:
        out = stage(spark, docs, data)
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and (name == "mixing" or out.columns == docs.columns)
        if name == "near_dedup":
            judged = {r.doc_id for r in queries.near_dedup.near_duplicates(docs).filter("kept").collect()}
            assert now == judged
        if name == "decontamination":
            marked = queries.decontamination.decontaminate(docs, spark.read.parquet(f"{data}/benchmark.parquet"))
            assert ids - now == {r.doc_id for r in marked.filter("contaminated").collect()}
        if name == "pii":
            assert now == ids and not out.filter(F.col("text").rlike(r"[a-z]+\.[0-9]{2}@mail[0-9]\.example\.com")).count()
        docs, ids = spark.createDataFrame(out.collect(), out.schema), now
    assert docs.filter("taken <= 0").count() == 0


def test_near_copy_stage_drops_repeated_rows(spark, data):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (None, "a b c d e"), (3, None)], "doc_id long, text string")
    assert Counter(r.doc_id for r in p.drop_near_copies(spark, docs, data).collect()) == Counter({1: 1, None: 1, 3: 1})


def test_near_copy_stage_keeps_other_texts_of_an_id(spark, data):
    import corpus_pipeline as p

    a, b, c = "a b c d e f g", "p q r s t u v", "k l m n o p q"
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (4, a), (5, c), (5, c), (5, c.upper()), (7, c), (None, c), (9, ""), (9, "")], "doc_id long, text string")
    rows = Counter((r.doc_id, (r.text or "").lower()) for r in p.drop_near_copies(spark, docs, data).collect())
    assert rows == Counter({(3, b): 1, (4, a): 1, (5, c): 1, (None, c): 1, (9, ""): 1})


def test_pipeline_stages_on_empty_tables_and_clashing_names(spark, data):
    import corpus_pipeline as p

    text = "the quiet river runs past green hills 4111 1111 1111 1111 token = 'cb1a9fee807a05366fcb8b6c95c7c565ede51a72'"
    clash = "toxic_score int, contaminated string, text_was int, row_id int, row_text int, spans int, rank int, `__k` int, `__carry` int, size int, taken int, `a b` int, node int, kept int, score int, `__pii` int, `__words` int, n int"
    rows = [(i, t, "en", s, 5, *["7" if "string" in c else 7 for c in clash.split(", ")]) for i, t, s in [(1, text, "s"), (2, None, None), (None, "x", "s"), (3, "", "t"), (4, text, "s"), (5, "w " * 100_000, "t")]]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    for kept in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, kept, data)
            if name != "mixing":
                assert out.columns == docs.columns
            found = out.collect()
            assert all(r["a b"] == 7 and r["__k"] == 7 and r["contaminated"] == "7" and r["rank"] == 7 for r in found)
            kept = spark.createDataFrame(found, out.schema)
        got = {r.doc_id: (r.text, r.taken) for r in kept.collect()}
        assert not got or (4 not in got and got[5][1] > 0 and "<CARD>" in got[1][0] and "<SECRET>" in got[1][0])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_reference_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    found = con.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted(found.fetchall(), key=key)
