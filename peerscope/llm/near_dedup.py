"""Near duplicates: min-hash signatures joined by a multi-index Hamming search, links confirmed on full shingle sets.

A signature has CHUNKS x CHUNK symbols of 16 bits, each the low bits of one min-hash of the shingle set. Two signatures
that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols agree, by pigeonhole, in some chunk up to ERRORS symbols; so
every chunk is indexed under each choice of ERRORS symbols left out, and all pairs under that distance meet in a bucket.
At a similarity of exactly 0.75 a pair misses all buckets with a probability of 6e-6, at 0.8 with 1e-7.

Documents with equal sets form one class, and only the class goes on, so exact copies cost nothing. Links are found in
two passes over the classes that share a bucket with another:

1. In a bucket every class is paired with the smallest one (a star, not all pairs). Of these pairs, those whose signatures
   are near enough are confirmed on full sets. This only merges families early; nothing is lost by it.
2. Where the classes that share a centre are not all in one component after that, an exact prefix-filtered set join finds
   all links among them. Shingles are ordered by how many of these sets hold them, rarest first. Two sets that are
   similar enough share one of their first few shingles, so only these are joined, within bounds on length and position,
   between different components. Entries of a shingle are dealt out by bits of their component's number, so that members
   of one component never meet, however many they are; two components' members meet at the shingles that they share at
   the front, and bounds on length and position drop most of these pairs at once.

Every link is confirmed on full sets. A bucket is never expanded into its pairs, and pairs inside a component change
nothing.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; fewer than SHINGLE words
make one shingle; rows that share a doc_id but not a text are judged each by its own text, and a component's id is its
smallest doc_id; rows with a null doc_id are linked with nothing, with a null component, and kept; an empty table gives
an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_small, map_arrow
from .components import components
from .features import LOWER_ASCII, Memo, raw_texts

SHINGLE = 5
CHUNKS, CHUNK, ERRORS = 12, 5, 1
#: Similarity, as a fraction of integers: links have DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Signatures of sets at the threshold differ in 15 symbols on average. Pairs beyond NEAR wait for the exact join.
NEAR = 33
_K = CHUNKS * CHUNK


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = _mix(np.arange(1, 200, dtype=np.uint64)) | np.uint64(1)
_ADD = _mix(np.arange(1001, 1200, dtype=np.uint64))


def word_hashes() -> Memo:
    import xxhash

    return Memo(lambda w: xxhash.xxh64_intdigest(w))


def shingle_set(text: bytes, memo: Memo) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the whole text, given as UTF-8."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - SHINGLE + 1, 1)
    x = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        x = _mix(x + h[k : k + n] * _ODD[100 + k])
    return np.unique(x + np.uint64(min(len(h), SHINGLE)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """_K symbols of 16 bits; worked through in steps, so a huge set costs no more memory."""
    low = np.full(_K, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        part = shingles[a : a + 2048, None] * _ODD[None, :_K] + _ADD[None, :_K]
        part ^= part >> np.uint64(32)
        np.minimum(low, part.min(0), out=low)
    return (_mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, CHUNKS * CHUNK) keys: every chunk with each one of its symbols left out."""
    s = signatures.reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
    keys = []
    for drop in range(CHUNK):
        key = np.zeros(s.shape[:2], np.uint64)
        for j in range(CHUNK):
            if j != drop:
                key = (key << np.uint64(16)) | s[:, :, j]
        keys.append(_mix(key + _ADD[100 + drop + CHUNK * np.arange(CHUNKS)][None, :] * np.uint64(3)))
    return np.concatenate(keys, 1)


def set_digest(s: np.ndarray) -> bytes:
    return np.array([_mix(s).sum(), _mix(s ^ _ADD[150]).sum()], np.uint64).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, signature): the set's size, a 128-bit digest of it, and its symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            size, digest, sign = [], [], []
            for t in raw_texts(batch.column("text")):
                s = shingle_set(t, memo)
                size.append(len(s))
                digest.append(set_digest(s))
                sign.append(signature(s).tobytes() if len(s) else b"")
            columns = [*batch.columns[:2], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sign, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "digest", "signature"])

    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id long, text_hash long, n_shingles long, digest binary, signature binary")


def full_sets(wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the rows of wanted(node, digest, text) whose text has that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            sets = [shingle_set(t, memo) for t in raw_texts(batch.column("text"))]
            mine = np.array([set_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)], bool)
            sets = [s.view(np.int64) for s, m in zip(sets, mine, strict=True) if m]
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(pa.array(mine)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values))], ["node", "shingles"])

    return map_arrow(wanted.select("node", "digest", "text"), run, "node long, shingles array<long>")


def indexed(classes: DataFrame) -> DataFrame:
    """(key, node, n) for every bucket of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, _K)
                keys = bucket_keys(sign).view(np.int64)
                width = keys.shape[1]
                columns = [pa.array(keys.reshape(-1)), *[batch.column(c).take(pa.array(np.repeat(np.arange(batch.num_rows), width))) for c in ("node", "n")]]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "n"])

    return map_arrow(classes.select("signature", "node", "n"), run, "key long, node long, n long")


def may_link(n: str, m: str):
    """Sets whose sizes differ too much can't be similar enough."""
    return DEN * F.least(n, m) >= NUM * F.greatest(n, m)


def close_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(a, b) whose signatures differ in at most NEAR symbols."""
    sign = lambda c, out: classes.select(F.col("node").alias(c), F.col("signature").alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, _K) for c in ("s", "t"))
                yield batch.select(["a", "b"]).filter(pa.array((s != t).sum(1) <= NEAR))

    return map_arrow(pairs.join(sign("a", "s"), "a").join(sign("b", "t"), "b"), run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among pairs(a, b), by their full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").filter(DEN * both >= NUM * (F.size("x") + F.size("y") - both)).select("a", "b")


def unsettled(met: DataFrame, found: DataFrame) -> DataFrame:
    """(node, own) of the classes at centres whose classes are not all in one component; own is the class's component."""
    label = lambda c, out: found.select(F.col("node").alias(c), F.col("component").alias(out))
    members = cut(met.select("centre", "node").join(label("node", "o"), "node", "left").select("centre", "node", F.coalesce("o", "node").alias("own")))
    # The centre is a member too, though it is not listed as its own.
    centres = members.select("centre").distinct().join(label("centre", "h"), "centre", "left").select("centre", F.coalesce("h", "centre").alias("own"))
    mixed = members.select("centre", "own").unionByName(centres).groupBy("centre").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo < hi").select("centre")
    there = members.join(mixed, "centre").select("node", "own").unionByName(centres.join(mixed, "centre").select(F.col("centre").alias("node"), "own"))
    return there.distinct()


def links_across(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """All links between different components among nodes(node, own), by a prefix-filtered set join.

    Sets of a and b shingles, a <= b, are linked if they share at least NUM * (a + b) / (NUM + DEN), rounded up. As
    b >= a, the smaller set's first a - 2 * NUM * a / (NUM + DEN) + 1 shingles, rarest first, and as b <= a * DEN / NUM the
    larger one's first b - NUM * b / DEN + 1 have one in common.
    """
    up = lambda x, by: F.ceil(x / by).cast("long")
    rows = sets.join(nodes, "node").select("node", "own", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("f")).filter("f > 1")
    # A shingle of one set only needs no partner, just a place at the front: those that are shared follow all of them.
    shared = rows.join(often, "s")
    own = Window.partitionBy("node")
    ranked = shared.withColumn("i", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "s")) - 1)
    first = cut(ranked.filter(F.col("i") < F.col("n") - up(NUM * F.col("n"), DEN) + 1).select("s", "node", "own", "n", "i"))
    small = F.col("i") < F.col("n") - up(2 * NUM * F.col("n"), NUM + DEN) + 1
    sides = apart(first.withColumn("small", small))
    x, y = (sides.filter(F.col("bit") == k).select("s", "j", "above", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "n", "i", "small")]) for k, name in ((0, "x"), (1, "y")))
    lower = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y")))
    need = up(NUM * (F.col("n_x") + F.col("n_y")), NUM + DEN)
    rest = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y"))
    met = x.join(y, ["s", "j", "above"]).filter(F.when(lower, F.col("small_x")).otherwise(F.col("small_y")) & may_link("n_x", "n_y") & (rest >= need))
    pairs = met.groupBy("node_x", "node_y", "n_x", "n_y").agg(F.count("*").alias("c"), F.max("i_x").alias("i_x"), F.max("i_y").alias("i_y"))
    # Shared shingles so far, and all that could follow the last of them.
    pairs = pairs.filter(F.col("c") + rest - 1 >= need)
    return confirmed(pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")), sets)


def apart(first: DataFrame) -> DataFrame:
    """Entries of each shingle, dealt out so that only those of different components have the same (s, j, above) and not the same bit.

    A shingle's components are numbered. Two different numbers differ first, from the top, in one bit j, with the same bits
    above; so two entries meet once if their components differ and never if they don't, however many one component has. An
    entry goes out once for each bit, so a shingle that only one component holds has none.
    """
    own = first.select("s", "own").distinct()
    over = Window.partitionBy("s")
    own = own.withColumns({"r": F.row_number().over(over.orderBy("own")) - 1, "m": F.count("*").over(over)}).filter("m > 1")
    bits = first.join(own, ["s", "own"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("m") - 1)).cast("int") - 1)))
    return bits.withColumns({"bit": F.expr("shiftright(r, j) & 1"), "above": F.expr("shiftright(r, j + 1)")}).drop("r", "m", "own")


def near_duplicates(docs: DataFrame, inner: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept; with `inner` also text_hash and the component's node.

    A class's node is its smallest doc_id. Where a class with another text has that already, by rows that share an id, it
    is a hash of the set.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = cut(sketches(docs))
    full = sketched.filter("n_shingles > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "signature")).alias("r")
    classes = full.groupBy("digest", "n_shingles").agg(least).select("digest", F.col("n_shingles").alias("n"), F.col("r.doc_id").alias("rep"), F.col("r.signature").alias("signature"))
    classes = cut(classes.withColumn("node", F.col("rep")))
    twice = classes.groupBy("rep").agg(F.count("*").alias("c"), F.min(F.struct("digest", "n")).alias("one")).filter("c > 1").select("rep", "one")
    shares = not twice.isEmpty()
    if shares:
        other = F.col("one").isNotNull() & (F.struct("digest", "n") != F.col("one"))
        classes = cut(classes.join(twice, "rep", "left").withColumn("node", F.when(other, F.xxhash64("digest", "n")).otherwise(F.col("rep"))).drop("one"))
    index = indexed(classes)
    # Buckets of one class are dropped before the rest is joined to its centre.
    centres = index.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("many")).filter("many > 1").select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("m"))
    met = cut(index.join(centres, "key").filter("node != centre").groupBy("centre", "node").agg(F.first("n").alias("n"), F.first("m").alias("m")))
    pairs = met.filter(may_link("n", "m")).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    pairs = cut(close_signatures(pairs, classes))
    # Only texts that share a bucket are read again, for their sets.
    wanted = met.select(F.explode(F.array("node", "centre")).alias("node")).distinct()
    wanted = cut(classes.join(wanted, "node").select("node", F.col("rep").alias("doc_id"), "digest"))
    sets = cut(full_sets(join_small(docs, wanted, ["doc_id"])).dropDuplicates(["node"]))
    links = cut(confirmed(pairs, sets))
    found = cut(components(links))
    more = cut(links_across(cut(unsettled(met, found)), sets))
    if not more.isEmpty():
        found = cut(components(links.unionByName(more)))
    final = classes.join(found, "node", "left").select(F.col("digest").alias("d"), F.col("n").alias("k"), "rep", F.coalesce("component", "node").alias("node"))
    # Without shared ids a component's smallest node is its smallest id.
    final = final.drop("rep").join(final.groupBy("node").agg(F.min("rep").alias("c")), "node") if shares else final.drop("rep").withColumn("c", F.col("node"))
    out = sketched.join(cut(final), (F.col("digest") == F.col("d")) & (F.col("n_shingles") == F.col("k")) & F.col("doc_id").isNotNull(), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("c", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash", "node").withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *(["text_hash", "node"] if inner else []))
