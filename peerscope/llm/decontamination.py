"""Benchmark decontamination: a prefix-filtered join of documents with the windows of benchmark items.

A window is WINDOW consecutive words of an item, or the whole of a shorter one. A document contains a window only if it
contains the window's rarest shingle (two words; one for one-word items), so that shingle is the window's necessary prefix.

1. Items become windows, and windows shingles, in tasks. A bit map of the shingles, of bounded size, goes to the scan.
2. One scan of the documents counts those shingles, pre-aggregated by task. Counts are joined to the windows' shingles; a
   window takes its rarest one as prefix, and a window with a shingle that no document has is dropped.
3. Another scan, behind a bit map of the prefixes, emits the places of prefixes with the words around them. They are joined
   with windows on the prefix; the prefix's place bounds where the window starts and ends, which must lie in the document,
   and what is left is compared word by word.
4. Spans and items are put together per document text and joined back to the documents.

The benchmark never passes through the driver; the bit maps do, bounded by MOST_BITS. With more shingles than they can tell
apart more places are emitted and dropped in the join, and the result is the same. Words are compared by 64-bit hashes.

Defined results: null and wordless documents have no words and are clean; null, empty and wordless items have no
windows; items that repeat another's text are found with it; repeated documents are judged alike; null item ids take
part as the empty id; empty tables give clean or empty results. Only doc_id, text and item_id are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, cut, join_small, map_arrow, unused
from .features import Memo, raw_texts

WINDOW = 10
#: Bits per shingle of a bit map, and its least and largest size as powers of two: 8 KB and 32 MB.
BITS, LEAST_BITS, MOST_BITS = 64, 16, 28
#: Bytes of text that are matched at once, unless one text alone is longer.
STEP = 4 << 20
#: A-Z become a-z and ASCII other than digits and letters becomes space; bytes beyond ASCII stay in words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words before and after a prefix's first word that its window may reach.
_BEFORE, _AFTER = WINDOW - 2, WINDOW - 1


def word_hashes() -> Memo:
    """64-bit hashes of words; 0, which no word has, for the mark between texts."""
    import xxhash

    memo = Memo(lambda w: 0 if w == b"|" else xxhash.xxh64_intdigest(w) or 1)
    return memo


def steps(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def hashed(texts: list[bytes], memo: Memo) -> np.ndarray:
    """Hashes of the words of all texts, with a 0 after every text."""
    words = b" | ".join([*(t.translate(_WORDS) for t in texts), b""]).split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def pair_codes(h: np.ndarray) -> np.ndarray:
    """Code of the two-word shingle that starts at each word but the last."""
    return _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def single_codes(h: np.ndarray) -> np.ndarray:
    return _mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F))


def places(h: np.ndarray, bits: np.ndarray, singles: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the shingles of hashed texts that the bit map may hold."""
    shift, ask = np.uint64(63), np.uint64(len(bits) * 64 - 1)

    def held(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = codes & ask
        found = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & shift) & np.uint64(1)).astype(bool)
        return at[found], codes[found]

    both = np.flatnonzero((h[:-1] != 0) & (h[1:] != 0)) if len(h) else np.zeros(0, np.int64)
    at, codes = held(pair_codes(h)[both], both) if len(both) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if singles:
        one = np.flatnonzero(h)
        at1, codes1 = held(single_codes(h[one]), one)
        at, codes = np.concatenate([at, at1]), np.concatenate([codes, codes1])
    return at, codes


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, words, codes) of every window of every item: hashes of its words and codes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), raw_texts(batch.column("text")), strict=True):
                h = hashed([text], memo)[:-1]
                size = min(len(h), WINDOW)
                every = np.lib.stride_tricks.sliding_window_view(h, size) if size else np.zeros((0, 1), np.uint64)
                for a in range(0, len(every), 50_000):
                    some = every[a : a + 50_000]
                    codes = single_codes(some) if size == 1 else np.stack([pair_codes(x) for x in some])
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).view(np.int64).reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (some, codes)]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), *lists], ["item", "words", "codes"])

    return map_arrow(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"), run, "item string, words array<long>, codes array<long>")


def bit_map(codes: DataFrame) -> np.ndarray:
    """The codes (column code) as bits of 64-bit numbers; or-ed together by word of the map before they reach the driver."""
    n = codes.count()
    size = 1 << min(max((n * BITS - 1).bit_length(), LEAST_BITS), MOST_BITS)
    slot = F.col("code").bitwiseAND(F.lit(size - 1))
    rows = codes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(code & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def shingle_counts(docs: DataFrame, bits: np.ndarray, singles: bool) -> DataFrame:
    """(code, n): how often each shingle in the bit map occurs in all documents; few others come along."""
    boxed = docs.sparkSession.sparkContext.broadcast(bits)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for a, b in steps(texts):
                codes, n = np.unique(places(hashed(texts[a:b], memo), boxed.value, singles)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

    return map_arrow(docs.select("text"), counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def prefix_places(docs: DataFrame, bits: np.ndarray, singles: bool) -> DataFrame:
    """(id, hash, code, at, n, around): places in documents of n words that may be prefixes, and the words around them."""
    boxed = docs.sparkSession.sparkContext.broadcast(bits)
    width = _BEFORE + 1 + _AFTER

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for a, b in steps(texts):
                h = hashed(texts[a:b], memo)
                ends = np.flatnonzero(h == 0)
                starts = np.concatenate([[0], ends[:-1] + 1])
                at, codes = places(h, boxed.value, singles)
                row = np.searchsorted(ends, at)
                padded = np.concatenate([np.zeros(_BEFORE, np.uint64), h, np.zeros(_AFTER, np.uint64)])
                around = padded[at[:, None] + np.arange(width)[None, :]].view(np.int64)
                kept = [batch.column(c).take(pa.array(a + row)) for c in ("id", "hash")]
                new = [pa.array(codes.view(np.int64)), pa.array(at - starts[row]), pa.array((ends - starts)[row]), pa.FixedSizeListArray.from_arrays(pa.array(around.reshape(-1)), width).cast(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*kept, *new], ["id", "hash", "code", "at", "n", "around"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text"), found, f"id {kind}, hash long, code long, at long, n long, around array<long>")


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, hash, wid, start, size): all windows(wid, words, codes) in all documents, once per document text."""
    singles = not windows.filter(F.size("words") == 1).isEmpty()
    shingles = windows.select("wid", F.posexplode("codes").alias("place", "code"))
    counts = shingle_counts(docs, bit_map(shingles.select("code").distinct()), singles)
    rarest = shingles.join(counts, "code", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "code", "place")).alias("p")).filter("p.n > 0")
    prefixes = cut(rarest.select("wid", "p.code", "p.place").join(windows.select("wid", "words"), "wid"))
    spots = prefix_places(docs, bit_map(prefixes.select("code").distinct()), singles)
    start, size = F.col("at") - F.col("place"), F.size("words")
    same = F.slice("around", F.lit(_BEFORE + 1) - F.col("place"), size) == F.col("words")
    return spots.join(prefixes, "code").filter((start >= 0) & (start + size <= F.col("n")) & same).select("id", "hash", "wid", start.alias("start"), size.alias("size")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mark: str | None = None) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence), n_items, items_sha256, items and contaminated.

    With `mark`, only contaminated is added, under that name. Columns of these names are replaced.
    """
    docs = docs.drop(*([mark] if mark else ["n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"]))
    named = [F.col(f"`{c}`") for c in docs.columns]
    every = cut(item_windows(benchmark).withColumn("wid", F.xxhash64("words")))
    windows = cut(every.groupBy("wid").agg(F.first("words").alias("words"), F.first("codes").alias("codes")))
    hits = cut(occurrences(docs.select("doc_id", "text"), windows))
    # Keys of a text in the documents: its id, null or not, and its hash.
    key = [F.col("id").isNull().alias("none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), "hash"]
    hits = hits.select(*key, "wid", "start", "size")
    by = ["none", "name", "hash"]
    if mark:
        found = hits.select(*by).distinct().withColumn("yes", F.lit(True))
    else:
        before = Window.partitionBy(*by).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("start") + F.col("size")
        spans = hits.select(*by, "start", "size").distinct().withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(0)))
        covered = spans.groupBy(*by).agg(F.sum(F.greatest(end - F.greatest("start", "reach"), F.lit(0))).cast("long").alias("hit"))
        items = hits.select(*by, "wid").distinct().join(every.select("wid", "item").distinct(), "wid").groupBy(*by).agg(F.sort_array(F.collect_set("item")).alias("in_items"))
        found = covered.join(items, by)
    found = cut(found)
    names = {c: unused(docs, f"key_{c}") for c in by}
    found = found.select(*[F.col(c).alias(names.get(c, unused(docs, f"found_{c}"))) for c in found.columns])
    keyed = docs.withColumns({names["none"]: F.col("doc_id").isNull(), names["name"]: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), names["hash"]: F.xxhash64("text")})
    joined = join_small(keyed, found, list(names.values()), "left")
    of = lambda c: F.col(unused(docs, f"found_{c}"))
    if mark:
        return joined.select(*named, F.coalesce(of("yes"), F.lit(False)).alias(mark))
    listed = F.coalesce(of("in_items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(of("hit"), F.lit(0).cast("long"))
    return joined.select(
        *named, F.regexp_count(body(), F.lit(_TERM)).cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), listed.alias("items"), (n_hit > 0).alias("contaminated"),
    )
