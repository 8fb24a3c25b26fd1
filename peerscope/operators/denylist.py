"""Deny lists of any length over a table of texts: one automaton of all values, so the cost of a text doesn't grow with the list."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship

KINDS = ("exact-text", "casefold-text", "file-sha256", "path-fragment")
#: Hits that are put into one batch.
ROWS = 10_000


def folded(text: str) -> str:
    """Compatibility-composed and case-folded text, which Spark has no function for."""
    return text.casefold() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


class Values:
    """All values of one kind: a trie with failure links that finds those a text contains in one pass over it."""

    def __init__(self, values: Iterable[tuple[str, int]]):
        self.automaton, self.always = ahocorasick.Automaton(), []
        places = defaultdict(list)
        for value, place in values:
            places[value].append(place)
        for value, at in places.items():
            if value:
                self.automaton.add_word(value, at)
            else:
                self.always += at  # every text contains the empty one
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def inside(self, text: str | None) -> set[int]:
        if text is None:
            return set()
        found = set(self.always)
        if self.some:
            for _, at in self.automaton.iter(text):
                found.update(at)
        return found


class Rules:
    """Rules (id, kind, value) by kind; found by their place in the list."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        if unknown := {k for _, k, _ in rules} - set(KINDS):
            raise ValueError(f"unknown kinds of rules: {sorted(unknown)}")
        of = {kind: [(v, i) for i, (_, k, v) in enumerate(rules) if k == kind] for kind in KINDS}
        fold = lambda kind: [(folded(v), i) for v, i in of[kind]]
        self.exact, self.casefold, self.path = Values(of["exact-text"]), Values(fold("casefold-text")), Values(fold("path-fragment"))
        self.hashes = defaultdict(list)
        for v, i in of["file-sha256"]:
            self.hashes[v.lower()].append(i)
        self.kinds = {k for k in KINDS if of[k]}

    def broken(self, path: str | None, text: str | None) -> list[int]:
        found = self.exact.inside(text) if "exact-text" in self.kinds else set()
        if "casefold-text" in self.kinds and text is not None:
            found |= self.casefold.inside(folded(text))
        if "path-fragment" in self.kinds and path is not None:
            found |= self.path.inside(folded(path))
        if self.hashes and text is not None:
            found.update(self.hashes.get(hashlib.sha256(text.encode()).hexdigest(), ()))
        return sorted(found)


def deny_scan(files: DataFrame, path: str, text: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(path, rule_id, kind) of files that break a rule (id, kind, value): exact-text, casefold-text, file-sha256 or path-fragment.

    A file and a rule make one row however often the value occurs. The rules are sent to the executors once, and each task
    makes its automaton of them; a list is as long as people write it. A null text or path breaks no rule.
    """
    sc = files.sparkSession.sparkContext
    ship(sc)
    boxed = sc.broadcast(list(rules))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = boxed.value
        found, hits = Rules(listed), []
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits.extend((p, i) for i in found.broken(p, t))
                if len(hits) >= ROWS:
                    yield rows(hits, listed)
                    hits = []
        if hits:
            yield rows(hits, listed)

    def rows(hits: list[tuple], listed: list) -> pa.RecordBatch:
        columns = [[p for p, _ in hits], [listed[i][0] for _, i in hits], [listed[i][1] for _, i in hits]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)

    names = [path, "rule_id", "kind"]
    return files.select(F.col(path).cast("string"), F.col(text).cast("string")).mapInArrow(scan, f"`{path}` string, rule_id string, kind string")
