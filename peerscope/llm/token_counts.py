"""Token counts by a linear longest-match automaton.

A word is matched greedily: always the longest vocabulary piece at the current place. Instead of trying lengths, the
vocabulary's trie gets failure links: where no child fits, the pieces that greedy matching would have cut off by then
are already known, so their number is added and matching goes on at the link's node. Each byte is read once, whatever
the vocabulary, and no piece is built.

Pieces that begin a word carry a leading space in the vocabulary, so a word is matched with a space before it; words
are maximal runs outside space and 0x09-0x0D. The counts are those of greedy longest match over the given vocabulary,
not of its merge rules. Bytes that no piece covers count as one unknown piece for the whole word.

Defined results: null, empty and blank texts have no words and no tokens; repeated rows count alike; an empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow
from .features import Memo, raw_texts

#: A public vocabulary of byte pieces, one base64 piece and its rank per line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_pieces(spark: SparkSession, path: str) -> list[bytes]:
    """The pieces of a rank file, read by Spark so that any store will do; a vocabulary is of bounded size."""
    return [base64.b64decode(r.value.split()[0]) for r in spark.read.text(path).collect() if r.value.strip()]


class Automaton:
    """Trie over bytes with failure links and the number of pieces popped on following them."""

    def __init__(self, pieces: list[bytes]):
        self.child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    final.append(False)
                node = self.child[node][c]
            if node:
                final[node] = True
        # link[v]: node of what is left of v's string after greedy matching popped its pieces; -1 where none fits.
        self.link, self.pops = [-1] * len(self.child), [0] * len(self.child)
        queue = deque([(0, c, v) for c, v in self.child[0].items()])
        while queue:
            parent, c, v = queue.popleft()
            if final[v]:
                self.link[v], self.pops[v] = 0, 1
            else:
                z, popped = self.link[parent], self.pops[parent]
                while z > 0 and c not in self.child[z]:
                    popped += self.pops[z]
                    z = self.link[z]
                if z >= 0 and c in self.child[z]:
                    self.link[v], self.pops[v] = self.child[z][c], popped
            queue.extend((v, d, w) for d, w in self.child[v].items())

    def count(self, word: bytes) -> int:
        """Pieces of the word in greedy longest match; 1 for a word that the vocabulary can't cover."""
        node, total = 0, 0
        for c in b" " + word:
            while c not in self.child[node]:
                if node == 0 or self.link[node] < 0:
                    return 1
                total += self.pops[node]
                node = self.link[node]
            node = self.child[node][c]
        while node:
            if self.link[node] < 0:
                return 1
            total += self.pops[node]
            node = self.link[node]
        return total


def count_tokens(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text."""
    boxed = docs.sparkSession.sparkContext.broadcast(pieces)  # bounded by the vocabulary file

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(Automaton(boxed.value).count)
        for batch in batches:
            words, tokens = [], []
            for t in raw_texts(batch.column("text")):
                found = t.split()
                words.append(len(found))
                tokens.append(sum(map(memo.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), counted, f"doc_id {kind}, n_words long, n_tokens long")
