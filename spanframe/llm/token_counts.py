"""Token counts by greedy longest match, in time linear in the text.

A vocabulary of byte pieces becomes a trie whose nodes carry a failure link and
the number of pieces that following it pops. Matching then makes at most one
step down and amortised one failure step per byte, and only counts the popped
pieces; no piece is ever built.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A worker's memory of counted words is emptied at this many entries.
MEMO = 400_000
NONE = -1


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a .tiktoken file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """children: (node << 8 | byte) -> node; fail and pops by node; 0 is the root."""

    def __init__(self, pieces: list[bytes]):
        self.children, self.is_piece = {}, [False]
        parents = [(NONE, 0)]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if (child := self.children.get(key)) is None:
                    child = self.children[key] = len(self.is_piece)
                    self.is_piece.append(False)
                    parents.append((node, byte))
                node = child
            self.is_piece[node] = node != 0
        depth = [0] * len(parents)
        for node in range(1, len(parents)):  # parents come before their children
            depth[node] = depth[parents[node][0]] + 1
        self.fail, self.pops = [NONE] * len(parents), [0] * len(parents)
        for node in sorted(range(1, len(parents)), key=depth.__getitem__):
            up, byte = parents[node]
            if self.is_piece[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            # the longest piece that is a prefix is popped; what is left is looked up again
            at, popped = self.fail[up], self.pops[up]
            while at != NONE and (at << 8 | byte) not in self.children:
                popped, at = popped + self.pops[at], self.fail[at]
            if at != NONE:
                self.fail[node], self.pops[node] = self.children[at << 8 | byte], popped

    def count(self, word: bytes) -> int | None:
        """Pieces of ``word``; None if longest matches do not cover it."""
        children, fail, pops = self.children, self.fail, self.pops
        node = total = 0
        for byte in word:
            while (child := children.get(node << 8 | byte)) is None:
                total += pops[node]
                node = fail[node]
                if node == NONE:
                    return None
            node = child
        while node:
            total += pops[node]
            node = fail[node]
            if node == NONE:
                return None
        return total


class WordCounts(dict):
    """Word -> its number of pieces, counted once per distinct word.

    The word is matched with a space before it, as pieces that start a word
    have one. A word that the pieces do not cover counts as one unknown piece.
    """

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self.automaton.count(b" " + word)
        n = self[word] = 1 if n is None else n
        return n


def count_tokens(docs: DataFrame, vocabulary: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_tokens (long).

    Words are runs of characters other than ASCII white space; a text's count is
    the sum of its words'. ``vocabulary`` is the path of a .tiktoken file, read
    once on the driver; the automaton is broadcast and grows with the vocabulary
    alone. Null and empty texts count 0, a null key stays null, repeated rows are
    counted each, an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))

    def count(batches):
        counts = WordCounts(_automaton(vocabulary, sent))
        for batch in batches:
            words = [(t.as_py() or b"").split() for t in batch.column(1)]
            n = [sum(map(counts.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(n, pa.int64())], [key, "n_words", "n_tokens"])

    source = docs.select(key, F.col(text).cast("binary").alias("_text"))
    return source.mapInArrow(count, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_tokens long")


def _automaton(name: str, sent) -> Automaton:
    """The broadcast vocabulary's automaton, built once per worker."""
    if name not in _automaton.built:
        _automaton.built = {name: Automaton(sent.value)}
    return _automaton.built[name]


_automaton.built = {}
