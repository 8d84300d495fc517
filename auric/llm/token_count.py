"""Token counts by a linear longest-match automaton (operator 6).

Greedy word pieces: a word is split into the longest vocabulary piece at its
start, then the longest continuation pieces; a word that cannot be split whole
counts as one unknown token. The pieces are never built. The vocabulary is a
trie; where it has no edge for the next character, the failure link of the
node goes to the node of what is left after the pieces that greedy matching
would cut off there, and the link carries how many pieces those are. A word is
then one walk, linear in its length, that adds up the counts.

Counts per distinct word are kept in a bounded table per worker. One pass,
without a shuffle.

Defined results: null or empty text has 0 tokens; repeated rows and null ids
give one row each; an empty table an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_batches, text_of

NONE = -1  # no node: the word is unknown from here on


class Automaton:
    """``starts`` are pieces that begin a word, ``parts`` pieces that go on."""

    def __init__(self, starts: Iterable[str], parts: Iterable[str], table_rows: int = 400_000):
        self.edges: list[dict[str, int]] = [{}, {}]  # node 0: word start, node 1: after a piece
        ends = {}
        depth = [0, 0]
        for root, pieces in ((0, starts), (1, parts)):
            for p in pieces:
                node = root
                for c in p:
                    nxt = self.edges[node].get(c)
                    if nxt is None:
                        nxt = self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        depth.append(depth[node] + 1)
                    node = nxt
                if p:
                    ends[node] = True
        n = len(self.edges)
        self.fail, self.pops = [NONE] * n, [0] * n
        queue = deque([(0, NONE, ""), (1, NONE, "")])
        while queue:
            node, parent, c = queue.popleft()
            if parent != NONE:
                if node in ends:  # the whole string so far is one piece
                    self.fail[node], self.pops[node] = 1, 1
                else:  # cut pieces off the parent's string until the next character has an edge
                    at, pops = self.fail[parent], self.pops[parent]
                    while at != NONE and c not in self.edges[at]:
                        pops += self.pops[at]
                        at = self.fail[at]
                    if at != NONE:
                        self.fail[node], self.pops[node] = self.edges[at][c], pops
            queue.extend((child, node, x) for x, child in self.edges[node].items())
        self.table: dict[str, int] = {}
        self.table_rows = table_rows

    def word(self, word: str) -> int:
        """Number of pieces of a word; 1 where it is unknown."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node, count = 0, 0
        for c in word:
            nxt = edges[node].get(c)
            while nxt is None:
                count += pops[node]
                node = fail[node]
                if node == NONE:
                    return 1
                nxt = edges[node].get(c)
            node = nxt
        while node != 1:  # what is left must be cut into whole pieces
            count += pops[node]
            node = fail[node]
            if node == NONE:
                return 1
        return count

    def text(self, text: str) -> int:
        table, total = self.table, 0
        for w, n in Counter(text.split()).items():
            got = table.get(w)
            if got is None:
                if len(table) >= self.table_rows:
                    table.clear()
                got = table[w] = self.word(w)
            total += got * n
        return total


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a sentencepiece vocabulary file, one per worker: pieces
    with the word mark start words, the others go on; control and byte pieces
    are left out."""
    if path not in _AUTOMATA:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        starts = [p[1:] for p in pieces if p.startswith(mark) and mark not in p[1:]]
        _AUTOMATA[path] = Automaton(starts, [p for p in pieces if mark not in p])
    return _AUTOMATA[path]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocabulary_path)
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.split()) for t in texts], pa.int64()),
                 pa.array([auto.text(t) for t in texts], pa.int64())], ["id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = map_batches(rows, run, f"id {kind_of(rows, 'id')}, n_words long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
