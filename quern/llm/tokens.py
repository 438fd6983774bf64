"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie.  Each node carries a failure link and the
number of tokens that are popped when the link is taken, precomputed breadth
first:

    a node that is a piece         pops 1, links to the root
    any other child v of u by c    pops what u's link pops, and goes on along
                                   links (adding their pops) until one has a
                                   child by c, which becomes v's link

Reading a word then costs one step for each character plus one for each link
taken, and a link always loses depth, so the work is linear in the word.  The
result is the length of the greedy longest-match segmentation; no piece is built.

A word is a run without ASCII white space, read with the word mark U+2581 in
front.  A word that greedy matching can't finish counts as one unknown token.

Null and empty texts have no words and no tokens.  Texts of any length are read
whole.  Each row gives one row, so repeated ids give repeated rows, null ids
stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TOKENIZERS, pieces_of, table, texts

MARK = "▁"
UNKNOWN = 1 << 40  # a word's value is its tokens, plus this if it is unknown
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 400_000


class Automaton:
    """children[v]: character to node; link[v]: failure link or -1; pops[v]: tokens popped along it."""

    def __init__(self, pieces: list[str]):
        children: list[dict[str, int]] = [{}]
        final = [False]
        for piece in pieces:
            v = 0
            for c in piece:
                nxt = children[v].get(c)
                if nxt is None:
                    nxt = children[v][c] = len(children)
                    children.append({})
                    final.append(False)
                v = nxt
            final[v] = True
        link, pops = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in children[u].items():
                if final[v]:
                    link[v], pops[v] = 0, 1
                else:
                    z, popped = link[u], pops[u]
                    while z >= 0 and c not in children[z]:
                        popped += pops[z]
                        z = link[z]
                    if z >= 0:
                        link[v], pops[v] = children[z][c], popped
                queue.append(v)
        self.children, self.link, self.pops = children, link, pops

    def count(self, word: str) -> int | None:
        """Tokens of the greedy longest-match segmentation; None if there is none."""
        children, link, pops = self.children, self.link, self.pops
        v = n = 0
        for c in word:
            while c not in children[v]:
                n += pops[v]
                v = link[v]
                if v < 0:
                    return None
            v = children[v][c]
        while v:
            n += pops[v]
            v = link[v]
            if v < 0:
                return None
        return n


_built: dict[int, Automaton] = {}


def automaton(pieces: list[str]) -> Automaton:
    """One automaton for each worker process and vocabulary."""
    key = hash(tuple(pieces))
    if key not in _built:
        _built[key] = Automaton(pieces)
    return _built[key]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs: (doc_id, text).  Adds n_words, n_tokens and n_unknown to each id."""
    spark = docs.sparkSession
    pieces = spark.sparkContext.broadcast([p for p, _, _ in pieces_of(vocabulary)])  # a fixed file

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(pieces.value), {}

        def value(word: bytes) -> int:
            n = machine.count(MARK + word.decode("utf-8", "replace"))
            known[word] = v = 1 + UNKNOWN if n is None else n
            return v

        for batch in rows:
            n_words, n_tokens, n_unknown = [], [], []
            for text in texts(batch.column(1)):
                words = text.split()
                values = list(map(known.get, words))
                if None in values:
                    values = [v if v is not None else known.get(w) or value(w) for v, w in zip(values, words)]
                total = sum(values)
                n_words.append(len(words))
                n_tokens.append(total % UNKNOWN)
                n_unknown.append(total // UNKNOWN)
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], schema=SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op1_tokens(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")
