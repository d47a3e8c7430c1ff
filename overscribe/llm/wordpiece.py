"""Token counts by the linear longest-match automaton (Song et al., 2021).

Greedy word-piece splits a word into the longest piece that begins it, then the
longest continuation piece that begins the rest, and so on. Here the vocabulary
is a trie whose nodes have failure links: where the trie has no next letter,
the link leads to the node of what is left after the pieces that greedy
matching has certainly taken by then, and the number of these pieces stands
beside it, precomputed. A word is so counted in one pass, in time linear in its
length, without building a piece.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type, in_batches
from .sentencepiece import MARK, MODEL, NORMAL, load

#: Words, and single marks, as they are looked up.
WORDS = re.compile(r"\w+|[^\w\s]")
#: Words of which each task keeps the count, and letters up to which it keeps one.
MEMO, LONGEST = 150_000, 64


@dataclass
class Automaton:
    """initial: pieces that begin a word; further: those that go on with one."""

    initial: list[str]
    further: list[str]
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}, {}])

    def __post_init__(self) -> None:
        nodes, piece = self.nodes, [False, False]
        for root, vocabulary in ((0, self.initial), (1, self.further)):
            for p in vocabulary:
                at = root
                for c in p:
                    if c not in nodes[at]:
                        nodes[at][c] = len(nodes)
                        nodes.append({})
                        piece.append(False)
                    at = nodes[at][c]
                piece[at] |= at > 1
        fail, pops = [-1] * len(nodes), [0] * len(nodes)
        todo = [0, 1]
        for u in todo:  # by depth: a link leads to a node that is not as deep
            for c, v in nodes[u].items():
                if piece[v]:
                    fail[v], pops[v] = 1, 1
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and c not in nodes[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = nodes[z][c], n
                todo.append(v)
        self.fail, self.pops = fail, pops

    def count(self, word: str) -> int:
        """Pieces of the word; 0 if it has no split (one unknown token)."""
        nodes, fail, pops = self.nodes, self.fail, self.pops
        at = n = 0
        for c in word:
            to = nodes[at].get(c)
            while to is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 0
                to = nodes[at].get(c)
            at = to
        while at != 1:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return 0
        return n


def vocabulary(path: str = MODEL) -> tuple[list[str], list[str]]:
    """(initial, further) pieces of a model file: with a white-space marker or without one."""
    m = load(path)
    own = [p for p, t in zip(m.pieces, m.types, strict=True) if t == NORMAL]
    return [p[1:] for p in own if p[:1] == MARK and p[1:] and MARK not in p[1:]], [p for p in own if MARK not in p]


def token_counts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row.

    A word that has no split is one unknown token. A null or blank text has zeros.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # the vocabulary's size

    def run(batches):
        automaton = Automaton(*shared.value)
        memo: dict[str, int] = {}
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            for text in batch.column(1).to_pylist():
                words = WORDS.findall(text or "")
                if len(memo) > MEMO:
                    memo.clear()
                new = set(words).difference(memo)
                for w in new:
                    memo[w] = automaton.count(w)
                found = list(map(memo.__getitem__, words))
                unknown = found.count(0)
                for out, n in zip(counts, (len(words), sum(found) + unknown, unknown), strict=True):
                    out.append(n)
                for w in new:
                    if len(w) > LONGEST:
                        del memo[w]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {id_type(docs)}, n_words long, n_tokens long, n_unknown long")
