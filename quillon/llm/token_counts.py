"""Token counts under a unigram vocabulary, by dynamic programming shared in a trie.

A pre-token is a word with the space mark in front.  Its tokens are the pieces of the
segmentation with the highest log-probability; of equal ones that with fewer tokens.
The forward score of a prefix depends on that prefix alone, so a trie of the distinct
pre-tokens holds one (score, count) at each node: a prefix that many words share is
computed once, and a word's terminal node holds its count.  The distinct words of a slice
are found first, by their hashes; only those that the terminal counts don't hold yet are
inserted.  A worker keeps trie and terminal counts from task to task; they begin anew when
they hold NODES, which costs time and changes nothing.  Words of over LONG characters pass
through a ring of the last scores instead, so no word needs memory beyond its own text.
There is no shuffle.

The vocabulary file holds merge ranks, no probabilities, and tokenizers aren't trained
here: a piece's probability follows from its rank by Zipf's law, P(r) = 1 / ((r + 1) H),
with H such that all sum to 1.  A character that no piece holds costs a token for each of
its UTF-8 bytes, each of them as likely as one of 256 under the rarest piece.

Defined results: a null or empty text has no pre-tokens and no tokens; repeated rows and
rows without doc_id are counted each; extra columns are ignored; an empty table gives an
empty result.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx

MARK = "▁"
#: Trie nodes, and terminal counts, that a worker holds at most; characters of a word that the trie takes.
NODES, LONG = 1 << 19, 256
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def vocabulary(path: str) -> dict[str, float]:
    """Piece to log-probability, of a sentencepiece file's ordinary pieces in the order of their scores."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    ordinary.sort(key=lambda i: (-p.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(ordinary))))
    return {p.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ordinary)}


class Trie:
    """Forward scores of prefixes; a node is [children, score, count]."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - math.log(256)
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = [{}, 0.0, 0], 1

    def forward(self, word: str, end: int, before) -> tuple[float, int]:
        """Score and count of the word's first ``end`` characters; before(k) gives those of its first k."""
        best, count = -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            score = self.pieces.get(word[start:end])
            if score is not None:
                s, n = before(start)
                if s + score > best or s + score == best and n + 1 < count:
                    best, count = s + score, n + 1
        ch = word[end - 1]
        if ch not in self.pieces:
            size = len(ch.encode("utf-8", "surrogatepass"))
            s, n = before(end - 1)
            if s + size * self.unknown > best:
                best, count = s + size * self.unknown, n + size
        return best, count

    def insert(self, word: str) -> int:
        """The word's token count; prefixes that are there already are not computed again."""
        node, path = self.root, [self.root]
        before = lambda k: path[k][1:]
        for end, ch in enumerate(word, 1):
            child = node[0].get(ch)
            if child is None:
                child = node[0][ch] = [{}, *self.forward(word, end, before)]
                self.nodes += 1
            node = child
            path.append(node)
        return node[2]

    def count(self, word: str) -> int:
        """The token count of a word that is too long for the trie."""
        size = self.longest + 1
        ring = [(0.0, 0)] * size
        before = lambda k: ring[k % size]
        for end in range(1, len(word) + 1):
            ring[end % size] = self.forward(word, end, before)
        return ring[len(word) % size][1]


class Terminals:
    """Token counts by word hash, filled from the trie when a word first comes."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.trie = Trie(pieces)
        self.keys, self.counts = np.empty(0, tx.U64), np.empty(0, np.int64)

    def _count(self, word: str) -> int:
        if len(word) > LONG:
            return self.trie.count(MARK + word)
        if self.trie.nodes >= NODES:
            self.trie.clear()
        return self.trie.insert(MARK + word)

    def of(self, w: tx.Words) -> np.ndarray:
        """The token count of every word."""
        own, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == own[inside]
        counts = np.empty(len(own), np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        for k in new.tolist():
            f = first[k]
            counts[k] = self._count(w.buf[w.starts[f] : w.ends[f]].tobytes().decode("utf-8"))
        if len(new):
            if len(self.keys) + len(new) > NODES:  # begin anew with this slice's words
                self.keys, self.counts = own[:NODES].copy(), counts[:NODES].copy()
            else:
                self.keys, self.counts = np.insert(self.keys, at[new], own[new]), np.insert(self.counts, at[new], counts[new])
        return counts[inverse]


@lru_cache(2)
def terminals(path: str) -> Terminals:
    """The worker's own, for as long as it lives."""
    return Terminals(vocabulary(path))


def counter(path: str):
    def each(rows: pa.RecordBatch, w: tx.Words) -> Iterator[dict]:
        of = lambda per_item, off: np.diff(np.concatenate([[0], np.cumsum(per_item, dtype=np.int64)])[off])
        chars = ((w.buf & 0xC0) != 0x80) & ~tx.SPACE[w.buf]
        yield {"doc_id": rows.column("doc_id"), "n_pretokens": w.counts, "n_chars": of(chars, w.off), "n_tokens": of(terminals(path).of(w), w.first)}

    return tx.mapper(each, COUNTS)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_chars (of pre-tokens) and n_tokens of every document."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(counter(path or vocabulary_path()), "doc_id long, n_pretokens long, n_chars long, n_tokens long")
