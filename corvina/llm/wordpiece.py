"""Greedy word-piece token counts in linear time.

Two tries, one for pieces that begin a word and one for those that continue
it, become an automaton: a failure link leads from a node to the place where
the rest of its string is to be matched after the longest pieces have been
cut from its front, and a precomputed number says how many pieces that cuts.
Each character of a word is then handled in amortised constant time, and no
piece is ever built.

The bare word mark is a piece too: a word for whose first letters there is no
marked piece begins with it, at one token. With byte pieces a character that
begins no piece is as many tokens as it has UTF-8 bytes (so is the mark where
the vocabulary has none).

Defined results: words are the maximal runs without Unicode white space; a
word that can't be cut into pieces (only without byte pieces or bare mark)
counts as one unknown token; null and
empty texts have no words; repeated rows are counted independently.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words of which a worker remembers the counts, and the longest such word: only a bound on memory.
REMEMBERED, LONGEST = 400_000, 64

COUNTED = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")])


MARK = "▁"


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str], bool]:
    """Pieces that begin a word (they carry the word mark; the mark alone is the empty piece), pieces that continue one, and whether all bytes are pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    first, rest, n_bytes = [], [], 0
    for i in range(sp.get_piece_size()):
        n_bytes += sp.is_byte(i)
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i)
        if piece.startswith(MARK):
            first.append(piece[1:])
        else:
            rest.append(piece)
    return first, rest, n_bytes == 256


class Automaton:
    """Nodes are numbers; 0 begins a word, 1 continues it. An empty first piece is the bare mark."""

    def __init__(self, first: list[str], rest: list[str], byte_pieces: bool = False):
        self.byte_pieces = byte_pieces
        self.next: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        parents = [(-1, ""), (-1, "")]
        single = {c: len(c.encode()) for piece in (*first, *rest) for c in piece} if byte_pieces else {}
        for root, pieces in ((0, dict.fromkeys(first, 1)), (1, single | dict.fromkeys(rest, 1))):
            for piece, tokens in pieces.items():
                at = root
                for c in piece:
                    to = self.next.get((at, c))
                    if to is None:
                        to = self.next[at, c] = len(parents)
                        parents.append((at, c))
                    at = to
                if at > 1:
                    ends[at] = tokens
        n = len(parents)
        self.fail, self.cut = [-1] * n, [0] * n
        if "" in first or byte_pieces:
            self.fail[0], self.cut[0] = 1, 1 if "" in first else len(MARK.encode())
        # children are numbered after their parents, so a parent's link is known before theirs;
        # but a link may lead to any shorter string, hence breadth first
        depth, order = [0] * n, deque()
        for v in range(2, n):
            depth[v] = depth[parents[v][0]] + 1
        order = sorted(range(2, n), key=depth.__getitem__)
        for v in order:
            if v in ends:
                self.fail[v], self.cut[v] = 1, ends[v]
                continue
            u, c = parents[v]
            z, cut = self.fail[u], self.cut[u]
            while z >= 0 and (z, c) not in self.next:
                cut += self.cut[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.cut[v] = self.next[z, c], cut

    def count(self, word: str) -> int:
        """Tokens of the word, 0 if it can't be cut into pieces."""
        at, pieces, step, fail, cut = 0, 0, self.next.get, self.fail, self.cut
        for c in word:
            to = step((at, c))
            while to is None:
                if fail[at] < 0:
                    if at != 1 or not self.byte_pieces:
                        return 0
                    pieces += len(c.encode())
                    to = 1
                    break
                pieces += cut[at]
                at = fail[at]
                to = step((at, c))
            at = to
        while at != 1:
            if fail[at] < 0:
                return 0
            pieces += cut[at]
            at = fail[at]
        return pieces


class _Memo(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def counter(docs: DataFrame, vocabulary: tuple[list[str], list[str]] | tuple[list[str], list[str], bool]):
    """A function from a text column to a struct of n_words, n_tokens, n_unknown. Only the vocabulary is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(COUNTED)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = _Memo(Automaton(*shared.value))
        for batch in batches:
            rows = []
            for text in batch:
                counts = [memo[w] for w in text.split()] if text else []
                unknown = counts.count(0)
                rows.append((len(counts), sum(counts) + unknown, unknown))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")

    return count


def token_counts(docs: DataFrame, vocabulary: tuple[list[str], list[str]] | tuple[list[str], list[str], bool], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of each row; one pass, no shuffle."""
    count = counter(docs, vocabulary)
    return docs.select(F.col(id_col).alias("doc_id"), count(F.col(text_col)).alias("_c")).select("doc_id", "_c.*")


def column(docs: DataFrame, vocabulary: tuple[list[str], list[str]] | tuple[list[str], list[str], bool], text: Column) -> Column:
    return counter(docs, vocabulary)(text)
