"""Token counts by a linear longest-match automaton.

A word (a maximal run without white space, marked with a leading U+2581 as the vocabulary marks word starts) is cut greedily
into the longest vocabulary pieces. The automaton is the trie of all pieces with a failure link and a precomputed number of
popped tokens at every node: when a character cannot be followed, the tokens that are certain by then are counted and the
scan goes on from the link, so that every character is read once and no piece is built. A character that no piece begins
counts as its UTF-8 bytes (byte fallback).

Defined cases: null, empty and blank texts have no words and no tokens; a word of any length is read once; counts of equal
words are kept for reuse in a table of bounded size; repeated rows are counted row by row.
"""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose counts a worker keeps.
KEPT = 200_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


class LongestMatch:
    """The automaton over a vocabulary. Counts pack tokens and fallback bytes as tokens << 32 | bytes."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces, self.next = sorted(set(pieces) - {""}), None

    def __getstate__(self) -> list[str]:
        return self.pieces

    def __setstate__(self, pieces: list[str]) -> None:
        self.__init__(pieces)

    def build(self) -> None:
        children: list[dict[str, int]] = [{}]
        weight: list[int] = [0]

        def node(piece: str) -> int:
            u = 0
            for c in piece:
                if c not in children[u]:
                    children[u][c] = len(children)
                    children.append({})
                    weight.append(0)
                u = children[u][c]
            return u

        for piece in self.pieces:
            weight[node(piece)] = 1 << 32
        for c in {c for piece in self.pieces for c in piece}:
            u = node(c)
            weight[u] = weight[u] or self.fallback(c)
        link, pops = [0] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in children[u].items():
                queue.append(v)
                if weight[v]:
                    pops[v] = weight[v]
                    continue
                z, more = link[u], 0
                while c not in children[z]:
                    more += pops[z]
                    z = link[z]
                link[v], pops[v] = children[z][c], pops[u] + more
        self.next, self.link, self.pops, self.known = children, link, pops, {}

    @staticmethod
    def fallback(c: str) -> int:
        n = len(c.encode("utf-8", "replace"))
        return n << 32 | n

    def count(self, word: str) -> int:
        u = total = 0
        for c in word:
            while (v := self.next[u].get(c)) is None:
                if not u:  # no piece begins with it
                    total += self.fallback(c)
                    v = 0
                    break
                total += self.pops[u]
                u = self.link[u]
            u = v
        while u:
            total += self.pops[u]
            u = self.link[u]
        return total

    def text(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, fallback bytes)."""
        if self.next is None:
            self.build()
        words, total, known = _WORD.findall(text or ""), 0, self.known
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.count(MARK + word)
                if len(known) >= KEPT:
                    known.clear()
                known[word] = n
            total += n
        return len(words), total >> 32, total & 0xFFFFFFFF


def token_counts(docs: DataFrame, pieces: list[str], text: str = "text", out: str = "tokens") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_tokens, n_fallback_bytes. ``pieces`` is a vocabulary of fixed size."""
    bounded_batches(docs.sparkSession)
    matcher = LongestMatch(pieces)

    @F.pandas_udf("n_words long, n_tokens long, n_fallback_bytes long")
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([matcher.text(t) for t in texts], columns=["n_words", "n_tokens", "n_fallback_bytes"])

    return docs.withColumn(out, count(F.col(text)))


def op2_tokens(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, load_pieces(vocabulary)).select("doc_id", "tokens.*")
