"""Token counts under a unigram model, by dynamic programming over a trie of distinct words.

Distinct words are inserted in a trie that a worker keeps from batch to batch. A node holds the best
score of its prefix and the number of tokens of that, so what words share at their start is computed
once; the number at a word's last node is its count. A document's count is the sum over its words.

Scores come from a SentencePiece model file: a unigram model's own, else log probabilities by rank
(Zipf's law, in the order of the file). For a BPE model the counts are thus those of a unigram model
with its pieces, an estimate of the BPE's own: tokenizers aren't trained here, so there are no better
scores. A character without a piece costs its UTF-8 bytes, as by byte fallback. Equal scores: the
fewer tokens.

Nulls: a null text has no words. Very long texts and words: whole. Repeated rows: each for itself.
Empty tables: empty result. Other columns pass through; names given here replace columns of the same
name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stemma.llm.common import with_columns
from stemma.llm.segments import slices
from stemma.llm.sentencepiece_codec import CONTROL, MARK, NORMAL, UNIGRAM, USER, Model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nodes that one worker keeps; beyond that it starts anew, which costs time only.
KEPT_NODES = 1_000_000


class UnigramCounter:
    def __init__(self, scores: dict[str, float], unknown: float):
        self.scores, self.unknown = scores, unknown
        self.longest = max(map(len, scores), default=1)
        self.forget()

    def forget(self) -> None:
        self.counts: dict[str, int] = {}  # at the last nodes of words
        self.next: dict[tuple[int, str], int] = {}  # the trie: (node, character) to node
        self.best, self.tokens = [0.0], [0]  # forward scores of the nodes, and their numbers of tokens

    def learn(self, words: list[str]) -> None:
        """Insert new words; each stands with a marker before it."""
        scores, longest, following, best, tokens = self.scores, self.longest, self.next, self.best, self.tokens
        for word in words:
            path, node, nodes = MARK + word, 0, [0]
            for end, character in enumerate(path, 1):
                child = following.get((node, character))
                if child is None:
                    n = len(character.encode("utf-8", "surrogatepass"))
                    top, least = best[node] + n * self.unknown, tokens[node] + n
                    for start in range(max(0, end - longest), end):
                        score = scores.get(path[start:end])
                        if score is not None:
                            score += best[nodes[start]]
                            if score > top or score == top and tokens[nodes[start]] + 1 < least:
                                top, least = score, tokens[nodes[start]] + 1
                    child = following[node, character] = len(best)
                    best.append(top)
                    tokens.append(least)
                node = child
                nodes.append(node)
            self.counts[word] = tokens[node]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, tokens) of each text."""
        if len(self.best) > KEPT_NODES:
            self.forget()
        words: list[str] = []
        n = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = WORD.findall(text)
            n[i] = len(found)
            words += found
        counts = np.fromiter(map(self.counts.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(counts < 0)
        if len(new):
            keys = [words[i] for i in new]
            self.learn(list(dict.fromkeys(keys)))
            counts[new] = np.fromiter(map(self.counts.__getitem__, keys), np.int64, len(new))
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(n)
        return n, sums[ends] - sums[ends - n]


@lru_cache(maxsize=2)
def counter(model_path: str) -> UnigramCounter:
    m = Model.load(model_path)
    pieces = [(p, s) for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True) if k in (NORMAL, USER) and k != CONTROL]
    if m.kind != UNIGRAM:
        total = sum(1 / (r + 2) for r in range(len(pieces)))
        pieces = [(p, -math.log((r + 2) * total)) for r, (p, _) in enumerate(pieces)]
    return UnigramCounter(dict(pieces), min((s for _, s in pieces), default=0.0) - 10.0)


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_words and n_tokens."""

    def run(texts: pa.Array) -> Iterator[dict[str, pa.Array]]:
        c = counter(model_path)
        for at, rows in slices(texts):
            words, tokens = c.count([t or "" for t in texts.slice(at, rows).to_pylist()])
            yield {"n_words": pa.array(words), "n_tokens": pa.array(tokens)}

    return with_columns(df, text_col, run, "n_words long, n_tokens long")
