"""Token counts of unigram models through a trie of pre-tokens.

A pre-token is the space marker and the characters up to the next space. The
distinct pre-tokens of a task go into one trie; each node holds the best
forward score of the characters down to it and how many tokens reach it, from
the pieces that end at it. So a prefix that many pre-tokens share is scored
once, and a pre-token that has been there is looked up. A document's count is
the sum over its pre-tokens' terminal nodes.

Texts are independent, so this is a map without a shuffle. The trie is
dropped and begun again when it has ``max_nodes`` nodes, which bounds a
task's memory and changes no result."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .sentence_pieces import _BYTE, _CONTROL, _UNKNOWN, MARK, model_path, parse_model

#: Nodes of a task's trie.
MAX_NODES = 400_000
#: An unknown character costs so much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: A longer pre-token is scored by itself, with as many places in memory as the longest piece has characters.
SHARED = 200


def unigram_scores(path: str | None = None) -> tuple[dict[str, float], bool]:
    """Scores of a SentencePiece model's pieces, and whether it has bytes to
    fall back to. The scores of a merge model are its ranks; they are read
    as unigram scores as they are."""
    with open(model_path(path), "rb") as f:
        m = parse_model(f.read())
    return {p: s for p, s, kind in m["pieces"] if kind not in (_UNKNOWN, _CONTROL, _BYTE)}, m["byte_fallback"]


class ForwardTrie:
    """Best segmentation of strings into pieces: the largest sum of scores,
    and of equal sums the one whose last piece is longest, at each place.

    An unknown character is a token, or as many as it has bytes if the model
    falls back to bytes, and costs the worst score less ``UNKNOWN_PENALTY``
    for each."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool, max_nodes: int = MAX_NODES):
        self.scores, self.bytes, self.max_nodes = scores, byte_fallback, max_nodes
        self.worst = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        lengths: dict[str, set[int]] = {}
        for p in scores:
            lengths.setdefault(p[-1], set()).add(len(p))
        #: lengths of the pieces that end with a character, longest first
        self.lengths = {c: sorted(own, reverse=True) for c, own in lengths.items()}
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of ``text``: stored if it has been there, else it is put into the trie."""
        if len(text) > SHARED:
            return self.alone(text)
        if (known := self.terminal.get(text)) is None:
            if len(self.child) > self.max_nodes:
                self.clear()
            known = self.terminal[text] = self.insert(text)
        return known

    def alone(self, text: str) -> int:
        """Tokens of a text that is too long to share: the same scores, of which the last places alone are kept."""
        reach = max((sizes[0] for sizes in self.lengths.values()), default=1)
        score, tokens = [0.0] * (reach + 1), [0] * (reach + 1)
        for depth, c in enumerate(text, 1):
            best, n = None, 0
            for size in self.lengths.get(c, ()):
                if size <= depth and (s := self.scores.get(text[depth - size:depth])) is not None:
                    start = (depth - size) % (reach + 1)
                    if best is None or score[start] + s > best:
                        best, n = score[start] + s, tokens[start] + 1
            if c not in self.scores:
                own, start = len(c.encode()) if self.bytes else 1, (depth - 1) % (reach + 1)
                s = score[start] + own * self.worst
                if best is None or s > best:
                    best, n = s, tokens[start] + own
            score[depth % (reach + 1)], tokens[depth % (reach + 1)] = best, n
        return tokens[len(text) % (reach + 1)]

    def insert(self, text: str) -> int:
        """Score what the trie doesn't have of ``text``; its terminal count."""
        node, depth, path = 0, 0, [0]
        child, score, tokens = self.child, self.score, self.tokens
        for c in text:
            depth += 1
            after = child[node].get(c)
            if after is None:
                after = len(child)
                child[node][c] = after
                child.append({})
                best, n = None, 0
                for size in self.lengths.get(c, ()):
                    if size <= depth and (s := self.scores.get(text[depth - size:depth])) is not None:
                        start = path[depth - size]
                        if best is None or score[start] + s > best:
                            best, n = score[start] + s, tokens[start] + 1
                if c not in self.scores:
                    own = len(c.encode()) if self.bytes else 1
                    s = score[node] + own * self.worst
                    if best is None or s > best:
                        best, n = s, tokens[node] + own
                score.append(best)
                tokens.append(n)
            node = after
            path.append(node)
        return tokens[node]


def pre_tokens(text: str) -> list[str]:
    """The marker and what follows each space, and the text's begin; none of an empty text."""
    return [MARK + p for p in text.split(" ")] if text else []


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 max_nodes: int = MAX_NODES) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_pre_tokens``, ``n_tokens``.

    A null or empty text has none of either; repeated rows are counted one by
    one; other columns are not read."""
    given = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches):
        trie = ForwardTrie(*unigram_scores(path), max_nodes)
        for batch in slices(batches):
            split = [pre_tokens(t or "") for t in batch["text"].to_pylist()]
            known: dict[str, int] = {}
            where = np.fromiter((known.setdefault(p, len(known)) for p in chain.from_iterable(split)), np.int64)
            counts = np.fromiter(map(trie.count, known), np.int64, len(known))
            ends = np.cumsum([0, *map(len, split)])
            total = np.concatenate([[0], np.cumsum(counts[where])])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(np.diff(ends), pa.int64()), pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())],
                names=["id", "n_pre_tokens", "n_tokens"])
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_pre_tokens long, n_tokens long"
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
