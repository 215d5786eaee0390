"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie of UTF-8 bytes: a root for word beginnings and one for continuations. Every node carries a failure link and
the number of pieces popped on the way: where a node has no child for the next byte, the greedy tokenizer would emit those pieces
and go on from the linked node. A word therefore costs time linear in its length, and no piece is ever built. The automaton
walks all distinct words of a batch together, one byte position at a time, and the few longest one after the other.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.llm.common import need
from quillgraph.llm.words import word_groups

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FEW = 64  # so many words left are walked one by one: an array operation per byte pays for many words only
MOST_PIECES = 2_000_000  # a vocabulary, which every executor holds; not data


def sentencepiece_vocabulary(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that go on) of a public vocabulary file; control and byte entries are left out. The lone
    mark of a word's begin is the empty piece that begins a word."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [n[1:] for n in names if n[0] == "▁" and "▁" not in n[1:]], [n for n in names if "▁" not in n]


class Automaton:
    """Sorted transition keys (node * 256 + byte) with targets, failure links (-1: none) and popped counts per node. An empty initial
    piece is one token before the first byte: a word that no other piece begins goes on from it."""

    def __init__(self, initial: Iterable[str], further: Iterable[str]):
        children: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        initial = list(initial)
        for root, pieces in ((0, initial), (1, further)):
            for piece in pieces:
                node = root
                for b in piece.encode():
                    if b not in children[node]:
                        children[node][b] = len(children)
                        children.append({})
                        final.append(False)
                    node = children[node][b]
                final[node] = node > 1
        if len(children) > 8 * MOST_PIECES:
            raise ValueError("the vocabulary is too large to be held by every executor")
        link, popped = [-1] * len(children), [0] * len(children)
        if "" in initial:
            link[0], popped[0] = 1, 1
        queue = deque((root, b, v) for root in (0, 1) for b, v in children[root].items())
        while queue:
            parent, b, node = queue.popleft()
            if final[node]:
                link[node], popped[node] = 1, 1
            else:
                at, pops = link[parent], popped[parent]
                while at >= 0 and b not in children[at]:
                    at, pops = link[at], pops + popped[at]
                if at >= 0:
                    link[node], popped[node] = children[at][b], pops
            queue.extend((node, c, v) for c, v in children[node].items())
        edges = sorted((node << 8 | b, v) for node, own in enumerate(children) for b, v in own.items())
        self.keys = np.array([k for k, _ in edges] or [-1], np.int64)
        self.targets = np.array([v for _, v in edges] or [0], np.int64)
        self.link, self.popped = np.array(link, np.int64), np.array(popped, np.int64)
        self.table = None  # the same as Python objects, made where a word is walked alone

    def _alone(self, data: bytes, state: int, total: int) -> tuple[int, int]:
        """Walks one word on from a state, byte by byte; state -1 where greedy matching fails."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), self.targets.tolist())), self.link.tolist(), self.popped.tolist()
        edges, link, popped = self.table
        for byte in data:
            while (to := edges.get(state << 8 | byte, -1)) < 0:
                total += popped[state]
                state = link[state]
                if state < 0:
                    return -1, -1
            state = to
        return state, total

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end]; 0 where greedy matching fails, for the caller's unknown piece."""
        total = np.zeros(len(starts), np.int64)
        state = np.zeros(len(starts), np.int64)
        lengths = ends - starts
        live = np.arange(len(starts))
        at = 0
        while len(live):
            ended = lengths[live] <= at
            self._finish(live[ended], state, total)
            live = live[~ended]
            if len(live) <= FEW:
                for w in live.tolist():
                    state[w], total[w] = self._alone(data[starts[w] + at:ends[w]].tobytes(), int(state[w]), int(total[w]))
                live = live[state[live] >= 0]
                self._finish(live, state, total)
                break
            todo = live
            byte = data[starts[live] + at].astype(np.int64)
            while len(todo):
                key = state[todo] << 8 | byte
                slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[slot] == key
                state[todo[hit]] = self.targets[slot[hit]]
                todo, byte = todo[~hit], byte[~hit]
                total[todo] += self.popped[state[todo]]
                state[todo] = self.link[state[todo]]
                dead = state[todo] < 0
                total[todo[dead]] = -1
                todo, byte = todo[~dead], byte[~dead]
            live = live[state[live] >= 0]
            at += 1
        return np.maximum(total, 0)

    def _finish(self, ended: np.ndarray, state: np.ndarray, total: np.ndarray) -> None:
        """Pops what a finished word still holds: back over the links to the continuation root."""
        while len(ended):
            ended = ended[state[ended] != 1]
            total[ended] += self.popped[state[ended]]
            state[ended] = self.link[state[ended]]
            lost = state[ended] < 0
            total[ended[lost]] = -1
            ended = ended[~lost]


def token_counts(docs: DataFrame, initial: list[str], further: list[str]) -> DataFrame:
    """Per input row: doc_id, n_words, n_tokens and n_unknown (words that greedy matching cannot cover, one token each).

    Words are runs of other than the six ASCII blanks, case kept. Null, empty and blank texts have zeros. A vocabulary without
    pieces makes every word unknown. Very long texts and words are walked whole. Repeated rows are counted each; other columns are dropped; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(initial, further))

    def run(batches):
        for batch in batches:
            for first, words in word_groups(batch.column("text"), fold=False):
                _, one, back = np.unique(words.hashes, return_index=True, return_inverse=True)
                pieces = shared.value.counts(words.data, words.starts[one], words.ends[one])[back]
                sums = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[words.firsts])
                yield pa.record_batch([batch.column("doc_id").slice(first, len(words.firsts) - 1), pa.array(np.diff(words.firsts)),
                                       pa.array(sums(np.maximum(pieces, 1))), pa.array(sums(pieces == 0))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])
    return need(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
