"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a white-space separated word behind a word mark. The distinct pre-tokens of some megabytes of text
form a trie; the unigram forward score of a node (the best score of a segmentation of the node's prefix, with the
fewest pieces among equals) is computed once, level by level, for all words that share the prefix, and each
word's count is read at its terminal node. Scores are integers, so sums are exact in any order.

The vocabulary is that of a given piece model. Its pieces are ranked, not weighted, so their probabilities are
set by Zipf's law: piece r of n has 1 / (r H_n). Characters that no piece covers fall back to their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.common import small_batches, without

MARK = "▁"
#: Characters of text whose words share a trie; bounds a task's memory.
GROUP_CHARS = 8 << 20
#: Longer words are segmented on their own, so a trie has at most so many levels.
TRIE_DEPTH = 128
SCALE = 1 << 16
COUNT_BITS = 16
MOST_PIECES = 1 << 20


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def zipf_scores(n: int) -> list[int]:
    total = sum(1 / r for r in range(1, n + 1))
    return [round(SCALE * -math.log(r * total)) for r in range(1, n + 1)]


class Vocabulary:
    """A trie of pieces as a hash table from (state, character) to state."""

    def __init__(self, pieces: list[str]):
        if len(pieces) > MOST_PIECES:
            raise ValueError(f"{len(pieces)} pieces; a vocabulary is broadcast, so at most {MOST_PIECES} are allowed")
        self.pieces = dict(zip(reversed(pieces), reversed(zipf_scores(len(pieces))), strict=True))
        self.longest = max(map(len, pieces), default=0)
        self.unknown = min(self.pieces.values(), default=0) - 10 * SCALE
        children: dict[tuple[int, int], int] = {}
        scores = [None]
        for piece, score in self.pieces.items():
            s = 0
            for c in piece:
                if (s, ord(c)) not in children:
                    children[s, ord(c)] = len(scores)
                    scores.append(None)
                s = children[s, ord(c)]
            scores[s] = score
        self.final = np.array([x is not None for x in scores])
        self.score = np.array([x or 0 for x in scores], dtype=np.int64)
        self.size = 1 << max(4, (2 * len(children)).bit_length())
        self.keys = np.full(self.size, -1, dtype=np.int64)
        self.to = np.zeros(self.size, dtype=np.int64)
        left = np.array([s << 21 | c for s, c in children], dtype=np.int64)
        to = np.array(list(children.values()), dtype=np.int64)
        at = self._slot(left)
        while len(left):  # linear probing, all keys at once
            free = self.keys[at] == -1
            self.keys[at[free]] = left[free]
            put = self.keys[at] == left
            self.to[at[put]] = to[put]
            left, to, at = left[~put], to[~put], (at[~put] + 1) % self.size
        self.known = np.zeros(0x110000, dtype=bool)
        self.known[[ord(p) for p in pieces if len(p) == 1]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % self.size

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after char, -1 where no piece goes on."""
        key = state << 21 | char
        out = np.full(len(key), -1, dtype=np.int64)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            have = self.keys[at]
            same = have == key[todo]
            out[todo[same]] = self.to[at[same]]
            go = ~same & (have != -1)
            todo, at = todo[go], (at[go] + 1) % self.size
        return out

    def count_one(self, word: str) -> int:
        """The count of a single word, without a trie."""
        best: list[tuple[int, int]] = [(0, 0)] + [(-(1 << 62), 0)] * len(word)
        for i in range(len(word)):
            score, n = best[i]
            if word[i] not in self.pieces:
                best[i + 1] = max(best[i + 1], (score + self.unknown, n - len(word[i].encode("utf-8", "surrogatepass"))))
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                if (own := self.pieces.get(word[i:j])) is not None:
                    best[j] = max(best[j], (score + own, n - 1))
        return -best[-1][1]

    def count(self, words: list[str]) -> np.ndarray:
        """Pieces of each of the distinct words, in the given order."""
        out = np.zeros(len(words), dtype=np.int64)
        order = sorted((i for i in range(len(words)) if len(words[i]) <= TRIE_DEPTH), key=words.__getitem__)
        for i in range(len(words)):
            if len(words[i]) > TRIE_DEPTH:
                out[i] = self.count_one(words[i])
        if not order:
            return out
        length = np.array([len(words[i]) for i in order])
        chars = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        start = np.cumsum(length) - length
        order = np.array(order)
        alive = np.arange(len(order))  # words at least as long as the level
        node = np.zeros(len(order), dtype=np.int64)  # their nodes of the level above
        # A node's best is score << COUNT_BITS minus the pieces used, so a maximum prefers the score, then few pieces.
        best = np.zeros(1, dtype=np.int64)
        walk_node, walk_state, walk_from = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for level in range(int(length.max())):
            ended = length[alive] == level
            out[order[alive[ended]]] = -best[node[ended]] & ((1 << COUNT_BITS) - 1)
            alive, node = alive[~ended], node[~ended]
            char = chars[start[alive] + level]
            new = np.concatenate(([True], (node[1:] != node[:-1]) | (char[1:] != char[:-1])))
            head = np.flatnonzero(new)
            parent, letter = node[head], char[head]
            node = np.cumsum(new) - 1
            # Every walk through the pieces, and one that starts at each node, goes on to the node's children.
            n_up = len(best)
            walk_node, walk_state, walk_from = np.concatenate([walk_node, np.arange(n_up)]), np.concatenate([walk_state, np.zeros(n_up, np.int64)]), np.concatenate([walk_from, best])
            first = np.searchsorted(parent, np.arange(n_up + 1))
            many = (first[1:] - first[:-1])[walk_node]
            rep = np.repeat(np.arange(len(walk_node)), many)
            child = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many) + first[walk_node[rep]]
            state = self.step(walk_state[rep], letter[child])
            on = state >= 0
            walk_node, walk_state, walk_from = child[on], state[on], walk_from[rep[on]]
            above, best = best, np.full(len(head), -(1 << 62), dtype=np.int64)
            odd = np.flatnonzero(~self.known[letter])
            if len(odd):
                n_bytes = 1 + (letter[odd] > 0x7F) + (letter[odd] > 0x7FF) + (letter[odd] > 0xFFFF)
                best[odd] = above[parent[odd]] + (self.unknown << COUNT_BITS) - n_bytes
            done = self.final[walk_state]
            np.maximum.at(best, walk_node[done], walk_from[done] + (self.score[walk_state[done]] << COUNT_BITS) - 1)
        out[order[alive]] = -best[node] & ((1 << COUNT_BITS) - 1)
        return out


_BUILT: dict[int, Vocabulary] = {}


def _counted(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(pieces.value))
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Vocabulary(pieces.value)
        vocabulary = _BUILT[key]
        held: list[pa.RecordBatch] = []
        index: dict[str, int] = {}
        lists: list[list[int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            counts = vocabulary.count([MARK + w for w in index])
            sums = [int(counts[ids].sum()) if ids else 0 for ids in lists]
            words, at = [len(ids) for ids in lists], 0
            for batch in held:
                n = len(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words[at : at + n], pa.int64()), pa.array(sums[at : at + n], pa.int64())], names=[*batch.schema.names, "n_pretokens", "n_tokens"])
                at += n

        for batch in batches:
            at = batch.schema.get_field_index("text")
            for text in batch.column(at).to_pylist():
                size += len(text or "")
                lists.append([index.setdefault(w, len(index)) for w in (text or "").split()])
            held.append(batch.drop_columns(["text"]))
            if size >= GROUP_CHARS:
                yield from flush()
                held, index, lists, size = [], {}, [], 0
        if held:
            yield from flush()

    return run


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """The columns of docs but text, with n_pretokens and n_tokens (whole texts, one row per row of docs).

    Null and blank texts have no pre-tokens and no tokens. Repeated rows are counted row by row; columns named
    like those added, in any case, are replaced; an empty table gives an empty result. Words are split at Unicode white space.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = ("n_pretokens", "n_tokens")
    rows = docs.select(*[F.col(f"`{c}`") for c in without(docs, *added, "text")], F.col("text").alias("text"))
    schema = rows.drop("text").schema.add("n_pretokens", "long").add("n_tokens", "long")
    return rows.mapInArrow(_counted(spark.sparkContext.broadcast(pieces)), schema)
