"""The lattice of all segmentations of a word into pieces: marginal probabilities of many words at once."""

from __future__ import annotations

import numpy as np

from runloom.llm.base import mix
from runloom.llm.vocabulary import SPACE, Vocabulary

_BASE = np.uint64(0x9FB21C651E98DF25)


class WordLattice:
    """P(word): the sum over all ways to write "▁word" as an opening piece and others.

    Pieces that begin with ▁ open a word, all others go on with it; each class has weights
    that sum to 1. After each piece the word stops with probability q (not after a lone ▁).
    A character outside the vocabulary takes the class's escape weight and 8 bits a byte; as
    not every byte sequence is a character, P sums to a little less than 1 over all words.
    """

    def __init__(self, vocabulary: Vocabulary, stop: float = 0.4):
        keep = [(p, vocabulary.weights[i]) for i, p in enumerate(vocabulary.pieces) if i in vocabulary.weights and SPACE not in p[1:] and p]
        opening = [(p, w) for p, w in keep if p[0] == SPACE]
        others = [(p, w) for p, w in keep if p[0] != SPACE]
        self.names = [p for p, _ in opening] + [p for p, _ in others] + [""]  # the last is the escape
        self.n_open = len(opening)
        self.longest = max(map(len, self.names))
        w = np.exp(np.array([w for _, w in opening + others] + [vocabulary.byte_weight]))
        a, b = w[: self.n_open], w[self.n_open :]
        self.lp = np.log(np.concatenate([a / a.sum(), b / b.sum()]))
        self.stop = stop
        # all beginnings of pieces by hash, with the piece that each is, or -1
        table = {p[:k]: -1 for p in self.names[:-1] for k in range(1, len(p))} | {p: i for i, p in enumerate(self.names[:-1])}
        keys = np.array([self._hash_one(p) for p in table], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.piece = keys[order], np.array(list(table.values()))[order]
        # where the keys of each value of the high bits begin: most values have one key at most
        self.shift = np.uint64(64 - (len(keys).bit_length() + 3))
        self.begin = np.searchsorted(self.keys >> self.shift, np.arange((1 << int(64 - self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    @staticmethod
    def _hash_one(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return int(mix(np.array([h], dtype=np.uint64))[0])

    def _pieces(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is that of a beginning of a piece, and the piece that it is itself, or -1."""
        high = (x >> self.shift).astype(np.int64)
        at, last = self.begin[high], self.begin[high + 1]
        found = np.full(len(x), -1, dtype=np.int64)
        todo = np.flatnonzero(at < last)
        at = at[todo]
        alive = np.zeros(len(x), dtype=bool)
        while len(todo):
            same = self.keys[at] == x[todo]
            hit = todo[same]
            alive[hit], found[hit] = True, self.piece[at[same]]
            more = ~same & (at + 1 < last[todo])
            todo, at = todo[more], at[more] + 1
        return alive, found

    def run(self, words: list[str]) -> np.ndarray:
        """Natural log P of each word."""
        out = np.zeros(len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            step = max(1, (1 << 18) // int(n))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                out[part] = self._same_length([words[i] for i in part.tolist()], int(n) + 1)
        return out

    def _same_length(self, words: list[str], n: int) -> np.ndarray:
        """The forward recursion over places, for words of n - 1 characters at once."""
        codes = np.empty((len(words), n), dtype=np.uint64)
        codes[:, 0] = ord(SPACE)
        codes[:, 1:] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), n - 1)
        size = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4))) * np.log(256.0)
        go, end = np.log1p(-self.stop), np.log(self.stop)
        escape = len(self.lp) - 1
        alpha = np.full((n + 1, len(words)), -np.inf)
        alpha[0] = 0
        for i in range(n):
            on = np.flatnonzero(alpha[i] > -np.inf)
            h = np.zeros(len(on), dtype=np.uint64)
            leave = go if i > 1 else 0.0  # after a lone ▁ the word can't stop
            for j in range(i + 1, min(i + self.longest, n) + 1):
                h = h * _BASE + (codes[on, j - 1] + np.uint64(1))
                alive, own = self._pieces(mix(h))
                if i and j == i + 1:
                    own = np.where(own < 0, escape, own)
                is_edge = own >= 0
                k, own = on[is_edge], own[is_edge]
                if len(k):
                    w = self.lp[own] + leave
                    if i and j == i + 1:
                        w = w - np.where(own == escape, size[k, i], 0.0)
                    alpha[j, k] = np.logaddexp(alpha[j, k], alpha[i, k] + w)
                on, h = on[alive], h[alive]
                if not len(on):
                    break
        return alpha[n] + end
