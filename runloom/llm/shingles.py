"""Five-word shingles and one-permutation MinHash signatures, for batches of texts."""

from __future__ import annotations

import numpy as np

from runloom.llm.base import GOLD, WordHashes, mix

SHINGLE = 5
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(words: WordHashes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other; and the ends.

    A-Z are lower-cased and words split at ASCII white space. A text of fewer than five words
    has its whole sequence as one shingle, one without words none.
    """
    h, ends = words.of([t.lower().split() for t in texts])
    if len(h) >= SHINGLE:
        s = h[: len(h) - SHINGLE + 1].copy()
        for i in range(1, SHINGLE):
            s = s * _ODD + h[i : len(h) - SHINGLE + 1 + i]
        s = mix(s)
    else:
        s = h[:0]
    sets = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            sets.append(np.unique(s[a : b - SHINGLE + 1]))
        elif b > a:
            x = np.array([b - a], dtype=np.uint64) * GOLD
            for y in h[a:b]:
                x = x * _ODD + y
            sets.append(mix(x))
        else:
            sets.append(h[:0])
    return np.concatenate([h[:0], *sets]), np.cumsum([0, *map(len, sets)])


def _probes() -> np.ndarray:
    """For each bin, the rank that its own fixed permutation gives every other bin."""
    i = np.arange(BINS, dtype=np.uint64)
    h = mix(mix(i * GOLD + np.uint64(1))[:, None] + i[None, :] * _ODD)
    return h.argsort(axis=1).argsort(axis=1).astype(np.int16)


_PROBES = _probes()


def signatures(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprint words of each set, and its band hashes (rows of zeros for empty sets).

    One permutation: the high bits of a shingle's hash name its bin, the least hash of each
    bin is kept. Optimal densification: an empty bin takes the value of the first filled bin
    in a permutation of its own, so two sets agree in it with the probability of any other.
    """
    n = np.diff(ends)
    d = len(n)
    fp = np.zeros((2, d), dtype=np.uint64)
    bands = np.zeros((d, BANDS), dtype=np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return fp, bands
    starts = ends[:-1][some]
    for k in range(2):
        fp[k, some] = mix(np.add.reduceat(mix((flat ^ np.uint64(k)) * GOLD), starts) + n[some].astype(np.uint64))
    doc = np.repeat(np.arange(len(some)), n[some])
    cell = doc * BINS + (((flat >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sig = np.zeros(len(some) * BINS, dtype=np.uint64)
    full = np.zeros(len(some) * BINS, dtype=bool)
    sig[cell[first]], full[cell[first]] = flat[first], True
    sig, full = sig.reshape(-1, BINS), full.reshape(-1, BINS)
    for r in np.flatnonzero(~full.all(axis=1)):
        has, lacks = np.flatnonzero(full[r]), np.flatnonzero(~full[r])
        sig[r, lacks] = sig[r, has[_PROBES[np.ix_(lacks, has)].argmin(axis=1)]]
    parts = sig.reshape(-1, BANDS, ROWS)
    b = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD, parts.shape[:2]).copy()
    for k in range(ROWS):
        b = mix(b * _ODD + parts[:, :, k])
    bands[some] = b
    return fp, bands
