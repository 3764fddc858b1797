"""Order min hash of a batch of texts, by numpy over the batch's bytes.

A k-mer is k consecutive words with the number of its earlier occurrences in the text. For each of many
hash functions the sketch takes the text's l k-mers of least hash and retains them in text order; texts
agree on a tuple with a chance that follows their edit similarity, since both the same k-mers and the
same order are needed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .words import WORD_BYTES

_MAP = np.frombuffer(bytes(0 if b == 32 else b for b in WORD_BYTES), np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROOT = np.uint64(0x100000001B3)  # odd, so it has an inverse
_BACK = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i + 1]], and where each text's words begin among them."""
    n = len(data)
    shown = _MAP[data]
    inside = shown != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    starts[begins] |= inside[begins]
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, offsets)
    if not len(at):
        return np.empty(0, np.uint64), first
    return mix(np.add.reduceat(_powers(_ROOT, n) * shown, at) * _powers(_BACK, n)[at]), first


def _powers(of: np.uint64, n: int) -> np.ndarray:
    """The powers 0 to n - 1."""
    if n <= 1 << 20:
        return _few_powers(of)[:n]
    out = np.full(n, of)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


@lru_cache(maxsize=2)
def _few_powers(of: np.uint64) -> np.ndarray:
    out = np.full(1 << 20, of)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def kmers(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes of all texts, and where each text's begin. Texts of 1 to k - 1 words have one k-mer: all of them."""
    n_words = np.diff(first)
    n_kmers = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(n_kmers)])
    total = int(begin[-1])
    if not total:
        return np.empty(0, np.uint64), begin
    text = np.repeat(np.arange(len(n_words)), n_kmers)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    h = np.zeros(len(words), np.uint64)
    for j in range(k):
        h = h * _ODD + padded[j : j + len(words)]
    left = np.repeat(first[1:], n_words) - np.arange(first[0], first[-1])  # words from here to the end of the text
    h = h[first[0] : first[-1]]
    if (n_words[n_words > 0] < k).any():
        # all of a short text, its first word's place standing for it, told from texts of other lengths
        at = first[:-1][(n_words > 0) & (n_words < k)]
        size = n_words[(n_words > 0) & (n_words < k)]
        whole = size.astype(np.uint64)
        for j in range(k):
            whole = whole * _ODD + np.where(j < size, padded[at + j], np.uint64(0))
        h[at - first[0]] = whole
        left[at - first[0]] = k
    h = mix(h[left >= k])
    # number equal k-mers of a text in text order; few are
    key = h + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    ordered = np.sort(key)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(repeated):
        among = np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)
        place = np.flatnonzero(repeated[among] == key)
        order = np.argsort(among[place], kind="stable")
        same = np.empty(len(place), bool)
        same[0] = False
        same[1:] = among[place][order[1:]] == among[place][order[:-1]]
        run = np.arange(len(place))
        earlier = run - np.maximum.accumulate(np.where(same, 0, run))
        h[place[order]] += earlier.astype(np.uint64) * _ODD
    return mix(h), begin


def order_min_hash(hashes: np.ndarray, begin: np.ndarray, sketches: int, take: int = 2, seed: int = 1) -> np.ndarray:
    """A (texts, sketches) table of keys, each of an ordered tuple of `take` least k-mers; rows of texts without k-mers are zeros."""
    n = len(begin) - 1
    out = np.zeros((n, sketches), np.uint64)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out
    at = begin[full]
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    place = np.arange(len(hashes), dtype=np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    factors = mix(np.arange(1, sketches + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) | np.uint64(1)
    for s in range(sketches):
        v = hashes * factors[s]
        v ^= v >> np.uint64(32)
        v *= _ODD
        v = (v & ~low) | place  # its place in the batch rides along
        places = []
        for _ in range(take):
            least = np.minimum.reduceat(v, at)
            gone = least == _LAST  # fewer k-mers than take
            p = (least & low).astype(np.int64)
            places.append(np.where(gone, np.iinfo(np.int64).max, p))
            v[p[~gone]] = _LAST
        places = np.sort(np.array(places), axis=0)
        key = np.full(len(full), s + 1, np.uint64)
        for p in places:
            key = mix(key * _ODD + np.where(p == np.iinfo(np.int64).max, np.uint64(7), hashes[np.minimum(p, len(hashes) - 1)]))
        out[full, s] = key
    return out
