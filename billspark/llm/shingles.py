"""Hashes of words and word n-grams, in numpy over the bytes of an Arrow batch.

A word is a run of characters other than blank and ASCII control white space, A-Z lower-cased. Its
hash is two polynomials over its UTF-8 bytes modulo the prime 2^31 - 1, with bases of their own, taken from
prefix sums over the buffer and mixed to 64 bits; an n-gram's hash combines the hashes of its words. A power of
two as modulus would not do: there are words, however long, whose hashes agree for every base (those of the
Thue-Morse sequence). Two different n-grams of two texts agree by chance only, once in about 10^18.
Texts with fewer than n words have their whole sequence as the one n-gram; texts without words have none.

``word_hashes`` counts modulo 2^64; it is faster and serves where equal hashes only share a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at a time; a longer text is hashed alone.
AT_A_TIME = 500_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers without visible structure."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _WORD, heads: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """Hash of every word, and for each text where its words begin (n + 1 offsets).

    ``letters`` says for each lower-cased byte whether it belongs to a word. For each number of bytes in
    ``heads`` an array follows with the hash of each word's beginning (the whole of shorter words).
    """
    size = len(data)
    if not size:
        return (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), *[np.zeros(0, np.uint64)] * len(heads))
    low = _LOWER[data]
    word = letters[low]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:size]
    ends = word
    ends[:-1] = word[:-1] & (~word[1:] | edge[1:size])
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers, inverse = _powers(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[:size], out=sums[1:])
    back = inverse[starts]
    begun = [mix((sums[np.minimum(stops, starts + k)] - sums[starts]) * back) for k in heads]
    return (mix((sums[stops] - sums[starts]) * back), np.searchsorted(starts, offsets), *begun)


_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_181_783_497, 1_726_540_937)
_PRIME_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same remainder modulo 2^31 - 1."""
    return (x & _PRIME) + (x >> np.uint64(31))


def _prime_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each base and its inverse, the powers 0 to n - 1 modulo the prime."""
    if not _PRIME_POWERS or len(_PRIME_POWERS[0][0]) < n:
        made = []
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, int(_PRIME))):
                powers = np.ones(1, np.uint64)
                while len(powers) < n:
                    powers = np.concatenate([powers, powers * np.uint64(pow(b, len(powers), int(_PRIME))) % _PRIME])
                pair.append(powers)
            made.append((pair[0], pair[1]))
        _PRIME_POWERS[:] = made
    return _PRIME_POWERS


def strong_word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word modulo a prime, and for each text where its words begin (n + 1 offsets)."""
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    word = _WORD[low]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:size]
    ends = word
    ends[:-1] = word[:-1] & (~word[1:] | edge[1:size])
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    letters = low.astype(np.uint64) + np.uint64(1)
    both = np.zeros(len(starts), np.uint64)
    sums = np.zeros(size + 1, np.uint64)  # of numbers below 2^32, so of any text in memory
    for powers, inverse in _prime_powers(size + 1):
        np.cumsum(_folded(letters * powers[:size]), out=sums[1:])
        value = _folded(_folded(_folded(sums[stops] - sums[starts]))) % _PRIME
        both = (both << np.uint64(32)) | value * inverse[starts] % _PRIME
    return mix(both), np.searchsorted(starts, offsets)


def ngram_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram in order of the texts, and where each text's n-grams begin."""
    total = len(words)
    grams = np.zeros(total, np.uint64)
    for j in range(n):
        if j < total:
            grams[: total - j] += words[j:] * np.uint64((_BASE * (2 * j + 3)) % (1 << 64) | 1)
    counts = np.diff(at)
    valid = np.arange(total) + n <= np.repeat(at[1:], counts)
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        first = at[d]
        factors = np.array([(_BASE * (2 * j + 5)) % (1 << 64) | 1 for j in range(counts[d])], np.uint64)
        grams[first] = (words[first : at[d + 1]] * factors).sum(dtype=np.uint64) + np.uint64(counts[d])
        valid[first] = True
    kept = np.concatenate([[0], np.cumsum(valid)])
    return mix(grams[valid]), kept[at]


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``AT_A_TIME`` bytes: number of the first, bytes, offsets."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + AT_A_TIME, "right")) - 1
        last = min(max(last, first + 1), rows)
        low, high = offsets[first], offsets[last]
        yield first, data[low:high], offsets[first : last + 1] - low
        first = last


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By blocks of texts: number of the first text, n-gram hashes, where each text's begin."""
    for first, some, at in blocks(data, offsets):
        grams, begins = ngram_hashes(*strong_word_hashes(some, at), n)
        yield first, grams, begins


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for _, grams, begins in ngrams(data, offsets, n):
        for low, high in zip(begins[:-1].tolist(), begins[1:].tolist()):
            yield np.unique(grams[low:high])
