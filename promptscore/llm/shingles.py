"""Vectorised hashes of the words and word shingles of many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_SPACE = _BYTE == 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of several texts: the texts' bytes joined by spaces, and each word's bounds, text and hash.

    Hashes are of the word in ASCII lower case. With ``marks`` a full stop or comma that ends a word after
    an ASCII letter is a word of its own.
    """

    def __init__(self, texts: Sequence[str | None], marks: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.joined = b" " + b" ".join(raw) + b" "
        data = _LOWER[np.frombuffer(self.joined, np.uint8)]
        space = _SPACE[data]
        begins, stops = space[:-1] & ~space[1:], ~space[:-1] & space[1:]  # after the byte at this place
        if marks:
            mark = (data == 44) | (data == 46)
            letter = (data >= 97) & (data <= 122)
            ending = letter[:-2] & mark[1:-1] & space[2:]
            begins[:-1] |= ending
            stops[:-1] |= ending
        self.starts, self.ends = np.flatnonzero(begins) + 1, np.flatnonzero(stops) + 1
        bounds = np.cumsum([0, *[len(r) + 1 for r in raw[:-1]]]) + 1
        self.owner = np.searchsorted(bounds, self.starts, side="right") - 1
        sizes = self.ends - self.starts
        if not len(sizes):
            self.hashes = np.zeros(0, np.uint64)
            return
        first = np.cumsum(sizes) - sizes
        powers = np.cumprod(np.full(int(sizes.max()) + 1, _STEP, np.uint64))
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        values = _BYTE[data[~space]] * powers[place]
        self.hashes = mix(np.add.reduceat(values, first) ^ sizes.astype(np.uint64))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII lower case) of the texts in order, and the text number of each word."""
    words = Words(texts)
    return words.hashes, words.owner


def shingle_hashes(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within one text, and the text number of each."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * _STEP + words[k : k + n]
        h ^= h >> np.uint64(29)
    same = owner[:n] == owner[size - 1 :]
    return mix(h[same]), owner[:n][same]


def portions(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about ``limit`` in all; a larger row is a range of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
