"""Hashed words and k-word shingles of one text, for use inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of near-duplicate operators: runs of letters and digits, in lower case.
find_words = re.compile(r"[^\W_]+").findall

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; remembers up to 400,000 at a time."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = mark = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return mark


_hashes = WordHashes()


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_M = 0xD1342543DE82EF95
_M_INVERSE = pow(_M, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2 ** 64; they are kept."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _M), ("down", _M_INVERSE)):
            x = np.full(1 << max(10, n.bit_length()), base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def hashes_of_runs(codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the runs of codes that are inside: their hashes, starts and ends."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    marks = (sums[ends] - sums[starts]) * down[starts]
    return mixed(marks + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), starts, ends


_in_words: list[np.ndarray] = []


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the text's words (find_words of the lower-case text), without making the words."""
    if not _in_words:
        _in_words.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return hashes_of_runs(codes, _in_words[0][codes])[0] if len(codes) else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(marks: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k words in a row, by position; none if there are fewer than k words."""
    n = len(marks) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = marks[:n].copy()
    for i in range(1, k):
        out = out * MULTIPLIER + marks[i : i + n]
    return mixed(out)
