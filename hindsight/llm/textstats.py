"""Word hashes and shingle sets inside tasks (numpy over one text at a time)."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31, _S33 = (np.uint64(x) for x in (27, 30, 31, 33))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


class WordHashes(dict):
    """Word to 64-bit hash, remembered for up to ``limit`` words; then it starts afresh."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Words between the six spaces; ``bytes.split`` knows exactly those."""
    return text.encode("utf-8", "replace").split() if text else []


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text, A-Z lowered.

    A text with fewer words is one shingle, the whole sequence; without words the set is empty.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = hashes.of(words)
    if len(w) < width:
        whole = np.uint64(len(w))
        for x in w:
            whole = mix64(np.asarray([whole ^ x], np.uint64) * _M1 + np.uint64(1))[0]
        return np.asarray([whole], np.uint64)
    h = w[: len(w) - width + 1]
    for k in range(1, width):
        h = mix64(h * _M1 + w[k : len(w) - width + 1 + k])
    return np.unique(mix64(h + np.uint64(width)))
