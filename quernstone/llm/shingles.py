"""Word shingles as 64-bit sets."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd 64-bit multipliers.
ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)


class Words(dict):
    """64-bit hashes of words, remembered; emptied when it holds ``most``."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * ODD[1]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, memo: Words, size: int = 5) -> np.ndarray:
    """Distinct hashes, sorted, of the ``size``-word shingles of a text in lower case (A-Z only).

    Fewer words: the whole sequence as one shingle.  None or no words: empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    x = memo.hashes(words)
    k = min(n, size)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = out * ODD[3] + mix(x[j : n - k + 1 + j] + ODD[j % 5])
    return np.unique(mix(out))
