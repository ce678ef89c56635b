"""Words of a text as 64-bit hashes, and hashes of word n-grams."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # multipliers of a published 64-bit mixer


class WordHash(dict):
    """Word -> hash, remembered for short words within a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) > 1 << 17:
                self.clear()
            self[word] = h
        return h


_HASH = WordHash()


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8."""
    return text.encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def gram_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """One hash for every n consecutive symbols: a polynomial in M1, put together from those of half as many symbols."""
    count = len(symbols) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    s = symbols.astype(np.uint64)
    h, span, power = s, 1, M1  # power: M1 to the span
    with np.errstate(over="ignore"):
        for bit in bin(n)[3:]:
            h, span, power = h[:-span] * power + h[span:], 2 * span, power * power
            if bit == "1":
                h, span, power = h[:-1] * M1 + s[span:], span + 1, power * M1
    return mixed(h)
