"""Word shingles as 64-bit numbers, many documents at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x ^= x >> np.uint64(29)
    x *= _ODD
    x ^= x >> np.uint64(32)
    return x


class _Words(dict):
    """Word -> number, forgotten when it has grown large."""

    limit = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_words = _Words()


def forget() -> None:
    """Drops the numbers of words, which a later stage on the same worker has no use for."""
    _words.clear()


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: runs of width lower-case words.

    A text of fewer words is one shingle of all its words; one without words has none.
    """
    found = [WORD.findall(t.lower()) for t in texts]
    flat = np.fromiter((_words[w] for words in found for w in words), np.uint64, sum(map(len, found)))
    out, at = [], 0
    power = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(width)]
    if len(flat) >= width:
        rolled = np.zeros(len(flat) - width + 1, np.uint64)
        for k in range(width):
            rolled += flat[k : k + len(rolled)] * power[k]
        rolled = mix(rolled)
    for words in found:
        n = len(words)
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            part = np.zeros(1, np.uint64)
            for k in range(n):
                part += flat[at + k : at + k + 1] * power[k]
            out.append(mix(part ^ np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out
