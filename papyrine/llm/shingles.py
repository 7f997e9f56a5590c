"""Words and shingle hashes of whole batches of texts, in vector operations."""

from __future__ import annotations

import re
import zlib

import numpy as np

WORD = re.compile(r"[^\W_]+")
#: Words a worker remembers the hashes of before it starts anew (memory bound only).
REMEMBERED = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_known: dict[str, int] = {}


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits in lower case."""
    return WORD.findall(text.lower())


def _hash(word: str) -> int:
    b = word.encode()
    h = (zlib.crc32(b) << 32) | zlib.crc32(b[::-1], 0x5BD1E995)
    _known[word] = h
    return h


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_known) > REMEMBERED:
        _known.clear()
    out = list(map(_known.get, words))
    if None in out:
        out = [(_known.get(w) or _hash(w)) if h is None else h for w, h in zip(words, out)]
    h = np.array(out, np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of runs of ``k`` words sorted inside each text, number per text)."""
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    owner_words = np.repeat(np.arange(len(texts)), sizes)
    h = word_hashes([w for x in lists for w in x])
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = s * _MIX + h[j : j + n]
        s ^= s >> np.uint64(29)
    whole = owner_words[:n] == owner_words[k - 1 :]
    s, owner = s[whole], owner_words[:n][whole]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[first], np.bincount(owner[first], minlength=len(texts)).astype(np.int64)
