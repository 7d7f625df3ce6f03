"""Hashes of word shingles, for many texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from . import common

#: Distinct words kept in a worker before the table starts anew.
KEPT_WORDS = 300_000
#: Odd multipliers of the places in a shingle.
PLACES = np.array([int.from_bytes(xxhash.xxh64_digest(b"place", i), "big") | 1 for i in range(16)], np.uint64)


class WordHashes(dict):
    """A 64-bit hash by the word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes() -> WordHashes:
    return common.worker_table(("word hashes",), WordHashes)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case: runs of bytes that are no ASCII white space."""
    return (text or "").encode().lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """``x`` (uint64) with every bit spread over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(values: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``k`` values inside its text (the whole text as one if shorter, none if empty); how many each text has."""
    n = len(values)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    starts = np.cumsum(sizes) - sizes
    at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    padded = np.concatenate([values, np.zeros(k, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    left = np.repeat(np.minimum(sizes, k), counts)
    short = bool((sizes < k).any())
    for i in range(k if n else 0):
        part = padded[at + i] * PLACES[i]
        out += np.where(left > i, part, np.uint64(0)) if short else part
    return mixed(out + left.astype(np.uint64)), counts


def hashes(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ``k``-word shingles of each text, repeats included, and how many each text has."""
    table = word_hashes()
    if len(table) > KEPT_WORDS:
        table.clear()
    found = [np.fromiter(map(table.__getitem__, words), np.uint64, len(words)) for words in map(words_of, texts)]
    return rolled(np.concatenate(found) if found else np.zeros(0, np.uint64), np.array(list(map(len, found)), np.int64), k)
