"""Hashes of a text's word n-grams, as numpy arrays.

Words are runs without ASCII white space. A hash is a polynomial over bytes modulo
2**64, then mixed; it depends on the text alone, not on the process.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Odd multiplier of the polynomial, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bytes hashed at a time.
STRETCH = 1 << 20
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


POWERS, INVERSES = _powers(BASE, 4096), _powers(INVERSE, 4096)


def _stretch_words(data: np.ndarray) -> np.ndarray:
    global POWERS, INVERSES
    while len(POWERS) <= len(data):
        POWERS, INVERSES = _powers(BASE, 2 * len(POWERS)), _powers(INVERSE, 2 * len(INVERSES))
    edge = np.diff(np.concatenate([[True], SPACES[data], [True]]).astype(np.int8))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS[:len(data)])])
    return mixed((sums[end] - sums[first]) * INVERSES[first])


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    found, at = [], 0
    while at < len(data):
        end = at + STRETCH
        if end < len(data):  # cut at white space; a longer word is one stretch
            space = np.flatnonzero(SPACES[data[at:end]])
            if len(space):
                end = at + int(space[-1]) + 1
            else:
                space = np.flatnonzero(SPACES[data[end:]])
                end = end + int(space[0]) if len(space) else len(data)
        found.append(_stretch_words(data[at:end]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the runs of so many words. A shorter text with a word is one shingle."""
    hashes = word_hashes(text or "")
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(BASE) + hashes[k:k + len(total)]
    return np.unique(mixed(total))
