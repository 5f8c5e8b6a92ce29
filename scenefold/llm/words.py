"""Words and shingle hashes of UTF-8 texts, vectorised over a batch."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

STEP = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(0xD6E8FEB86659FD93)

#: A-Z lower-cased; every other ASCII byte that is no digit and no letter becomes a space.
PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def spaced_words(text: bytes) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased (bytes know no other letters)."""
    return text.lower().split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(PLAIN).split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the word."""
    values = values ^ (values >> np.uint64(32))
    values = values * FOLD
    values = values ^ (values >> np.uint64(29))
    values = values * STEP
    return values ^ (values >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    folded = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        folded = mixed(folded * STEP + hashes[k : k + n])
    return folded


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``size`` are one shingle, none is none."""
    if not len(hashes):
        return hashes
    return np.unique(shingle_hashes(hashes, min(size, len(hashes))))
