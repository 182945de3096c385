"""Hashes of words and word shingles of UTF-8 text, all positions at once with numpy.

A word's hash is a polynomial over its bytes modulo 2**64, taken from one running sum over the whole text:
(S[end] - S[start]) times the inverse base to the power of start. Texts are worked on in pieces that end
between words, so memory stays bounded however long a text is.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes that part words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE = 1 << 18
_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (the murmur finaliser's form)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash a word, in order; words are runs of bytes that aren't white space, A-Z taken as a-z."""
    data = np.frombuffer(text.translate(LOWER), np.uint8)
    space = _SPACE[data]
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not space[end]:
            step = np.flatnonzero(space[end : end + PIECE])
            end = end + int(step[0]) if len(step) else min(len(data), end + PIECE)
        parts.append(_piece(data[at:end], space[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _piece(data: np.ndarray, space: np.ndarray) -> np.ndarray:
    n = len(data)
    power, inverse = _powers(max(PIECE, 1 << n.bit_length()))
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of runs of k words; all words as one if there are fewer; empty without words."""
    words = word_hashes(text or b"")
    n = len(words)
    if not n:
        return words
    if n < k:
        return mix(np.sum(words * _PLACES[:n], keepdims=True) + np.uint64(n))
    total = words[: n - k + 1] * _PLACES[0]
    for i in range(1, k):
        total += words[i : n - k + 1 + i] * _PLACES[i]
    return np.unique(mix(total))
