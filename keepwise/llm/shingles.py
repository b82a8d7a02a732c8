"""Word shingles of whole texts as 64-bit hashes, in NumPy over many texts at once.

Words are maximal runs of non-space bytes after lower-casing A-Z; a shingle is
``SHINGLE`` consecutive words, and a text with fewer words is one shingle. A word
hashes to a sum of per-byte random numbers times powers of an odd base, finished
by a bit mixer, a shingle to a mixed weighted sum of its words' hashes. Two
different shingles agree with probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE = 5
CHUNK_BYTES = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(51_9141))
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_WEIGHT = _RNG.integers(1, 2**64 - 1, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a byte buffer."""
    inside = ~_SPACE[buf]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    length = end - start
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _BASE, dtype=np.uint64))
    value = _BYTE[buf[inside]] * power[place]
    return start, mix(np.add.reduceat(value, first) + length.astype(np.uint64))


def shingle_sets(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order (empty without words)."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append((t or "").encode("utf-8", "replace").lower())
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield from _sets_of(held)
            held, size = [], 0
    if held:
        yield from _sets_of(held)


def _sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    # bytes.lower changes A-Z only; a space between texts keeps their words apart
    buf = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    start, h = _word_hashes(buf)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(start, ends)
    sums = h.copy() if len(h) < SHINGLE else sum(
        (h[k:len(h) - SHINGLE + 1 + k] * _WEIGHT[k] for k in range(SHINGLE)), np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64))
    whole = mix(sums)
    low = 0
    for high in cut:
        n = high - low
        if n >= SHINGLE:
            yield np.unique(whole[low:high - SHINGLE + 1])
        elif n:
            yield mix((h[low:high] * _WEIGHT[:n]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(n))
        else:
            yield np.zeros(0, dtype=np.uint64)
        low = high


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: equal sets agree, others practically never."""
    with np.errstate(over="ignore"):
        a = mix(s ^ np.uint64(0x6A09E667F3BCC908)).sum(dtype=np.uint64)
        b = mix(s + np.uint64(0xBB67AE8584CAA73B)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
