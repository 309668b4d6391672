"""Word and shingle hashing of whole texts, vectorised over a batch.

A word is a maximal run of characters outside space and U+0009..U+000D, after
lower-casing A-Z only. Both rules are byte rules in UTF-8, so a batch is hashed
as one byte array: a polynomial prefix sum gives the hash of every word, and a
weighted sum over ``width`` consecutive words, then mixed, the hash of every
shingle. All arithmetic is modulo 2**64. A text with fewer than ``width`` words
has one shingle, the whole sequence; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes hashed together; one longer text makes a longer piece.
PIECE = 1 << 19

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[ord("A") : ord("Z") + 1] += 32
_TABLE[9:14] = 32
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_WEIGHTS = np.array([((2 * j + 3) * 0x9FB21C651E98DF25 | 1) % (1 << 64) for j in range(64)], np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n > 8 * PIECE:
            return have
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def pieces(texts: list[str | None], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` characters; a text is never split."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text in order, and where each text begins (one more at the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = _TABLE[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    space = data == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * _power_table(_P, len(data)), out=sums[1:])
    hashes = (sums[end] - sums[begin]) * _power_table(_P_INV, len(data))[begin]
    at = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
    return mix(hashes), np.searchsorted(begin, at)


def sequence(hashes: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle at every word that begins one, and where each text's shingles begin.

    The hash of a short text's only shingle also depends on its length.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(n)])
    if not len(hashes):
        return np.zeros(0, np.uint64), starts
    padded = np.concatenate([hashes, np.zeros(width - 1, np.uint64)])
    total = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            total += padded[j : j + len(hashes)] * _WEIGHTS[j]
        left = np.repeat(bounds[1:], counts) - np.arange(len(hashes))
        keep = left >= width
        short = np.flatnonzero((counts > 0) & (counts < width))
        for i in short:
            a, b = bounds[i], bounds[i + 1]
            total[a] = (hashes[a:b] * _WEIGHTS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a) * _P
            keep[a] = True
    return mix(total[keep]), starts



def distinct(hashes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each text's shingle hashes."""
    return [np.unique(hashes[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
