"""Words of many texts at once, as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D. ``WordTable`` holds
the words of a block of texts: byte spans, the first word of every text, and
a 64-bit identity per word (a wrapping polynomial over seeded byte codes,
finished by an avalanche). Equal words have equal identities; unequal ones
collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text in one block, so that arrays of eight bytes a character stay small.
BLOCK_BYTES = 1 << 19
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_SPACE = byte_set(SPACES)
_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_LOWER = _CODES.copy()
_LOWER[ord("A"):ord("Z") + 1] = _CODES[ord("a"):ord("z") + 1]


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below size; base is odd."""
    def row(b: int) -> np.ndarray:
        steps = np.full(size, np.uint64(b), dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)
    return row(base), row(pow(base, -1, 1 << 64))


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cached for ordinary blocks; made anew for a text beyond them."""
    room = BLOCK_BYTES + (1 << 14)
    up, down = _powers(base, room) if size <= room else _powers.__wrapped__(base, size)
    return up[:size], down[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """An invertible avalanche of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes together (or one long text)."""
    lo = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


class WordTable:
    """Words of the given texts. ``first[d]:first[d + 1]`` are the words of text d."""

    def __init__(self, texts: list[bytes], lower: bool = False, member: np.ndarray | None = None,
                 hashed: bool = True):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        inside = ~_SPACE[self.data] if member is None else member[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.n = np.diff(self.first)
        if hashed:
            up, down = powers(BYTE_BASE, len(self.data))
            self._total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER if lower else _CODES)[self.data] * up)))
            self._down = down
            self.hash = self.piece_hash(self.start, self.end)

    def piece_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Identities of byte spans."""
        return mix((self._total[end] - self._total[start]) * self._down[start] + (end - start).astype(np.uint64))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.n) - np.arange(len(self.start))


class Spans:
    """Identities of word runs from prefix sums over word identities."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = powers(WORD_BASE, len(hashes) + 1)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.up[:-1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every full run of ``width`` values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out
