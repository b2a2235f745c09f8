"""Words and shingles of Arrow string columns as 64-bit hashes, for all texts of a block at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is a block of its own.
BLOCK = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII characters but letters and digits.
NO_WORD = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32
_PLAIN = np.arange(256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _powers[at] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts of one block: hash, byte range, and the range of words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE):
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~space[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        powers, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER if lower else _PLAIN)[data] * powers[:n], out=sums[1:])
        self.hashes = mix64((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.offsets = np.searchsorted(self.starts, offsets)
        self._sums, self._inverse = sums, inverse

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words of at least `size` bytes, and hashes of their first `size` bytes."""
        at = np.flatnonzero(self.ends - self.starts >= size)
        low = self.starts[at]
        return at, mix64((self._sums[low + size] - self._sums[low]) * self._inverse[low] + np.uint64(size))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of `width` consecutive words and their offsets per text. A text of fewer words gives one shingle of all its words, one without words none."""
        counts = np.diff(self.offsets)
        rolled = np.zeros(max(len(self.hashes) - width + 1, 0), dtype=np.uint64)
        for k in range(width):
            rolled += self.hashes[k : k + len(rolled)] * np.uint64(pow(_BASE, 2 * k + 3, 1 << 64))
        valid = np.repeat(counts >= width, counts)
        place = np.arange(len(self.hashes)) - np.repeat(self.offsets[:-1], counts)
        first = valid & (place <= np.repeat(counts, counts) - width)
        short = ~valid & (place == 0)
        hashes = np.zeros(len(self.hashes), dtype=np.uint64)
        hashes[: len(rolled)] = mix64(rolled)
        for at in np.flatnonzero(short):
            run = self.hashes[at : at + counts[np.searchsorted(self.offsets, at, side="right") - 1]]
            total = np.uint64(len(run))
            for h in run:
                total = mix64((total * np.uint64(_BASE)) ^ h)
            hashes[at] = total
        keep = first | short
        sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
        return hashes[keep], np.concatenate([[0], np.cumsum(sizes)])


def sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    with np.errstate(over="ignore"):
        for _, data, offsets in blocks(texts):
            hashes, bounds = Words(data, offsets).shingles(width)
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield np.unique(hashes[a:b])
