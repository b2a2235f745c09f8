"""CRC-32 of many spans of a byte buffer at once by a position table.

The checksum is linear: a byte's contribution depends on its value and its distance from the end of its span alone, the contributions are combined by exclusive or,
and a constant for the length accounts for the initial value. Contributions come from a table of byte by distance and are folded with `bitwise_xor.reduceat`.
A span longer than the table is cut into blocks from its end; a block's value is moved past the next block by an operator for a whole block of zeros.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Distances that the table holds, and bytes of spans that are gathered at once.
DISTANCES, GATHERED = 512, 1 << 19
# Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contribution of a byte (second index) at a distance from the end (first); the state after each number of zero bytes, from the initial value;
    and the operator that moves a state past DISTANCES zero bytes, by place and value of the state's bytes."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(_POLYNOMIAL), row >> 1).astype(np.uint32)
    step = lambda state: (state >> np.uint32(8)) ^ row[state & np.uint32(0xFF)]  # noqa: E731  past one zero byte
    places = [row]
    for _ in range(DISTANCES - 1):
        places.append(step(places[-1]))
    lengths = [np.array([0xFFFFFFFF], np.uint32)]
    for _ in range(DISTANCES):
        lengths.append(step(lengths[-1]))
    moved = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(DISTANCES):
        moved = step(moved)
    return np.array(places), np.concatenate(lengths), moved


def _raw(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Combined contributions of non-empty spans of at most DISTANCES bytes."""
    table, size = tables()[0].ravel(), (ends - starts).astype(np.int64)
    out, stops = np.empty(len(starts), np.uint32), np.cumsum(size)
    low = 0
    while low < len(starts):
        done = int(stops[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(stops, done + GATHERED, side="right")))
        n = size[low:high]
        before = np.cumsum(n) - n
        inside = np.arange(int(n.sum()), dtype=np.int32)
        at = inside + np.repeat((starts[low:high] - before).astype(np.int64), n)
        away = np.repeat((before + n - 1).astype(np.int32), n) - inside
        out[low:high] = np.bitwise_xor.reduceat(table[(away << 8) | data[at]], before)
        low = high
    return out


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for every pair; an empty span gives 0."""
    _, lengths, moved = tables()
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero((size > 0) & (size <= DISTANCES))
    if len(short) == len(starts):
        return ~(_raw(data, starts, ends) ^ lengths[size])
    out[short] = ~(_raw(data, starts[short], ends[short]) ^ lengths[size[short]])
    # Longer spans: the first block is the short one; the state moves past every further block, which adds its own contributions.
    long = np.flatnonzero(size > DISTANCES)
    if len(long):
        blocks = -(-size[long] // DISTANCES)
        first = size[long] - (blocks - 1) * DISTANCES
        state = _raw(data, starts[long], starts[long] + first) ^ lengths[first]
        order = np.argsort(-blocks, kind="stable")
        at, state, left = (starts[long] + first)[order], state[order], blocks[order] - 1
        for k in range(int(left[0])):
            n = int(np.searchsorted(-left, -k, side="left"))  # spans with more than k blocks left
            low = at[:n] + k * DISTANCES
            s = state[:n]
            state[:n] = moved[0][s & 0xFF] ^ moved[1][(s >> 8) & 0xFF] ^ moved[2][(s >> 16) & 0xFF] ^ moved[3][s >> 24] ^ _raw(data, low, low + DISTANCES)
        out[long[order]] = ~state
    return out
