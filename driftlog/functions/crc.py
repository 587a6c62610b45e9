"""CRC-32C of many byte strings at once.

A CRC without its initial and final inversion is linear, and zeros in front do not change it. So every string is laid out
behind zeros in a power of two of lanes, all lanes go through the table step by step together, and neighbours are joined
by moving the left one's remainder over the right one's length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLYNOMIAL = 0x82F63B78
LANE = 64
ONES = np.uint32(0xFFFFFFFF)


@lru_cache(1)
def table() -> np.ndarray:
    """Remainder of each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


def apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map, given by its values for each byte at each of four places."""
    return tables[0][x & 255] ^ tables[1][(x >> np.uint32(8)) & 255] ^ tables[2][(x >> np.uint32(16)) & 255] ^ tables[3][x >> np.uint32(24)]


@lru_cache(64)
def shift(level: int) -> np.ndarray:
    """The map that moves a remainder over LANE * 2^level zero bytes."""
    x = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    if level == 0:
        for _ in range(LANE):
            x = (x >> np.uint32(8)) ^ table()[x & 255]
        return x
    half = shift(level - 1)
    return apply(half, apply(half, x))


def remainders(lanes: np.ndarray) -> np.ndarray:
    """Remainder of each row of bytes."""
    t, c = table(), np.zeros(len(lanes), np.uint32)
    for k in range(lanes.shape[1]):
        c = t[(c ^ lanes[:, k]) & 255] ^ (c >> np.uint32(8))
    return c


def crc32c_many(blobs: list[bytes], most_bytes: int = 1 << 24) -> np.ndarray:
    """CRC-32C of each, as uint32. A string is followed by no more zeros than its own length and a lane's."""
    out = np.zeros(len(blobs), np.uint32)
    by: dict[int, list[int]] = {}
    for i, b in enumerate(blobs):
        if len(b) < 4:
            c = int(ONES)
            for x in b:
                c = int(table()[(c ^ x) & 255]) ^ (c >> 8)
            out[i] = c ^ int(ONES)
        else:
            by.setdefault(max(0, (-(-len(b) // LANE) - 1).bit_length()), []).append(i)
    for level, rows in by.items():
        width = LANE << level
        step = max(1, most_bytes // width)
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            m = np.zeros((len(part), width), np.uint8)
            for k, i in enumerate(part):
                m[k, width - len(blobs[i]) :] = np.frombuffer(blobs[i], np.uint8)
                m[k, width - len(blobs[i]) : width - len(blobs[i]) + 4] ^= 255  # the initial inversion
            r = remainders(m.reshape(-1, LANE)).reshape(len(part), -1)
            for k in range(level):
                r = apply(shift(k), r[:, 0::2]) ^ r[:, 1::2]
            out[part] = r[:, 0] ^ ONES
    return out
