"""Hash mixing and byte-plane compression of numbers, shared by the operators."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def squeeze(x: np.ndarray) -> bytes:
    """Numbers from 0 on as zstd bytes of each of their byte planes; planes above the largest number are left out."""
    top = -(-int(x.max(initial=0)).bit_length() // 8)
    width = 4 if top <= 4 else 8
    raw = np.ascontiguousarray(x, dtype=f"<u{width}").view(np.uint8).reshape(-1, width)
    parts = [pa.compress(np.ascontiguousarray(raw[:, i]).tobytes(), codec="zstd", asbytes=True) for i in range(top)]
    return struct.pack(f"<IB{top}I", len(x), top, *map(len, parts)) + b"".join(parts)


def unsqueeze(data: bytes) -> np.ndarray:
    """As 32-bit numbers where they fit."""
    n, top = struct.unpack_from("<IB", data)
    sizes = struct.unpack_from(f"<{top}I", data, 5)
    width = 4 if top <= 4 else 8
    raw, at = np.zeros((n, width), np.uint8), 5 + 4 * top
    for i, size in enumerate(sizes):
        raw[:, i] = np.frombuffer(pa.decompress(data[at : at + size], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
        at += size
    return raw.view(f"<u{width}").ravel()


def squeeze_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers, as the first one and the steps."""
    return squeeze(np.diff(np.asarray(x, np.uint64), prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data), dtype=np.uint64)
