"""Integers as bytes: zigzag, variable-length bytes, fixed-width bits, runs."""

from __future__ import annotations

import numpy as np


def zigzag(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.int64)
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def unzigzag(u: np.ndarray) -> np.ndarray:
    u = np.asarray(u, np.uint64)
    return (u >> np.uint64(1)).view(np.int64) ^ -((u & np.uint64(1)).view(np.int64))


def put_varints(u: np.ndarray) -> bytes:
    """Seven bits a byte, least first; the high bit says that more follow."""
    u = np.asarray(u, np.uint64)
    if not len(u):
        return b""
    most = max(1, -(-int(u.max()).bit_length() // 7))
    if most == 1:
        return u.astype(np.uint8).tobytes()
    size = np.ones(len(u), np.int64)
    for k in range(1, most):
        size += u >= np.uint64(1 << (7 * k))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(most):
        has = size > k
        part = ((u[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[(ends - size)[has] + k] = part | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def get_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    if raw[-1] & 128:
        raise ValueError("the last number is cut off")
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    size = last - first + 1
    if size.max() > 10:
        raise ValueError("a number is too long")
    out = np.zeros(len(last), np.uint64)
    for k in range(int(size.max())):
        has = size > k
        out[has] |= (raw[first[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def width(u: np.ndarray) -> int:
    """Bits of the largest."""
    return int(u.max()).bit_length() if len(u) else 0


_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def widths(u: np.ndarray) -> np.ndarray:
    """Bits of each."""
    return np.searchsorted(_POWERS, u, "right")


def pack(u: np.ndarray, bits: int) -> bytes:
    if not bits or not len(u):
        return b""
    u = np.asarray(u, np.uint64)
    return np.packbits(((u[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if not bits or not n:
        return np.zeros(n, np.uint64)
    need = -(-bits * n // 8)
    if len(data) < need:
        raise ValueError("packed bits are cut off")
    flat = np.unpackbits(np.frombuffer(data, np.uint8, need), bitorder="little")[: bits * n].reshape(n, bits).astype(np.uint64)
    return (flat << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs of equal values."""
    x = np.asarray(x)
    if not len(x):
        return x, np.empty(0, np.int64)
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    starts = np.concatenate(([0], cut))
    return x[starts], np.diff(np.concatenate((starts, [len(x)])))
