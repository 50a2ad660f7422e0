"""Codecs of doubles within an error bound, and of channels of 0 and 1."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from strandline.codecs.integers import Codec, Smallest, inflate

MAX_SAMPLES = 2_000_000


def finite_samples(x) -> np.ndarray:
    a = np.asarray(x)
    if a.dtype == bool or (a.dtype == object and any(isinstance(v, bool) for v in a)):
        raise ValueError("booleans are no samples")
    a = a.astype(np.float64)
    if len(a) > MAX_SAMPLES:
        raise ValueError("too many samples")
    if not np.isfinite(a).all():
        raise ValueError("the samples aren't finite")
    return a


class PiecewiseLinear:
    """Line segments within the tolerance of every sample: the cone of slopes that still serve is narrowed until it is empty."""

    name = "piecewise_linear"

    def __init__(self, tolerance: float):
        if not (math.isfinite(tolerance) and tolerance >= 0):
            raise ValueError("the tolerance must be finite and not negative")
        self.tolerance = tolerance

    def encode(self, x) -> bytes:
        x = finite_samples(x)
        segments, i, n = [], 0, len(x)
        while i < n:
            low, high, j = -math.inf, math.inf, i + 1
            start = float(x[i])
            while j < n:  # a doubling step: narrow by many samples at once, stop at the first that closes the cone
                k = min(n, j + max(16, j - i))
                run = np.arange(j - i, k - i)
                lows = np.maximum(np.maximum.accumulate((x[j:k] - self.tolerance - start) / run), low)
                highs = np.minimum(np.minimum.accumulate((x[j:k] + self.tolerance - start) / run), high)
                shut = np.flatnonzero(lows > highs)
                stop = int(shut[0]) if len(shut) else k - j
                if stop:
                    low, high = float(lows[stop - 1]), float(highs[stop - 1])
                j += stop
                if len(shut):
                    break
            slope = (low + high) / 2 if j > i + 1 else 0.0
            segments.append((i, j - i, start, start + slope * (j - i - 1)))
            i = j
        body = b"".join(struct.pack("<IIdd", *s) for s in segments)
        return struct.pack("<4sIdI", b"PLA1", n, self.tolerance, len(segments)) + zlib.compress(body, 9)

    def decode(self, data: bytes) -> np.ndarray:
        magic, n, _, k = struct.unpack_from("<4sIdI", data)
        if magic != b"PLA1" or n > MAX_SAMPLES or k > n:
            raise ValueError("the payload is of another codec or broken")
        body, out, at = inflate(data[20:], 24 * k), np.empty(n), 0
        for i, m, a, b in struct.iter_unpack("<IIdd", body):
            if i != at or at + m > n or not m:
                raise ValueError("segments don't follow each other")
            out[i : i + m] = a + (b - a) * np.arange(m) / max(m - 1, 1)
            at += m
        if at != n:
            raise ValueError("the payload is cut off")
        return out


class QuantizedDelta:
    """Steps of twice the tolerance, half to even, as 32-bit differences, deflated."""

    name = "quantized_delta"

    def __init__(self, tolerance: float):
        if not (math.isfinite(tolerance) and tolerance > 0):
            raise ValueError("the tolerance must be a finite positive number")
        self.tolerance = tolerance

    def encode(self, x) -> bytes:
        x = finite_samples(x)
        q = np.rint(x / (2 * self.tolerance))
        if len(q) and np.abs(q).max() >= 2**62:
            raise ValueError("a value is too large for the tolerance")
        q = q.astype(np.int64)
        d = np.diff(q)
        if len(d) and np.abs(d).max() > 2**31 - 1:
            raise ValueError("a difference is too large")
        first = int(q[0]) if len(q) else 0
        return struct.pack("<4sIdq", b"QDL1", len(q), self.tolerance, first) + zlib.compress(d.astype("<i4").tobytes(), 9)

    def decode(self, data: bytes) -> np.ndarray:
        magic, n, tolerance, first = struct.unpack_from("<4sIdq", data)
        if magic != b"QDL1" or n > MAX_SAMPLES:
            raise ValueError("the payload is of another codec or broken")
        if not n:
            return np.empty(0)
        d = np.frombuffer(inflate(data[24:], 4 * (n - 1)), "<i4").astype(np.int64)
        if len(d) != n - 1:
            raise ValueError("the payload is cut off")
        return np.cumsum(np.concatenate(([first], d))) * (2 * tolerance)


class Binary:
    """Channels of 0 and 1."""

    name = "binary"

    def encode(self, x) -> bytes:
        x = finite_samples(x)
        if not np.isin(x, (0, 1)).all():
            raise ValueError("a value is neither 0 nor 1")
        return struct.pack("<4sI", b"BIN1", len(x)) + zlib.compress(x.astype(np.uint8).tobytes(), 9)

    def decode(self, data: bytes) -> np.ndarray:
        magic, n = struct.unpack_from("<4sI", data)
        if magic != b"BIN1" or n > MAX_SAMPLES:
            raise ValueError("the payload is of another codec or broken")
        raw = np.frombuffer(inflate(data[8:], n), np.uint8)
        if len(raw) != n or (raw > 1).any():
            raise ValueError("the payload is broken")
        return raw.astype(np.float64)


class Decimal:
    """Doubles rounded to some places, half to even, by an integer codec: the error is at most half a unit of the last place."""

    name = "decimal"

    def __init__(self, places: int = 6, codec: Codec | None = None):
        if not 0 <= places <= 9:
            raise ValueError("places are 0 to 9")
        self.places, self.codec = places, codec or Smallest()

    def encode(self, x) -> bytes:
        scaled = np.rint(finite_samples(x) * 10.0**self.places)
        if len(scaled) and np.abs(scaled).max() >= 2**62:
            raise ValueError("a value is too large for the places")
        return struct.pack("<B", self.places) + self.codec.encode(scaled.astype(np.int64))

    def decode(self, data: bytes) -> np.ndarray:
        return self.codec.decode(data[1:]) / 10.0 ** data[0]


class RawDouble:
    name = "raw"

    def encode(self, x) -> bytes:
        return np.asarray(x, "<f8").tobytes()

    def decode(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, "<f8").astype(np.float64)


class BytePlanes:
    """Doubles within 10^-places as integers whose differences are stored byte plane by byte plane, deflated."""

    name = "byte_planes"

    def __init__(self, places: int = 6):
        self.places = places

    def encode(self, x) -> bytes:
        from strandline.codecs import bits

        q = np.rint(finite_samples(x) * 10.0**self.places).astype(np.int64)
        u = bits.zigzag(np.diff(q, prepend=0))
        return struct.pack("<BI", self.places, len(q)) + zlib.compress(u.view(np.uint8).reshape(-1, 8).T.tobytes(), 6)

    def decode(self, data: bytes) -> np.ndarray:
        from strandline.codecs import bits

        places, n = struct.unpack_from("<BI", data)
        planes = np.frombuffer(inflate(data[5:], 8 * n), np.uint8).reshape(8, n)
        return np.cumsum(bits.unzigzag(np.ascontiguousarray(planes.T).view(np.uint64).ravel())) / 10.0**places


def smallest(x, codecs: list) -> tuple[str, bytes]:
    """Name and payload of the codec with the shortest payload; of equal ones the first. What several choose from is tried once."""
    best, tried = None, set()
    for c in codecs:
        most = len(best[1]) if best else None
        payload = c.shorter(x, most, tried) if hasattr(c, "shorter") else c.encode(x)
        if payload is not None and (best is None or len(payload) < most):
            best = c.name, payload
    return best
