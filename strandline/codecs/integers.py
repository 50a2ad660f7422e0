"""Lossless codecs of 64-bit integers. Each has encode(array) -> bytes and decode(bytes) -> array; differences wrap as int64 does."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

from strandline.codecs import bits

#: What a payload may unpack to.
MAX_VALUES = 1 << 26
_HEAD = struct.Struct("<4sI")


def inflate(data: bytes, most: int) -> bytes:
    """zlib data of at most `most` bytes; longer, cut off or trailing data is an error."""
    engine = zlib.decompressobj()
    out = engine.decompress(data, most + 1)
    if len(out) > most:
        raise ValueError("the payload unpacks to too much")
    if not engine.eof:
        raise ValueError("the payload is cut off")
    if engine.unused_data:
        raise ValueError("data follow the payload")
    return out


def integers(x) -> np.ndarray:
    """x as int64; booleans, fractions and values beyond 64 bits are errors."""
    a = np.asarray(x)
    if not len(a):
        return np.empty(0, np.int64)
    if a.dtype.kind not in "iu" or (a.dtype.kind == "u" and int(a.max()) >= 1 << 63):
        raise ValueError("the values aren't 64-bit integers")
    return a.astype(np.int64)


class Codec:
    magic = b"????"

    def body(self, x: np.ndarray) -> bytes:
        raise NotImplementedError

    def values(self, data: bytes, n: int) -> np.ndarray:
        raise NotImplementedError

    def least(self, x: np.ndarray) -> int:
        """Bytes that encode makes of x at least; cheaper than making them."""
        return 0

    def encode(self, x) -> bytes:
        x = integers(x)
        return _HEAD.pack(self.magic, len(x)) + (self.body(x) if len(x) else b"")

    def decode(self, data: bytes) -> np.ndarray:
        if len(data) < _HEAD.size:
            raise ValueError("the payload is cut off")
        magic, n = _HEAD.unpack_from(data)
        if magic != self.magic:
            raise ValueError("the payload is of another codec")
        if n > MAX_VALUES:
            raise ValueError("the payload holds too many values")
        if not n:
            return np.empty(0, np.int64)
        x = self.values(data[_HEAD.size :], n)
        if len(x) != n:
            raise ValueError("the payload holds another number of values")
        return x


class Raw(Codec):
    magic = b"RAWI"

    def least(self, x):
        return _HEAD.size + 8 * len(x)

    def body(self, x):
        return x.astype("<i8").tobytes()

    def values(self, data, n):
        if len(data) != 8 * n:
            raise ValueError("the payload has another length")
        return np.frombuffer(data, "<i8").astype(np.int64)


class Runs(Codec):
    """Runs as value and length."""

    magic = b"RLEI"

    def least(self, x):
        return _HEAD.size + 2 * (1 + int(np.count_nonzero(x[1:] != x[:-1]))) if len(x) else _HEAD.size

    def body(self, x):
        value, length = bits.runs(x)
        return bits.put_varints(np.column_stack((bits.zigzag(value), length.astype(np.uint64))).ravel())

    def values(self, data, n):
        flat = bits.get_varints(data).reshape(-1, 2)
        if int(flat[:, 1].sum()) != n:
            raise ValueError("the payload holds another number of values")
        return np.repeat(bits.unzigzag(flat[:, 0]), flat[:, 1].astype(np.int64))


class DeltaVarint(Codec):
    """The first value, then differences, as variable-length bytes, deflated."""

    magic = b"DVRI"
    order = 1

    def body(self, x):
        with np.errstate(over="ignore"):
            d = np.concatenate([[x[0]], np.diff(x)]) if self.order == 1 else self._second(x)
        return zlib.compress(bits.put_varints(bits.zigzag(d)), 6)

    @staticmethod
    def _second(x):
        d = np.concatenate(([x[0]], np.diff(x)))
        return np.concatenate((d[:1], np.diff(d)))

    def values(self, data, n):
        d = bits.unzigzag(bits.get_varints(inflate(data, 10 * n)))
        for _ in range(self.order):
            d = np.cumsum(d)
        return d


class SecondDifference(DeltaVarint):
    magic = b"DD2I"
    order = 2

    def values(self, data, n):
        return np.cumsum(np.cumsum(bits.unzigzag(bits.get_varints(inflate(data, 10 * n)))))


class DeltaBits(Codec):
    """Blocks of differences less their smallest, in the bits of the largest."""

    magic = b"DBPI"
    block = 128
    order = 1

    def least(self, x):
        """The very size: each block's width follows from its least and greatest difference."""
        if len(x) <= self.order:
            return _HEAD.size
        d = np.diff(x, self.order)
        starts = np.arange(0, len(d), self.block)
        w = bits.widths(np.maximum.reduceat(d, starts).view(np.uint64) - np.minimum.reduceat(d, starts).view(np.uint64))
        return _HEAD.size + 1 + 8 * self.order + int((9 + (w * np.minimum(self.block, len(d) - starts) + 7) // 8).sum())

    def body(self, x):
        d = x
        firsts = []
        for _ in range(self.order):
            firsts.append(int(d[0]))
            d = np.diff(d)
            if not len(d):
                break
        out = [struct.pack("<B", len(firsts)), struct.pack(f"<{len(firsts)}q", *firsts)]
        for low in range(0, len(d), self.block):
            part = d[low : low + self.block]
            base = int(part.min())
            over = (part.view(np.uint64) - np.uint64(base % (1 << 64))).astype(np.uint64)
            w = bits.width(over)
            out.append(struct.pack("<qB", base, w) + bits.pack(over, w))
        return b"".join(out)

    def values(self, data, n):
        k = data[0]
        firsts, at, left, parts = struct.unpack_from(f"<{k}q", data, 1), 1 + 8 * k, n - k, []
        while left > 0:
            m = min(left, self.block)
            base, w = struct.unpack_from("<qB", data, at)
            at += 9
            over = bits.unpack(data[at:], w, m)
            at += -(-w * m // 8)
            parts.append((over + np.uint64(base % (1 << 64))).view(np.int64))
            left -= m
        d = np.concatenate(parts) if parts else np.empty(0, np.int64)
        for first in reversed(firsts):
            d = np.cumsum(np.concatenate(([first], d)))
        return d


class DeltaOfDelta(DeltaBits):
    magic = b"DODI"
    order = 2


@lru_cache(1 << 10)
def _cuts(n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of n differences may be apart at both ends."""
    cuts = sorted({0, *[int(n * q) for q in (0.01, 0.02, 0.05, 0.1, 0.2)]})
    return tuple(np.array([(a, b) for a in cuts for b in cuts if a + b < n], np.int64).T)


class OutlierBits(Codec):
    """Blocks of differences in three bands: the few lowest and highest apart from the bulk, each in bits of its own width.

    Thresholds are searched over the differences' quantiles of bit width; where the outliers are is a bitmap or a list, which is shorter.
    """

    magic = b"OBPI"
    block = 512

    def least(self, x):
        return _HEAD.size + 8 + sum(self._best(d)[0] for d in self._parts(x)) if len(x) else _HEAD.size

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        d = np.diff(x)
        return [d[low : low + self.block] for low in range(0, len(d), self.block)]

    def body(self, x):
        return b"".join([struct.pack("<q", int(x[0])), *[self._bands(d, *self._best(d)[1:]) for d in self._parts(x)]])

    @classmethod
    def _best(cls, d: np.ndarray) -> tuple[int, int, int]:
        """The fewest bytes that _bands makes, and the thresholds of which it makes them."""
        a, b = _cuts(len(d))
        order = np.sort(d)
        low, high = order[a], order[len(d) - 1 - b]
        size = cls._size(d, order, low, high)
        k = int(size.argmin())
        return int(size[k]), low[k], high[k]

    @staticmethod
    def _size(d: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Bytes that _bands makes, for each low and high (arrays or one): each band's width follows from its least and greatest difference, so only the shortest is packed."""
        n, under, upto = len(d), np.searchsorted(order, low), np.searchsorted(order, high, "right")
        listed = 2 * (under + n - upto)
        if n > 128:  # places that take two bytes in a list
            far = np.sort(d[128:])
            listed += np.searchsorted(far, low) + n - 128 - np.searchsorted(far, high, "right")
        size = 30 + np.minimum((2 * n + 7) // 8, listed)
        zero, all_ = np.zeros_like(under), np.full_like(under, n)
        start, end = np.stack((under, zero, upto)), np.stack((upto, under, all_))
        own = order.view(np.uint64)
        w = np.where(end > start, bits.widths(own[end - 1] - own[np.minimum(start, n - 1)]), 0)
        return size + ((w * (end - start) + 7) // 8).sum(axis=0)

    @staticmethod
    def _bands(d: np.ndarray, low: int, high: int) -> bytes:
        band = np.where(d < low, 1, np.where(d > high, 2, 0))
        out, flags = [], np.flatnonzero(band)
        bitmap = bits.pack(band.astype(np.uint64), 2)
        listed = bits.put_varints(np.column_stack((flags.astype(np.uint64), band[flags].astype(np.uint64))).ravel())
        where = struct.pack("<BH", 0, len(bitmap)) + bitmap if len(bitmap) < len(listed) else struct.pack("<BH", 1, len(listed)) + listed
        for k in range(3):
            part = d[band == k]
            if not len(part):
                out.append(struct.pack("<qB", 0, 0))
                continue
            base = int(part.min())
            over = part.view(np.uint64) - np.uint64(base % (1 << 64))
            w = bits.width(over)
            out.append(struct.pack("<qB", base, w) + bits.pack(over, w))
        return where + b"".join(out)

    def values(self, data, n):
        first, at, left, parts = struct.unpack_from("<q", data)[0], 8, n - 1, []
        while left > 0:
            m = min(left, self.block)
            kind, size = struct.unpack_from("<BH", data, at)
            where, at = data[at + 3 : at + 3 + size], at + 3 + size
            if kind == 0:
                band = bits.unpack(where, 2, m).astype(np.int64)
            else:
                flat = bits.get_varints(where).reshape(-1, 2).astype(np.int64)
                band = np.zeros(m, np.int64)
                band[flat[:, 0]] = flat[:, 1]
            d = np.empty(m, np.int64)
            for k in range(3):
                base, w = struct.unpack_from("<qB", data, at)
                at += 9
                count = int((band == k).sum())
                d[band == k] = (bits.unpack(data[at:], w, count) + np.uint64(base % (1 << 64))).view(np.int64)
                at += -(-w * count // 8)
            parts.append(d)
            left -= m
        return np.cumsum(np.concatenate([[first], *parts]))


class Smallest(Codec):
    """The shortest payload of several codecs; of equal ones the first."""

    magic = b"BEST"

    def __init__(self, codecs: list[Codec] | None = None):
        self.codecs = codecs or [DeltaVarint(), SecondDifference()]

    def encode(self, x):
        return self.shorter(integers(x), None, set())

    def shorter(self, x: np.ndarray, most: int | None, tried: set[type]) -> bytes | None:
        """The shortest payload, if it is shorter than most; codecs that were tried on x already are left out, and none is made of which the least size tells that it isn't shorter."""
        best = None
        for codec in self.codecs:
            if type(codec) in tried:
                continue
            tried.add(type(codec))
            if most is not None and codec.least(x) >= most:
                continue
            payload = codec.encode(x)
            if most is None or len(payload) < most:
                best, most = payload, len(payload)
        return best

    def decode(self, data):
        for codec in self.codecs:
            if data[:4] == codec.magic:
                return codec.decode(data)
        raise ValueError("the payload is of another codec")


#: Pools of growing effort: what a level may choose from, and whether bytes are deflated or only packed.
LEVELS = {
    0: [Raw()], 1: [DeltaVarint()], 2: [DeltaVarint(), SecondDifference()], 3: [DeltaVarint(), SecondDifference(), DeltaBits(), DeltaOfDelta()],
    4: [DeltaVarint(), SecondDifference(), DeltaBits(), DeltaOfDelta(), Runs()], 5: [DeltaVarint(), SecondDifference(), DeltaBits(), DeltaOfDelta(), Runs(), OutlierBits()],
}


def at_level(level: int) -> Smallest:
    if level not in LEVELS:
        raise ValueError(f"levels are {min(LEVELS)} to {max(LEVELS)}")
    return Smallest(LEVELS[level])
