"""Reordered regression codec: rows of a block are put in the order in which columns are cheapest, each column in its cheapest mode."""

from __future__ import annotations

import struct

import numpy as np

from strandline.codecs import bits
from strandline.codecs.integers import integers

BLOCK, SEGMENT = 513, 16
RAW, CONST, FOR, DELTA, TIME_LINEAR, PREV_LINEAR = range(6)
_MAGIC = b"RORD"


def _wrapped(f: np.ndarray) -> np.ndarray:
    return np.trunc(np.clip(np.nan_to_num(f), -(2.0**62), 2.0**62)).astype(np.int64)


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Least-squares slope and intercept, as the 32-bit floats that are stored."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    mx, my = x.mean(), y.mean()
    var = ((x - mx) ** 2).sum()
    slope = float(np.float32(((x - mx) * (y - my)).sum() / var)) if var else 0.0
    return slope, float(np.float32(my - slope * mx))


def _packed(residual: np.ndarray) -> bytes:
    """Segments of residuals in the bits each needs; widths as runs."""
    u = bits.zigzag(residual)
    full = np.concatenate((u, np.zeros(-len(u) % SEGMENT, np.uint64))).reshape(-1, SEGMENT)
    widths = np.array([bits.width(s) for s in full], np.uint8)
    value, length = bits.runs(widths)
    head = bits.put_varints(np.column_stack((value.astype(np.uint64), length.astype(np.uint64))).ravel())
    body = b"".join(bits.pack(s, int(w)) for s, w in zip(full, widths, strict=True))
    return struct.pack("<H", len(head)) + head + body


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, int]:
    size = struct.unpack_from("<H", data)[0]
    flat = bits.get_varints(data[2 : 2 + size]).reshape(-1, 2).astype(np.int64)
    widths, at, out = np.repeat(flat[:, 0], flat[:, 1]), 2 + size, []
    if len(widths) != -(-n // SEGMENT):
        raise ValueError("the payload holds another number of segments")
    for w in widths.tolist():
        out.append(bits.unpack(data[at:], w, SEGMENT))
        at += 2 * w
    return bits.unzigzag(np.concatenate(out) if out else np.empty(0, np.uint64))[:n], at


def _column(x: np.ndarray, time: np.ndarray | None) -> bytes:
    """The shortest mode of a column in its order."""
    if (x == x[0]).all():
        return struct.pack("<Bq", CONST, int(x[0]))
    made = [struct.pack("<B", RAW) + x.astype("<i8").tobytes()]
    base = int(x.min())
    with np.errstate(over="ignore"):
        made.append(struct.pack("<Bq", FOR, base) + _packed(x - base))
        made.append(struct.pack("<Bq", DELTA, int(x[0])) + _packed(np.diff(x)))
        for mode, at in ((TIME_LINEAR, time), (PREV_LINEAR, x[:-1])):
            if at is None:
                continue
            y = x if mode == TIME_LINEAR else x[1:]
            slope, start = _line(at, y)
            made.append(struct.pack("<Bqff", mode, int(x[0]), slope, start) + _packed(y - _wrapped(slope * at.astype(np.float64) + start)))
    return min(made, key=len)


def _uncolumn(data: bytes, n: int, time: np.ndarray | None) -> tuple[np.ndarray, int]:
    mode = data[0]
    if mode == RAW:
        return np.frombuffer(data[1 : 1 + 8 * n], "<i8").astype(np.int64), 1 + 8 * n
    first = struct.unpack_from("<q", data, 1)[0]
    if mode == CONST:
        return np.full(n, first, np.int64), 9
    if mode == FOR:
        residual, used = _unpacked(data[9:], n)
        return residual + first, 9 + used
    if mode == DELTA:
        residual, used = _unpacked(data[9:], n - 1)
        return np.cumsum(np.concatenate(([first], residual))), 9 + used
    slope, start = struct.unpack_from("<ff", data, 9)
    if mode == TIME_LINEAR:
        residual, used = _unpacked(data[17:], n)
        return residual + _wrapped(slope * time.astype(np.float64) + start), 17 + used
    residual, used = _unpacked(data[17:], n - 1)
    x = np.empty(n, np.int64)
    x[0] = first
    for i in range(1, n):  # each value is predicted from the one before
        x[i] = residual[i - 1] + int(_wrapped(np.array([slope * float(x[i - 1]) + start]))[0])
    return x, 17 + used


def _orders(columns: np.ndarray, time: np.ndarray) -> list[np.ndarray]:
    """Candidate orders: as it is, by time, by the first column, by its quartiles, lexicographic."""
    n = columns.shape[1]
    lead = columns[0]
    found = [np.arange(n), np.argsort(time, kind="stable"), np.argsort(lead, kind="stable")]
    if n >= 8:
        cuts = np.quantile(lead.astype(np.float64), [0.25, 0.5, 0.75])
        found.append(np.argsort(np.searchsorted(cuts, lead), kind="stable"))
    found.append(np.lexsort(columns[::-1]))
    seen: dict[bytes, np.ndarray] = {}
    for order in found:
        seen.setdefault(order.tobytes(), order)
    return list(seen.values())


def _block(columns: np.ndarray, time: np.ndarray, keep_time: bool) -> bytes:
    best = None
    n = columns.shape[1]
    for order in _orders(columns, time):
        parts, size = [], 0
        if (order == np.arange(n)).all():
            parts.append(b"\0")
        else:  # always stored, so that equal or unsorted times come back in their order
            parts.append(b"\1" + bits.pack(order.astype(np.uint64), max(1, (n - 1).bit_length())))
        t = time[order]
        if keep_time:
            parts.append(_column(t, None))
        for x in columns:
            parts.append(_column(x[order], t if keep_time else None))
            size = sum(map(len, parts))
            if best is not None and size >= len(best):
                break
        if best is None or size < len(best):
            best = b"".join(parts)
    return best


def encode(columns, time=None) -> bytes:
    """Columns of equal length, and optionally their times, of any order, with repeats."""
    columns = np.stack([integers(c) for c in columns]) if len(columns) else np.empty((0, 0), np.int64)
    n = columns.shape[1]
    t = integers(time) if time is not None else np.arange(n, dtype=np.int64)
    if len(t) != n:
        raise ValueError("times and columns differ in length")
    out = [_MAGIC, struct.pack("<IHB", n, len(columns), time is not None)]
    for low in range(0, n, BLOCK):
        made = _block(columns[:, low : low + BLOCK], t[low : low + BLOCK], time is not None)
        out.append(struct.pack("<I", len(made)) + made)
    return b"".join(out)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """(columns, time) in the order in which they came."""
    if data[:4] != _MAGIC or len(data) < 11:
        raise ValueError("the payload is of another codec or cut off")
    n, k, keep_time = struct.unpack_from("<IHB", data, 4)
    at, out, times = 11, np.empty((k, n), np.int64), np.empty(n, np.int64)
    for low in range(0, n, BLOCK):
        m = min(BLOCK, n - low)
        size = struct.unpack_from("<I", data, at)[0]
        part, at = data[at + 4 : at + 4 + size], at + 4 + size
        if len(part) != size:
            raise ValueError("the payload is cut off")
        order, p = np.arange(m), 1
        if part[0]:
            w = max(1, (m - 1).bit_length())
            order = bits.unpack(part[1:], w, m).astype(np.int64)
            p += -(-w * m // 8)
        t = None
        if keep_time:
            t, used = _uncolumn(part[p:], m, None)
            p += used
            times[low + order] = t
        for c in range(k):
            x, used = _uncolumn(part[p:], m, t)
            p += used
            out[c, low + order] = x
    return out, times if keep_time else None


def encode_doubles(x) -> bytes:
    """Doubles, by their bits, or exactly as decimals where up to nine places give all of them back."""
    x = np.asarray(x, np.float64)
    if not np.isfinite(x).all():
        raise ValueError("the values aren't finite")
    for places in range(10):
        scaled = np.rint(x * 10.0**places)
        if (np.abs(scaled) < 2**53).all() and ((scaled / 10.0**places).view(np.int64) == x.view(np.int64)).all():
            return struct.pack("<B", places) + encode([scaled.astype(np.int64)])
    return struct.pack("<B", 255) + encode([x.view(np.int64)])


def decode_doubles(data: bytes) -> np.ndarray:
    (x,), _ = decode(data[1:])
    return x.view(np.float64) if data[0] == 255 else x / 10.0 ** data[0]
