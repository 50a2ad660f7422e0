"""Scalar column expressions: coercion, tokens, time, rounding, intervals, zigzag."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in text, alike in every engine; exponents yes, underscores, suffixes and hex no.
NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def parsed(x: Column, kind: str) -> Column:
    """x as a double that may be NaN or infinite; null if it isn't a number. kind: its Spark type name."""
    if kind != "string":
        return x.cast("double")
    special = F.when(x.rlike("(?i)nan"), F.lit(float("nan"))).when(x.rlike(r"^\s*-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(x.rlike(NUMERIC), F.btrim(x).try_cast("double")).when(x.rlike(_SPECIAL), special)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite(x: Column, kind: str) -> Column:
    """x as a finite double, else null."""
    number = parsed(x, kind)
    return F.when(is_finite(number), number)


def entity_token(x: Column) -> Column:
    """Lower-cased letters a-z and digits of an identifier; '' for null or none."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(x.cast("string"))), "[^a-z0-9]", ""), F.lit(""))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch, half to even, of a timestamp (without zone: UTC)."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1000.0).cast("long")


def iso_or_number(x: Column, kind: str) -> Column:
    """Milliseconds of ISO-8601 text (without zone: UTC), else the finite number, else null."""
    if kind != "string":
        return finite(x, kind)
    iso = F.when(F.btrim(x).rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_micros(F.try_to_timestamp(F.btrim(x))) / 1000.0)
    return F.coalesce(iso, finite(x, kind))


def pct(part: Column, whole: Column) -> Column:
    """Percentage to two places; 100 of nothing."""
    return F.when(whole == 0, F.lit(100.0)).otherwise(F.round(100.0 * part / whole, 2))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds, in percent, of the Wilson 95 % interval, clamped to 0..100; both 0 of nothing."""
    p = hits / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / scale
    low, high = clamp(100 * (centre - half), 0.0, 100.0), clamp(100 * (centre + half), 0.0, 100.0)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def zigzag(x: Column) -> Column:
    x = x.cast("long")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(F.lit(1).cast("long"))))


def quantized(x: Column, tolerance: float) -> Column:
    """Steps of twice the tolerance, half to even: decoded values are within the tolerance."""
    if not (tolerance > 0 and math.isfinite(tolerance)):
        raise ValueError("the tolerance must be a finite positive number")
    return F.rint(x / (2 * tolerance)).cast("long")


def private_name(text: str, fallback: str = "data", limit: int = 80) -> str:
    """A name safe for files: letters, digits, _ . - only, without dots or dashes at its ends."""
    made = "".join(c if c.isalnum() or c in "_.-" else "_" for c in text.strip()).strip(".-")
    return made[:limit] or fallback


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
