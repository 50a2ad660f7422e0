"""Column expressions on words and spans that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of runs of non-blanks (blank: U+0020, U+0009 to U+000D); 0 for null."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner.isNull() | (inner == ""), F.lit(0)).otherwise(F.size(F.split(inner, "[ \\t-\\r]+"))).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Elements that a list grown one by one holds at most; longer ones are joined of such blocks, so that work stays in proportion to their length.
BLOCK = 64


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def blocks(xs: Column) -> Column:
    """xs as a list of lists of BLOCK elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))


def _scanned(parts: Column, op: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each element the result of op over start and all before it."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    return F.aggregate(parts, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def before(xs: Column, op: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """For each of whole numbers the result of op, an associative one, over start and all that stand before it; blocks first, then within each."""
    none = F.array().cast("array<int>")

    def whole(v: Column) -> Column:
        ends = F.transform(blocks(v), lambda p: F.aggregate(p, F.lit(start), op))
        return F.flatten(F.zip_with(blocks(v), _scanned(ends, op, F.lit(start)), lambda p, at: _scanned(p, op, at)))

    return let(xs, lambda v: F.when(F.size(v) == 0, none).when(F.size(v) <= BLOCK, _scanned(v, op, F.lit(start))).otherwise(whole(v)))


def laid(steps: Column) -> Column:
    """array<struct<start, stop>> of array<struct<g, h>>: each h long, g after the one before."""
    ends = before(F.transform(steps, lambda x: x["g"] + x["h"]), lambda a, b: a + b)
    return F.zip_with(ends, steps, lambda at, x: F.struct((at + x["g"]).alias("start"), (at + x["g"] + x["h"]).alias("stop")))


def spans(text: Column, pattern: Column | str, group: int = 0) -> Column:
    """array<struct<start, stop, part>> of the pattern's leftmost non-overlapping matches.

    Offsets are code points, stop is exclusive, part is what the group holds. The lengths between
    matches (split) and of matches add up to offsets, so that no match must be searched again; time grows with the text and its matches.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.regexp_extract_all(text, pattern, F.lit(group))
    both = F.zip_with(F.split(text, pattern, -1), F.arrays_zip(hits.alias("h"), parts.alias("p")), lambda g, x: F.struct(F.length(g).alias("g"), F.length(x["h"]).alias("h"), x["p"].alias("p")))
    # split has a part more than there are matches
    return let(F.slice(both, 1, F.greatest(F.size(both) - 1, F.lit(0))), lambda b: F.zip_with(laid(b), b, lambda at, x: F.struct(at["start"].alias("start"), at["stop"].alias("stop"), x["p"].alias("part"))))
