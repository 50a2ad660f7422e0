"""Operators over ordered rows: windows of event time, first of a bucket, blocks, differences, newest rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.values import is_finite, parsed
from strandline.operators.quality import as_dimensions, quality_counts
from strandline.operators.scan import lagged, running_twice


def window_quality(df: DataFrame, window_ms: float = 60_000.0, order: str = "source_index", counts: bool = False) -> DataFrame:
    """Quality of each tumbling window: reference time its end, maximum age its length; consistency starts anew in each.

    Rows without a finite time fall, with times before 0, where the bucket is negative: window_start_ms null and reference 0.
    """
    if not (math.isfinite(window_ms) and window_ms > 0):
        raise ValueError("the window must be a finite positive number")
    t = parsed(F.col("timestamp_ms"), dict(df.dtypes)["timestamp_ms"])
    bucket = F.when(is_finite(t), F.floor(t / window_ms)).otherwise(F.when(t.isNull(), F.floor(F.lit(-1 / window_ms))).otherwise(F.lit(-1))).cast("long")
    df = df.withColumn("bucket", bucket)
    end = F.when(F.col("bucket") >= 0, (F.col("bucket") + 1) * window_ms).otherwise(0.0)
    made = quality_counts(df, end, window_ms, by=("bucket",), order=order)
    made = made if counts else as_dimensions(made)
    return made.withColumn("window_start_ms", F.when(F.col("bucket") >= 0, F.col("bucket") * window_ms))


def first_in_bucket(df: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """The first row, by order, of each bucket; a partial aggregate, no sort of whole buckets."""
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(bucket.alias("_b")).agg(row.alias("_r")).select("_r.*")


def newest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows by order, oldest first."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def blocks(df: DataFrame, row: str, size: int) -> DataFrame:
    """df with `block`, the number of the block of `size` rows that a row number from 0 falls in."""
    return df.withColumn("block", F.floor(F.col(row) / size))


def differences(df: DataFrame, value: str, order: str, by: list[str], parts: int | None = None) -> DataFrame:
    """df with d1 and d2, first and second differences along the order, of groups; null where there is none. One group may lie in many tasks."""
    made = lagged(df, F.col(value), by, [order], 2, parts, "_lag")
    d1, before = F.col(value) - F.col("_lag1"), F.col("_lag1") - F.col("_lag2")
    return made.withColumn("d1", d1).withColumn("d2", F.col("d1") - before).drop("_lag1", "_lag2")


def undifferenced(df: DataFrame, order: str, by: list[str], out: str = "rebuilt", parts: int | None = None) -> DataFrame:
    """Values from second differences: `start` and `slope` of the group's first two rows, `d2` of the rest. One group may lie in many tasks."""
    slope = F.coalesce("slope", F.lit(0)) + F.coalesce("d2", F.lit(0))
    return running_twice(df, F.col("start"), slope, by, [order], out, parts)


def subset(df: DataFrame, ranges: list[tuple[int, int]], windows: DataFrame, row: str = "source_row", t: str = "timestamp_ms", margin_ms: int = 1_800_000) -> DataFrame:
    """Rows of the given row ranges, and the first of each minute within a margin of a window [start_ms, end_ms]; selection_role says why."""
    within = F.lit(False)
    for a, b in ranges:
        within = within | F.col(row).between(a, b)
    minute = F.floor(F.col(t) / 60_000)
    first = first_in_bucket(df, minute, [t, row]).withColumn("_m", minute)
    spread = windows.select(F.explode(F.sequence(F.floor((F.col("start_ms") - margin_ms) / 60_000), F.floor((F.col("end_ms") + margin_ms) / 60_000))).alias("_m"), (F.col("start_ms") - margin_ms).alias("_a"), (F.col("end_ms") + margin_ms).alias("_z"))
    picked = first.join(spread, "_m").where(F.col(t).between(F.col("_a"), F.col("_z"))).select(row).distinct().withColumn("_p", F.lit(True))
    df = df.join(picked, row, "left")
    role = F.concat_ws("+", F.when(within, "compression"), F.when(F.col("_p"), "alignment"))
    return df.withColumn("selection_role", role).where(F.col("selection_role") != "").drop("_p")
