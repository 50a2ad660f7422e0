"""Cells against truth, and statistics of repeated measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.values import pct, quoted
from strandline.operators.selection import median, middles


def as_cells(df: DataFrame, key: str, value: str = "val") -> DataFrame:
    """(key, attribute, value) of each other column, as text."""
    others = [c for c in df.columns if c != key]
    texts = df.select(F.col(key).cast("string").alias(key), *[F.col(quoted(c)).cast("string").alias(c) for c in others])
    return texts.unpivot([key], others, "attribute", value)


def compare_cells(dirty: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Each truth cell (key, attribute, correct_val) with the dirty value, whether it is present and whether it is equal."""
    cells = as_cells(dirty, key)
    truth = truth.withColumn(key, F.col(key).cast("string"))
    met = truth.join(cells, [key, "attribute"], "left")
    return met.withColumn("present", F.coalesce(F.col("val") != "", F.lit(False))).withColumn("correct", F.col("val").eqNullSafe(F.col("correct_val")))


def cell_accuracy(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("cells"), F.count_if("present").alias("present"), F.count_if("correct").alias("correct"))


def mismatches(compared: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The first mismatches, by key and attribute: a report, so limited."""
    return compared.where(~F.col("correct")).orderBy(key, "attribute").limit(limit)


def report(compared: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """One row: cells, those present and those correct, both in percent (0 of nothing), the least of them, and the first mismatches as 'key attribute: value'."""
    counts = cell_accuracy(compared)
    share = lambda c: F.when(F.col("cells") == 0, 0.0).otherwise(pct(F.col(c), F.col("cells")))
    said = F.concat(F.col(key).cast("string"), F.lit(" "), F.col("attribute"), F.lit(": "), F.coalesce("val", F.lit("-")))
    first = mismatches(compared, key, limit).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("attribute").alias("a"), said.alias("s")))).alias("m"))  # `limit` rows
    made = counts.crossJoin(F.broadcast(first)).withColumns({"completeness": share("present"), "accuracy": share("correct")})
    return made.select("cells", "present", "correct", "completeness", "accuracy", F.least("completeness", "accuracy").alias("minimum"), F.col("m.s").alias("mismatches"))


def accuracy_counts(df: DataFrame, predicted: str, truth: str, match: str) -> DataFrame:
    """One row of a prediction against the truth, both null where there is none: n, correct, positive and negative rows (with and without a truth), how many of each are
    correct, and how many rows met their entity by a similar name (`match` is 'fuzzy')."""
    same, there = F.col(predicted).eqNullSafe(F.col(truth)), F.col(truth).isNotNull()
    return df.agg(
        F.count("*").alias("n"), F.count_if(same).alias("correct"), F.count_if(there).alias("positive"), F.count_if(there & same).alias("positive_correct"),
        F.count_if(~there).alias("negative"), F.count_if(~there & same).alias("negative_correct"), F.count_if(F.col(match) == "fuzzy").alias("fuzzy"),
    )


def wide_cells(df: DataFrame, sensors: list[str]) -> DataFrame:
    """Cells, those present and those finite, over many nullable columns: one aggregate, no unpivot."""
    there = sum((F.count(F.col(quoted(c))) for c in sensors[1:]), F.count(F.col(quoted(sensors[0]))))
    good = lambda c: F.count_if(F.col(quoted(c)).isNotNull() & ~F.isnan(F.col(quoted(c)).cast("double")) & (F.abs(F.col(quoted(c)).cast("double")) < float("inf")))
    finite = sum((good(c) for c in sensors[1:]), good(sensors[0]))
    return df.agg((F.count("*") * len(sensors)).alias("cells"), there.alias("present"), finite.alias("finite"))


def array_cells(df: DataFrame, values: str, length: int) -> DataFrame:
    """Points of array columns: all, finite, and series of the right length."""
    finite = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.agg(F.sum(F.size(values)).alias("points"), F.sum(F.size(finite)).alias("finite"), F.count_if(F.size(values) == length).alias("whole"), F.count("*").alias("series"))


def throughput(df: DataFrame, rate: str, by: list[str] | None = None) -> DataFrame:
    """Median, minimum, maximum and coefficient of variation of repeated runs; one key may hold all of them. Without groups no runs give one row, with runs 0."""
    by = by or []
    x = F.col(quoted(rate))
    told = df.groupBy(*[quoted(c) for c in by]).agg(
        F.count("*").alias("runs"), F.min(x).alias("minimum"), F.max(x).alias("maximum"),
        F.when(F.count("*") > 1, F.stddev_samp(x) / F.avg(x)).otherwise(0.0).alias("cv"),
    )
    return _with_middles(df, x, by, told).select(*[F.col(quoted(c)) for c in by], "runs", "median", "minimum", "maximum", "cv")


def _with_middles(df: DataFrame, value: Column, by: list[str], told: DataFrame) -> DataFrame:
    """told, a row for each group, with the group's median and upper median."""
    found = middles(df, value, by).select(*[F.col(quoted(c)).alias(f"_t{i}") for i, c in enumerate(by)], median(F.col("lower"), F.col("upper")).alias("median"), F.col("upper").alias("upper_median"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(quoted(c)).eqNullSafe(F.col(f"_t{i}"))
    return told.join(found if by else F.broadcast(found), same, "left")  # without groups one row each


def ratio_sets(df: DataFrame, chunk: str, channel: str, raw: str, packed: str) -> DataFrame:
    """raw, packed and raw / packed by chunk, by channel and in all, in one pass (grouping sets)."""
    view = df.select(F.col(chunk).alias("chunk"), F.col(channel).alias("channel"), F.col(raw).alias("raw"), F.col(packed).alias("packed"))
    made = view.groupingSets([["chunk"], ["channel"], []], "chunk", "channel").agg(F.sum("raw").alias("raw_bytes"), F.sum("packed").alias("packed_bytes"))
    return made.withColumn("ratio", F.col("raw_bytes") / F.col("packed_bytes"))


def ratio_spread(df: DataFrame, ratio: str, by: list[str] | None = None) -> DataFrame:
    """Minimum, median, upper median (the higher of the two in the middle) and maximum, of all rows or of each group."""
    by = by or []
    x = F.col(quoted(ratio))
    told = df.groupBy(*[quoted(c) for c in by]).agg(F.min(x).alias("minimum"), F.max(x).alias("maximum"))
    return _with_middles(df, x, by, told).select(*[F.col(quoted(c)) for c in by], "minimum", "median", "upper_median", "maximum")


def errors(df: DataFrame, expected: str, actual: str, by: list[str] | None = None) -> DataFrame:
    """Sum of absolute and of squared errors, the largest, and whether all are equal."""
    gap = F.col(expected) - F.col(actual)
    return df.groupBy(*(by or [])).agg(F.sum(F.abs(gap)).alias("l1"), F.sum(gap * gap).alias("l2"), F.max(F.abs(gap)).alias("max_error"), F.bool_and(F.col(expected).eqNullSafe(F.col(actual))).alias("exact"))
