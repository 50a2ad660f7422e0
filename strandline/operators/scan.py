"""Prefix scans along an order: rows of one key, however many, lie in ranges of the order, and what ranges hand on is added in a second, small step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.values import quoted
from strandline.session import written

#: Added to rows: the number of their range.
RANGE = "_range"


def ranged(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df in `parts` ranges of (by, order), as many as shuffles have if None; RANGE numbers them in that order.

    Rows equal in by and order share a range, all others may be in different ones, so a key that holds most rows lies in many tasks.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *by, *order).withColumn(RANGE, F.spark_partition_id())


def _met(rows: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """rows, and what earlier ranges of their key hand on. A range ends in the middle of one key at most, so carry has no more rows than there are ranges and is broadcast."""
    told = carry.select(F.col(RANGE).alias("_r"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_carry")
    same = rows[RANGE] == told["_r"]
    for i, c in enumerate(by):
        same = same & rows[c].eqNullSafe(told[f"_by{i}"])
    return rows.join(F.broadcast(told), same, "left").drop("_r", *[f"_by{i}" for i in range(len(by))])


def lagged(df: DataFrame, value: Column, by: list[str], order: list[str], n: int = 1, parts: int | None = None, prefix: str = "lag_") -> DataFrame:
    """df with lag_1 to lag_n, the values of the rows before each, along the order, of the same `by`; null where there is none.

    As lag() over a window of `by`, but no task holds all rows of a key. order should name each row of a key; equal ones come in any order, as with lag(). The ranged rows
    are written to the shared folder once, so that both steps see the same ranges.
    """
    rows = written(ranged(df.withColumn("_v", value), by, order, parts), "ranged")
    w = Window.partitionBy(RANGE, *by).orderBy(*order)
    one = F.struct(F.col("_v").alias("v"))  # a null value is not a missing row
    seen = rows.withColumn("_i", F.row_number().over(w)).withColumns({f"_l{k}": F.lag(one, k).over(w) for k in range(1, n + 1)})
    last = F.max_by(F.array(one, *[F.col(f"_l{k}") for k in range(1, n)]), F.struct(*order))
    tails = seen.groupBy(RANGE, *by).agg(last.alias("_tail"))
    before = F.collect_list("_tail").over(Window.partitionBy(*by).orderBy(RANGE).rowsBetween(-n, -1))
    carry = tails.select(RANGE, *by, F.slice(F.filter(F.flatten(F.reverse(before)), lambda x: x.isNotNull()), 1, n).alias("_carry")).where(F.size("_carry") > 0)
    met = _met(seen, carry, by)
    found = {f"{prefix}{k}": F.coalesce(F.when(F.col("_i") > k, F.col(f"_l{k}")), F.get("_carry", F.lit(k) - F.col("_i")))["v"] for k in range(1, n + 1)}
    return met.select(*[F.col(quoted(c)) for c in df.columns], *[x.alias(c) for c, x in found.items()])


def running_sum(df: DataFrame, value: Column, by: list[str], order: list[str], out: str = "total", parts: int | None = None) -> DataFrame:
    """df with the sum of the values, null as 0, of each row and those before it of the same `by`."""
    rows = written(ranged(df.withColumn("_v", F.coalesce(value, F.lit(0))), by, order, parts), "ranged")
    sums = rows.groupBy(RANGE, *by).agg(F.sum("_v").alias("_s"))
    earlier = F.sum("_s").over(Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    carry = sums.select(RANGE, *by, earlier.alias("_carry")).where(F.col("_carry").isNotNull())
    w = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = _met(rows.withColumn("_s", F.sum("_v").over(w)), carry, by)
    return met.select(*[F.col(quoted(c)) for c in df.columns], (F.col("_s") + F.coalesce("_carry", F.lit(0))).alias(out))


def running_twice(df: DataFrame, start: Column, slope: Column, by: list[str], order: list[str], out: str = "rebuilt", parts: int | None = None) -> DataFrame:
    """df with the running sum of start plus the running sum of slope: values again, from second differences.

    A range hands on its sum of slopes and its sum of values; a later range adds the first once for each of its rows.
    """
    rows = written(ranged(df.withColumns({"_a": F.coalesce(start, F.lit(0)), "_b": F.coalesce(slope, F.lit(0))}), by, order, parts), "ranged")
    w = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(RANGE, *by).orderBy(*order))).withColumn("_slope", F.sum("_b").over(w))
    rows = rows.withColumn("_value", F.sum(F.col("_a") + F.col("_slope")).over(w))
    ends = rows.groupBy(RANGE, *by).agg(F.sum("_b").alias("_s"), F.sum(F.col("_a") + F.col("_slope")).alias("_t"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_c", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
    total = F.sum(F.col("_t") + F.col("_n") * F.col("_c")).over(earlier)
    carry = ends.select(RANGE, *by, F.when(total.isNotNull(), F.struct(F.col("_c").alias("s"), total.alias("t"))).alias("_carry")).where(F.col("_carry").isNotNull())
    met = _met(rows, carry, by)
    whole = F.col("_value") + F.coalesce(F.col("_carry.t") + F.col("_i") * F.col("_carry.s"), F.lit(0))
    return met.select(*[F.col(quoted(c)) for c in df.columns], whole.alias(out))


def filled(df: DataFrame, value: Column, by: list[str], order: list[str], out: str = "filled", parts: int | None = None) -> DataFrame:
    """df with the newest value that isn't null of each row and those before it of the same `by`."""
    rows = written(ranged(df.withColumn("_v", value), by, order, parts), "ranged")
    w = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(RANGE, *by).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_e"))
    earlier = F.last("_e", ignorenulls=True).over(Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(RANGE, *by, earlier.alias("_carry")).where(F.col("_carry").isNotNull())
    met = _met(rows.withColumn("_f", F.last("_v", ignorenulls=True).over(w)), carry, by)
    return met.select(*[F.col(quoted(c)) for c in df.columns], F.coalesce("_f", "_carry").alias(out))
