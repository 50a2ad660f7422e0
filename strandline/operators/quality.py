"""Data quality: completeness, consistency, timeliness, validity, uniqueness, referential integrity, stability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.values import is_finite, parsed, pct
from strandline.operators.scan import RANGE, ranged
from strandline.operators.selection import median, middles
from strandline.session import written

REQUIRED = ("timestamp_ms", "equipment_id", "value")
LOW, HIGH = -1e6, 1e6
DIMENSIONS = ("completeness", "consistency", "timeliness", "validity")


def present(df: DataFrame, name: str) -> Column:
    """Not null and, for text, not ''."""
    if name not in df.columns:
        return F.lit(False)
    x = F.col(name)
    return x.isNotNull() & (x != "") if dict(df.dtypes)[name] == "string" else x.isNotNull()


def quality_counts(df: DataFrame, reference_ms: Column | float, max_age_ms: Column | float = 900_000.0, by: tuple[str, ...] = (), order: str = "source_index") -> DataFrame:
    """n, complete, consistent, timely, valid of all rows, or of each group of `by`.

    consistent: rows whose time isn't before that of the row just before, in `order`, of the same equipment; rows without a
    number for time or value, or a time that isn't finite and positive, neither count nor become one to compare with.
    Null equipment isn't valid and is an equipment of its own to compare. Without groups an empty input gives one row of zeros.

    Rows lie in ranges of (group, equipment, order), so one equipment may hold all of them: each range counts and tells its first
    and last time, and only those, a row for each range and equipment, meet to compare across borders.
    """
    kinds = dict(df.dtypes)
    column = lambda n: parsed(F.col(n), kinds[n]) if n in kinds else F.lit(None).cast("double")
    name = F.coalesce(F.col("equipment_id").cast("string"), F.lit("")) if "equipment_id" in kinds else F.lit("")
    rows = df.select(*by, F.col(order).alias("_o"), name.alias("_e"), column("timestamp_ms").alias("_t"), column("value").alias("_v"), reduce(Column.__and__, [present(df, c) for c in REQUIRED]).alias("_c"), (F.lit(reference_ms) if not isinstance(reference_ms, Column) else reference_ms).alias("_r"), (F.lit(max_age_ms) if not isinstance(max_age_ms, Column) else max_age_ms).alias("_a"))
    timed = is_finite(F.col("_t")) & (F.col("_t") > 0)
    counted = F.col("_v").isNotNull() & F.col("_t").isNotNull() & timed
    rows = ranged(rows.withColumn("_k", F.coalesce(counted, F.lit(False))), [*by, "_e"], ["_o"])
    told = F.when(F.col("_k"), F.col("_t"))
    before = F.last(told, ignorenulls=True).over(Window.partitionBy(RANGE, *by, "_e").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_p", before)
    age = F.col("_r") - F.col("_t")
    ends = rows.groupBy(RANGE, *by, "_e").agg(
        F.count("*").alias("n"),
        F.count_if("_c").alias("complete"),
        F.count_if(F.col("_k") & (F.col("_p").isNull() | (F.col("_t") >= F.col("_p")))).alias("consistent"),
        F.count_if(F.col("_k") & (age >= 0) & (age <= F.col("_a"))).alias("timely"),
        F.count_if((F.col("_e") != "") & is_finite(F.col("_v")) & (F.col("_v") >= LOW) & (F.col("_v") <= HIGH) & timed).alias("valid"),
        F.min_by("_t", F.when(F.col("_k"), F.col("_o"))).alias("_first"),
        F.max_by("_t", F.when(F.col("_k"), F.col("_o"))).alias("_last"),
    )
    # the first row of a range counted as one with nothing before it; the end of the range before may say otherwise
    handed = F.last("_last", ignorenulls=True).over(Window.partitionBy(*by, "_e").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_h", handed).withColumn("consistent", F.col("consistent") - F.coalesce((F.col("_first") < F.col("_h")).cast("long"), F.lit(0)))
    zero = lambda c: F.sum(c) if by else F.coalesce(F.sum(c), F.lit(0))
    return ends.groupBy(*by).agg(*[zero(c).cast("long").alias(c) for c in ("n", "complete", "consistent", "timely", "valid")])


def as_dimensions(counts: DataFrame) -> DataFrame:
    """The counts as percentages, 0 of nothing."""
    kept = [c for c in counts.columns if c not in ("n", "complete", "consistent", "timely", "valid")]
    share = lambda c: F.when(F.col("n") == 0, 0.0).otherwise(pct(F.col(c), F.col("n")))
    return counts.select(*kept, "n", *[share(c).alias(d) for c, d in zip(("complete", "consistent", "timely", "valid"), DIMENSIONS, strict=True)])


def evaluate(df: DataFrame, reference_ms: float, max_age_ms: float = 900_000.0, order: str = "source_index") -> DataFrame:
    if max_age_ms < 0:
        raise ValueError("the maximum age can't be negative")
    return as_dimensions(quality_counts(df, reference_ms, max_age_ms, order=order))


def unique_counts(df: DataFrame, columns: tuple[str, ...] = ("equipment_id", "timestamp_ms", "value")) -> DataFrame:
    """n and the number of different signatures; nulls are a value."""
    return df.groupBy(*columns).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("signatures"))


def referential_counts(df: DataFrame, master: dict[str, DataFrame]) -> DataFrame:
    """checks and those that hold: non-empty fields of df, as text, that master's one-column frames hold."""
    checks, held = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, (name, allowed) in enumerate(master.items()):
        if name not in df.columns:
            continue
        dim = allowed.select(F.col(allowed.columns[0]).cast("string").alias(f"_m{i}")).distinct()
        df = df.join(dim, F.col(name).cast("string") == F.col(f"_m{i}"), "left")
        checks = checks + F.count_if(present(df, name))
        held = held + F.count_if(present(df, name) & F.col(f"_m{i}").isNotNull())
    return df.agg(checks.alias("checks"), held.alias("held"))


def referential_violations(df: DataFrame, name: str, allowed: DataFrame) -> DataFrame:
    """Rows whose non-empty field is not among the allowed ones."""
    dim = allowed.select(F.col(allowed.columns[0]).cast("string").alias("_m"))
    return df.where(present(df, name)).join(dim, F.col(name).cast("string") == F.col("_m"), "left_anti")


def stability_counts(df: DataFrame, by: tuple[str, ...] = (), factor: float = 12.0) -> DataFrame:
    """checked and stable values: within `factor` median absolute deviations of the equipment's median; groups under three are stable.

    Both medians are exact, and one equipment may hold all rows (`selection.middles`).
    """
    value = parsed(F.col("value"), dict(df.dtypes)["value"])
    rows = df.select(*by, F.coalesce(F.col("equipment_id").cast("string"), F.lit("")).alias("_e"), value.alias("_v")).where(is_finite(F.col("_v")))
    keys = [*by, "_e"]
    rows = written(rows, "values")  # a pass for each step of a median
    rows = written(_beside(rows, middles(rows, F.col("_v"), keys), keys, "_m").withColumn("_d", F.abs(F.col("_v") - F.col("_m"))), "deviations")
    rows = _beside(rows.withColumnRenamed("n", "_n"), middles(rows, F.col("_d"), keys), keys, "_s")
    good = (F.col("_n") < 3) | (F.col("_d") <= F.greatest(factor * F.col("_s"), F.lit(1e-9)))
    return rows.groupBy(*by).agg(F.count("*").alias("checked"), F.count_if(good).alias("stable"))


def _beside(rows: DataFrame, found: DataFrame, keys: list[str], out: str) -> DataFrame:
    """rows with n and the median of their key."""
    told = found.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "n", median(F.col("lower"), F.col("upper")).alias(out))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)])
    return rows.join(told, same).drop(*[f"_t{i}" for i in range(len(keys))])


def assess(df: DataFrame, master: dict[str, DataFrame], reference_ms: float, max_age_ms: float = 900_000.0, order: str = "source_index") -> DataFrame:
    """One row: seven dimensions in percent, their mean (overall) and minimum, and the number of referential checks; all 0 of nothing."""
    base = as_dimensions(quality_counts(df, reference_ms, max_age_ms, order=order))
    every = base.crossJoin(unique_counts(df).drop("n")).crossJoin(referential_counts(df, master)).crossJoin(stability_counts(df))  # one row each
    empty = F.col("n") == 0
    more = {
        "uniqueness": pct(F.col("signatures"), F.col("n")),
        "referential_integrity": pct(F.col("held"), F.col("checks")),
        "stability": pct(F.col("stable"), F.col("checked")),
    }
    made = every.select("n", *DIMENSIONS, *[F.when(empty, 0.0).otherwise(v).alias(k) for k, v in more.items()], F.col("checks").alias("referential_checks"))
    seven = [*DIMENSIONS, *more]
    total = reduce(Column.__add__, [F.col(c) for c in seven])
    return made.withColumn("overall", F.round(total / len(seven), 2)).withColumn("minimum", F.least(*seven))


def rollup_minimum(reports: list[DataFrame], dimensions: tuple[str, ...]) -> DataFrame:
    """One row over reports that may lack dimensions: the minimum of each that is there, the mean of those and the least."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
    low = every.agg(*[F.min(d).alias(d) for d in dimensions if d in every.columns])
    there = [d for d in dimensions if d in every.columns]
    filled = F.filter(F.array(*there), lambda x: x.isNotNull())
    return low.withColumn("overall", F.aggregate(filled, F.lit(0.0), lambda s, x: s + x) / F.size(filled)).withColumn("minimum", F.array_min(filled))
