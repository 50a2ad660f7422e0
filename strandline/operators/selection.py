"""Exact order statistics of keys of any size: histograms by leading bits, refined until a bin is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.values import quoted
from strandline.session import written

#: Values of a bin that a task may sort; bins of a refinement; rows of targets that are broadcast.
SMALL, BINS, FEW = 1 << 16, 1 << 12, 1 << 16


def _leading(v: Column) -> Column:
    """Sign and exponent of a double as a whole number that never falls as v grows; NaN is the largest."""
    size = F.floor(F.log2(F.abs(v))).cast("int") + 1100
    return F.when(F.isnan(v), 9000).when(v == 0, 0).when(v == float("inf"), 8000).when(v == float("-inf"), -8000).when(v > 0, size).otherwise(-size)


def _bins(rows: DataFrame, keys: list[str], bin_: Column) -> DataFrame:
    """count, least and greatest value of each bin of a key; a task sends one row for each bin it has seen."""
    return rows.groupBy(*keys, bin_.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def _hit(bins: DataFrame, keys: list[str], ranks: Column) -> DataFrame:
    """The bins that hold the ranks wanted of a key (structs of name and at), each with its rank there. keys: all that names a key, or a target that is refined."""
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.filter(ranks, lambda t: (t["at"] >= F.col("_before")) & (t["at"] < F.col("_before") + F.col("_c")))
    return bins.withColumn("_before", before).withColumn("_t", F.explode(inside)).withColumns({"_name": F.col("_t.name"), "_at": F.col("_t.at") - F.col("_before")})


def _within(rows: DataFrame, targets: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows that lie in a target's bin, once for each target. Targets are two rows a key; up to FEW of them are broadcast, more are joined."""
    told = targets.select(*[F.col(k).alias(f"_t{k}") for k in keys], "_name", "_at", "_n", "_lo", "_hi")
    same = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_t{k}"))
    return rows.join(F.broadcast(told) if n <= FEW else told, same).drop(*[f"_t{k}" for k in keys])


def middles(df: DataFrame, value: Column, by: list[str], small: int = SMALL) -> DataFrame:
    """(by, n, lower, upper): number of the values that aren't null, and the two in the middle (one, twice, if n is odd). Exact; keys without values give no row.

    value: a double; NaN counts as the largest. If no key has more than `small` values, each is sorted. Else a first pass counts the values of each key by sign and exponent; a bin that holds a middle is split into BINS, again and
    again, at most five times, until it holds `small` values or equal ones only; then the values of such bins alone are sorted. So no task holds a key's values, and what
    is shuffled are counts and small bins. `df` is read once for each pass.
    """
    keys = [f"_k{i}" for i in range(len(by) + 1)]  # without `by` there is one key
    rows = df.select(F.lit(0).alias("_k0"), *[F.col(quoted(c)).alias(k) for c, k in zip(by, keys[1:], strict=True)], value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    shown = [F.col(k).alias(c) for c, k in zip(by, keys[1:], strict=True)]
    most = rows.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= small:  # each key is a small bin
        whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("_v")).alias("_all"))
        at = lambda i: F.get("_all", F.floor(i).cast("int"))
        return whole.select(*shown, "n", at((F.col("n") - 1) / 2).alias("lower"), at(F.col("n") / 2).alias("upper"))
    kept = [*keys, "_name", "_at", "_n", "_c", "_lo", "_hi"]
    bins = _bins(rows, keys, _leading(F.col("_v"))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    name = lambda s, at: F.struct(F.lit(s).alias("name"), at.cast("long").alias("at"))
    ranks = F.array(name("lower", F.floor((F.col("_n") - 1) / 2)), name("upper", F.floor(F.col("_n") / 2)))
    targets = written(_hit(bins, keys, ranks).select(*kept), "targets")
    wide = (F.col("_c") > small) & (F.col("_lo") < F.col("_hi"))
    while True:
        count, open_ = targets.agg(F.count("*"), F.count_if(wide)).first()
        if not open_:
            break
        part = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        met = _within(rows, targets.where(wide), keys, count).select(*keys, "_name", "_at", "_n", "_v", F.least(F.lit(BINS - 1), F.floor(part * BINS)).alias("_b"))
        split = _bins(met, [*keys, "_name", "_at", "_n"], F.col("_b")).withColumnRenamed("_at", "_rank").withColumnRenamed("_name", "_which")
        hit = _hit(split, [*keys, "_which"], F.array(F.struct(F.col("_which").alias("name"), F.col("_rank").alias("at"))))
        targets = written(targets.where(~wide).unionByName(hit.select(*kept)), "targets")
    apart = F.col("_lo") < F.col("_hi")
    sorted_ = _within(rows, targets.where(apart), keys, count).groupBy(*keys, "_name", "_at", "_n").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    found = targets.where(~apart).select(*keys, "_name", "_n", F.col("_lo").alias("_x"))
    found = found.unionByName(sorted_.select(*keys, "_name", "_n", F.get("_all", F.col("_at").cast("int")).alias("_x")))
    pick = lambda s: F.max(F.when(F.col("_name") == s, F.col("_x"))).alias(s)
    both = found.groupBy(*keys).agg(F.max("_n").alias("n"), pick("lower"), pick("upper"))
    return both.select(*shown, "n", "lower", "upper")


def median(lower: Column, upper: Column) -> Column:
    return 0.5 * lower + 0.5 * upper
