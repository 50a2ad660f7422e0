"""Scans of one key that lies in many ranges, against windows and SQL that hold the key in one task."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import quality as Q
from strandline.operators import scan
from strandline.operators import windows as W
from strandline.plans import catalog


@pytest.fixture(scope="module")
def hot(spark):
    """20,000 rows of one key, 5 keys of a few rows, one null key; values with nulls, an order with gaps."""
    i = F.col("id")
    key = F.when(i % 10 != 0, "hot").when(i % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), i % 50))
    v = F.when(F.pmod(F.hash("id"), F.lit(5)) != 0, F.pmod(F.hash("id"), F.lit(1000)).cast("long"))
    return spark.range(22_000).select((i * 3 + 7).alias("o"), key.alias("k"), v.alias("v"), F.lit("x").alias("odd `name.")).cache()


@pytest.mark.parametrize("parts", [1, 7, 61])
def test_scans_equal_windows(hot, parts):
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = hot.select("o", F.lag("v").over(w).alias("a"), F.lag("v", 2).over(w).alias("b"), F.lag("v", 3).over(w).alias("c"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.last("v", True).over(upto).alias("f"))
    made = scan.lagged(hot, F.col("v"), ["k"], ["o"], 3, parts)
    made = scan.running_sum(made, F.col("v"), ["k"], ["o"], "s", parts)
    made = scan.filled(made, F.col("v"), ["k"], ["o"], "f", parts)
    assert made.columns == [*hot.columns, "lag_1", "lag_2", "lag_3", "s", "f"]
    assert sorted(map(tuple, made.select("o", "lag_1", "lag_2", "lag_3", "s", "f").collect())) == sorted(map(tuple, want.collect()))


def test_ranges_split_a_key(hot):
    sizes = [r["count"] for r in scan.ranged(hot, ["k"], ["o"], 16).where("k = 'hot'").groupBy(scan.RANGE).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 4000


def test_no_rows_and_no_keys(spark, hot):
    assert scan.lagged(hot.limit(0), F.col("v"), ["k"], ["o"]).count() == 0
    whole = scan.running_sum(hot, F.lit(1), [], ["o"], "n", 9)
    assert {(r.o - 7) // 3 + 1 - r.n for r in whole.collect()} == {0}


def test_second_differences_of_one_series(spark):
    df = spark.range(5000).select(F.col("id").alias("i"), (F.pmod(F.hash("id"), F.lit(1 << 20)) - (1 << 19)).cast("long").alias("v"), F.lit("one").alias("k"))
    d = W.differences(df, "v", "i", ["k"], 23)
    packed = d.select("i", "k", "v", F.when(F.col("d1").isNull(), F.col("v")).alias("start"), F.when(F.col("d2").isNull(), F.col("d1")).alias("slope"), "d2")
    assert W.undifferenced(packed, "i", ["k"], parts=23).where(~F.col("v").eqNullSafe(F.col("rebuilt"))).count() == 0
    con = duckdb.connect()
    rows = df.toPandas()  # noqa: F841
    want = con.execute("SELECT i, v - lag(v) OVER w, v - 2 * lag(v) OVER w + lag(v, 2) OVER w FROM rows WINDOW w AS (ORDER BY i) ORDER BY 1").fetchall()
    assert [tuple(r) for r in d.select("i", "d1", "d2").orderBy("i").collect()] == want


def test_consistency_of_one_machine(spark, sf_dir):
    """The quality SQL, with all rows of the events under one machine."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (7 AS user_id) FROM read_parquet('{sf_dir}/events.parquet')")
    want = con.execute(catalog._counts("", str(catalog.REF_MS), str(catalog.AGE_MS))).fetchone()
    one = catalog.shuffled(spark, sf_dir).withColumn("equipment_id", F.when(F.col("equipment_id").isNotNull(), "7"))
    row = Q.quality_counts(one, float(catalog.REF_MS), float(catalog.AGE_MS)).first()
    assert tuple(row) == want
