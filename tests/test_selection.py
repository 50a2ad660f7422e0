"""Middles of hot keys against sorting, with bins that have to be refined."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.operators import quality as Q
from strandline.operators import selection as S
from strandline.operators import truth as T


def plain(values):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    return len(v), v[(len(v) - 1) // 2], v[len(v) // 2]


@pytest.mark.parametrize("small", [1, 5, 1 << 16])
def test_middles(spark, small):
    groups = {
        "close": [1.0 + k * 2.0**-52 for k in range(301)], "wide": [(-1.0) ** k * 3.0 ** (k % 600 - 300) for k in range(1000)], "same": [2.5] * 500, "two": [1.0, 7.0],
        "one": [-0.0], "odd": [math.inf, -math.inf, math.nan, 0.0, -1e308, 1e308, 5e-324, -5e-324, math.nan], "nan": [math.nan] * 5, None: [float(k * k) for k in range(77)], "none": [None, None],
        "copies": [1.0] * 400 + [1.5] * 399 + [1.25, 1.75],
    }
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "`a key` string, x double").repartition(5)
    got = {r["a key"]: (r.n, r.lower, r.upper) for r in S.middles(df, F.col("x"), ["a key"], small).collect()}
    want = {k: plain(v) for k, v in groups.items() if k != "none"}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [x if x == x else "nan" for x in got[k]] == [x if x == x else "nan" for x in v], k
    whole = S.middles(df, F.col("x"), [], small).first()
    assert (whole.n, whole.lower, whole.upper) == plain([x for v in groups.values() for x in v if x is not None])
    assert S.middles(df.limit(0), F.col("x"), ["a key"]).count() == 0


def test_one_hot_key_equals_sql(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    rows = spark.read.parquet(path).select(F.lit("m").alias("equipment_id"), F.when(F.col("event_id") % 97 == 0, F.col("value") * 1000).otherwise(F.col("value")).alias("value"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW r AS SELECT CASE WHEN event_id % 97 = 0 THEN value * 1000 ELSE value END AS v FROM read_parquet('{path}')")
    m = con.execute("SELECT median(v) FROM r").fetchone()[0]
    want = con.execute(f"SELECT count(*), count_if(d <= greatest(12 * s, 1e-9)) FROM (SELECT abs(v - {m!r}) AS d, (SELECT median(abs(v - {m!r})) FROM r) AS s FROM r)").fetchone()
    assert tuple(Q.stability_counts(rows).first()) == want
    made = S.middles(rows, F.col("value"), ["equipment_id"], 20).first()
    assert 0.5 * made.lower + 0.5 * made.upper == m
    assert T.throughput(rows, "value", ["equipment_id"]).first().median == pytest.approx(m)
    assert T.throughput(rows.limit(0), "value").first().runs == 0
