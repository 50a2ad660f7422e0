"""Reports that look at records from many sides read them once."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import govern as G


def test_before_and_after_reads_once(spark):
    seen, n = spark.sparkContext.accumulator(0), 200

    @F.udf("string")
    def told(x):
        seen.add(1)
        return str(x)

    rows = spark.range(n).select(F.col("id").alias("source_index"), F.concat(F.lit("m"), F.col("id") % 5).alias("equipment_id"), F.lit("1700000000000").alias("timestamp_ms"), told.asNondeterministic()("id").alias("value"))
    master = {"equipment_id": spark.createDataFrame([(f"M{i}",) for i in range(5)], "m string")}
    made = {r.phase: r for r in G.before_and_after(rows, G.govern(rows), master, 1.7e12).collect()}
    assert made["before"].n == made["after"].n == n and made["after"].referential_integrity == 100.0
    assert seen.value <= 4 * n  # records as they came, and the two sides of the search for duplicates
