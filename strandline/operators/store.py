"""Stores: sequences, relations as text, and their round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.schema import case_clashes
from strandline.functions.values import quoted


def store_sequence(df: DataFrame, path: str) -> None:
    """Compressed JSON lines; Spark's commit protocol makes the replacement whole or none."""
    df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def read_sequence(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def as_relation(df: DataFrame) -> DataFrame:
    """All columns as text, by name; null is ''. Names that differ in case only are an error; no columns give `_empty`."""
    if clash := case_clashes(df.columns):
        raise ValueError(f"columns differ in case only: {', '.join(clash)}")
    if not df.columns:
        return df.sparkSession.createDataFrame([], "_empty string")
    return df.select(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(c) for c in sorted(df.columns)])


def store_relation(df: DataFrame, path: str) -> None:
    as_relation(df).write.mode("overwrite").option("compression", "gzip").parquet(path)


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def checksum(df: DataFrame) -> DataFrame:
    """(n, sum): number of rows and a checksum that doesn't depend on their order."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(quoted(c)) for c in df.columns]).cast("decimal(38,0)")).alias("sum"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, duplicates counted."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
