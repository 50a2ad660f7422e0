"""Reads that lose a broken line only: what is sound as rows, what isn't as (line, text, reason)."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.values import quoted
from strandline.sources.series import numbered_lines
from strandline.sources.text import check_header, without_bom

REJECTED = ("line", "text", "reason")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of the lines of one file that aren't blank, numbered from 1, without carriage returns and a leading byte order mark."""
    lines = numbered_lines(spark, path).select((F.col("line") + 1).alias("line"), F.regexp_replace("value", "\\r$", "").alias("text"))
    lines = lines.withColumn("text", F.when(F.col("line") == 1, F.regexp_replace("text", "^\\uFEFF", "")).otherwise(F.col("text")))
    return lines.where(F.btrim("text") != "")


def _parts(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """judged: line, text, reason (null: sound) and row, a struct."""
    return judged.where(F.col("reason").isNull()).select("line", "row.*"), judged.where(F.col("reason").isNotNull()).select(*REJECTED)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their line, rejected) of a file of JSON lines; schema: the fields, as in DDL.

    A line is rejected as no JSON (NaN and infinities aren't), as no object, or for a value that isn't of its field's type. Blank lines are skipped.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowNonNumericNumbers": "false"}
    read = F.from_json("text", f"{schema}, _broken string", options)
    sound = F.try_parse_json("text").isNotNull() | F.from_json("text", "map<string,string>", options | {"columnNameOfCorruptRecord": "_none"}).isNotNull()
    reason = F.when(F.col("read").isNull() | (F.col("read._broken").isNotNull() & ~sound), "no JSON").when(~F.btrim("text").startswith("{"), "no object").when(F.col("read._broken").isNotNull(), "a value is not of its type")
    judged = _lines(spark, path).withColumn("read", read).select("line", "text", reason.alias("reason"), F.col("read").dropFields("_broken").alias("row"))
    return _parts(judged)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows with their line, rejected) of a delimited file whose first line names the columns; all values text, short lines filled with null.

    A line is rejected for fields beyond the header, or for a quote that it opens and doesn't close: a record is one line here. A header with an empty or repeated name is an error.
    """
    head = spark.read.text(path).limit(1).collect()
    header = next(csv.reader(io.StringIO(without_bom(head[0][0])), delimiter=delimiter), []) if head else []
    check_header(header)
    names = [*header, "_beyond"]
    read = F.from_csv("text", ", ".join(f"{quoted(n)} string" for n in names), {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE"})
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    reason = F.when(quotes % 2 != 0, "a quote is not closed").when(F.col("read").getField("_beyond").isNotNull(), "fields beyond the header")
    judged = _lines(spark, path).where(F.col("line") > 1).withColumn("read", read)
    row = F.struct(*[F.col("read").getField(n).alias(n) for n in header])
    return _parts(judged.select("line", "text", reason.alias("reason"), row.alias("row")))


def read_dirty_and_truth(spark: SparkSession, dirty: str, truth: str, key: str = "tid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dirty, truth, rejected): a table whose rows are named by their place, from 1, as `key`, and its right cells (key, attribute, correct_val).

    The place of a row is that among all lines, rejected ones too, so a broken line moves no other.
    """
    rows, bad = read_delimited(spark, dirty)
    cells, worse = read_delimited(spark, truth)
    dirty_rows = rows.withColumn(key, (F.col("line") - 1).cast("string")).drop("line")
    return dirty_rows, cells.drop("line"), bad.withColumn("file", F.lit("dirty")).unionByName(worse.withColumn("file", F.lit("truth")))
