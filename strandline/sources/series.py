"""Files of series and sensors: labelled series, a matrix with a label file, machine readings, bearings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.values import is_finite

#: Channels of the machine readings.
ANALOG = ("TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Oil_temperature", "Motor_current")
DIGITAL = ("COMP", "DV_eletric", "Towers", "MPG", "LPS", "Pressure_switch", "Oil_level", "Caudal_impulses")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of one file, numbered from 0 in the file's order.

    Splits keep a file's order and get increasing ids, so the number is the place among ids, found from counts for each partition
    and not from a sort of all lines in one task.
    """
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("_i"), "value")
    part = F.shiftright("_i", 33)
    sizes = raw.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    starts = sizes.select("_p", before.alias("_s"))
    return raw.withColumn("_p", part).join(F.broadcast(starts), "_p").select((F.col("_s") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).alias("line"), "value")


def read_labelled_series(spark: SparkSession, path: str, split: str, length: int | None = None, entity: str = "series") -> DataFrame:
    """(source_split, source_row, equipment_id, label, values) of the lines after @data: values, then a colon and the label; # starts a comment.

    A line of another length than `length`, or with what is no finite number, fails the job.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.btrim("value", F.lit(" \t\r")))
    mark = lines.where(F.lower("value") == "@data").agg(F.min("line").alias("_m"))
    body = lines.crossJoin(F.broadcast(mark)).where((F.col("line") > F.col("_m")) & (F.col("value") != "") & ~F.col("value").startswith("#"))  # one row
    parts = F.transform(F.split(F.regexp_extract("value", "^(.*):[^:]*$", 1), ","), lambda x: x.try_cast("double"))
    label = F.regexp_extract("value", ":([^:]*)$", 1).try_cast("int")
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | label.isNull()
    if length is not None:
        bad = bad | (F.size(parts) != length)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("broken line "), F.col("line")))).otherwise(parts).cast("array<double>")
    return body.select(F.lit(split).alias("source_split"), F.col("line").alias("source_row"), F.concat(F.lit(f"{entity}-{split}-"), "line").alias("equipment_id"), label.alias("label"), checked.alias("values"))


def read_matrix(spark: SparkSession, path: str, labels: str, zone_format: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    """(wafer_id, label, timestamp, timestamp_ms, values) of a blank-separated matrix and the label file that goes with it line by line; NaN is null."""
    cells = F.transform(F.split(F.btrim("value"), r"\s+"), lambda x: F.when(F.lower(x) != "nan", x.try_cast("double")))
    matrix = numbered_lines(spark, path).where(F.btrim("value") != "").select("line", cells.alias("values"))
    told = numbered_lines(spark, labels).where(F.btrim("value") != "").select("line", F.regexp_extract("value", r"^\s*(\S+)", 1).cast("int").alias("label"), F.regexp_extract("value", '"([^"]*)"', 1).alias("timestamp"))
    return matrix.join(told, "line", "full").select(
        F.when(F.col("values").isNull() | F.col("label").isNull(), F.raise_error(F.lit("the files differ in length"))).otherwise(F.col("line") + 1).cast("int").alias("wafer_id"),
        "label", "timestamp", F.unix_millis(F.to_timestamp("timestamp", zone_format)).alias("timestamp_ms"), "values",
    )


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, failing the job at the first row for which a rule, by name, isn't true."""
    first = df.columns[0]
    guard = F.col(first)
    for name, rule in rules.items():
        guard = F.when(F.coalesce(rule, F.lit(False)), guard).otherwise(F.raise_error(F.lit(f"rule broken: {name}")).cast(df.schema[first].dataType))
    return df.withColumn(first, guard)


def read_machine(spark: SparkSession, path: str, equipment: str = "APU", channels: tuple[str, ...] = (*ANALOG, *DIGITAL)) -> DataFrame:
    """(source_row, timestamp_ms, equipment_id, channels) of machine readings; only the channels asked for are parsed and checked.

    Analog channels must be finite, digital ones 0 or 1, times positive.
    """
    raw = spark.read.option("header", "true").csv(path)
    index = F.col(raw.columns[0]).cast("long")
    ms = F.unix_millis(F.to_timestamp("timestamp", "yyyy-MM-dd HH:mm:ss"))
    made = raw.select(ms.alias("timestamp_ms"), index.alias("source_row"), F.lit(equipment).alias("equipment_id"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in channels])
    rules = {"timestamp_ms": F.col("timestamp_ms") > 0} | {c: F.col(c).isin(0.0, 1.0) if c in DIGITAL else is_finite(F.col(c)) for c in channels}
    return checked(made, rules)


def sequence_of(machine: DataFrame, channel: str) -> DataFrame:
    return machine.select("source_row", "timestamp_ms", "equipment_id", F.col(channel).alias("value"))


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure windows: (work_order, equipment_id, start_ms, end_ms, failure, severity), times in UTC."""
    raw = spark.read.option("header", "true").schema("failure_id string, equipment_id string, start_time string, end_time string, failure string, severity string").csv(path)
    ms = lambda c: F.unix_millis(F.to_timestamp(F.col(c)))
    return raw.select(F.col("failure_id").alias("work_order"), "equipment_id", ms("start_time").alias("start_ms"), ms("end_time").alias("end_ms"), "failure", "severity")


def read_bearings(spark: SparkSession, path: str, equipment: str = "bearings", step_ns: int = 50_000) -> DataFrame:
    """(sample_index, timestamp_ns, equipment_id, bearing_1..4) of tab-separated samples at a fixed rate."""
    lines = numbered_lines(spark, path).where(F.btrim("value") != "")
    cells = F.split(F.btrim("value"), r"\t")
    return lines.select(F.col("line").alias("sample_index"), (F.col("line") * step_ns).alias("timestamp_ns"), F.lit(equipment).alias("equipment_id"), *[cells[i].cast("double").alias(f"bearing_{i + 1}") for i in range(4)])

