"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "strandline") -> SparkSession:
    """A local session with the settings on which the operators rely (UTC, AQE)."""
    os.environ.setdefault("TZ", "UTC")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may run without it; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    existing = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not existing:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        existing = sc.getCheckpointDir()
    return existing.rstrip("/")


#: Rows that a file of a small table holds, about.
ROWS = 100_000


def written(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: short lineage, computed once.

    rows: how many rows it has, about, and what its last tasks read has; they are put into no more files than ROWS asks for, as for each file
    of a local folder Hadoop starts several processes, each of which shares the executor's memory until it runs.

    The files lie below <shared>/strandline/<application id> and may be removed when the
    application has ended; losing an executor doesn't lose them.
    """
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(1 + rows // ROWS)
    path = f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
