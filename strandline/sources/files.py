"""Data sources for files that Spark's readers can't take whole: hashes of files of any size, rows of zipped tables.

    register(spark)
    spark.read.format("file_hashes").load(folder)
    spark.read.format("zipped_rows").option("columns", "TP2,COMP").option("expected", 1516948).load("readings.zip")

Files are reached through pyarrow's file systems (local ones, HDFS, object stores), by tasks, one file or member each.
"""

from __future__ import annotations

import csv
import hashlib
import io
import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes, or rows, that a task holds at once.
CHUNK, ROWS = 1 << 23, 1 << 16
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _opened(path: str):
    """(file system, path there) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _One(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class FileHashes(DataSource):
    """(name, size, sha256) of each file below a folder, names relative to it; read in chunks, so a file may be larger than memory."""

    @classmethod
    def name(cls) -> str:
        return "file_hashes"

    def schema(self) -> str:
        return "name string, size bigint, sha256 string"

    def reader(self, schema: object) -> DataSourceReader:
        return _HashReader(self.options["path"])


class _HashReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, top = _opened(self.path)
        top = top.rstrip("/")
        found = system.get_file_info(fs.FileSelector(top, recursive=True))
        return [_One(self.path, f.path.removeprefix(top).lstrip("/")) for f in found if f.type == fs.FileType.File] or [_One(self.path, "")]

    def read(self, partition: _One) -> Iterator[tuple]:
        if not partition.name:
            return
        system, top = _opened(partition.path)
        sums, size = hashlib.sha256(), 0
        with system.open_input_stream(f"{top.rstrip('/')}/{partition.name}") as f:
            while part := f.read(CHUNK):
                sums.update(part)
                size += len(part)
        yield partition.name, size, sums.hexdigest()


class ZippedRows(DataSource):
    """Rows of the delimited members of a zip file: member, source_row (from 0) and the columns asked for, as text.

    Options: columns (by commas; all of the first member's header, if not given), delimiter, expected (rows of all members together are checked against it: with several members
    give it as member=rows, by commas). A member is one task; it is inflated as a stream. Only the columns asked for leave the task.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_rows"

    def _columns(self) -> list[str]:
        if self.options.get("columns"):
            return self.options["columns"].split(",")
        system, path = _opened(self.options["path"])
        with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as z, z.open(z.namelist()[0]) as f:
            return next(csv.reader(io.TextIOWrapper(f, "utf-8-sig"), delimiter=self.options.get("delimiter", ",")))

    def schema(self) -> str:
        return ", ".join(["member string", "source_row bigint", *[f"`{c.replace('`', '``')}` string" for c in self._columns()]])

    def reader(self, schema: object) -> DataSourceReader:
        return _ZipReader(self.options["path"], [f.name for f in schema.fields][2:], self.options.get("delimiter", ","), self.options.get("expected"))


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], delimiter: str, expected: str | None):
        self.path, self.columns, self.delimiter, self.expected = path, columns, delimiter, expected

    def partitions(self) -> list[InputPartition]:
        system, path = _opened(self.path)
        with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
            members = [n for n in z.namelist() if not n.endswith("/")]
        if self.expected and "=" not in self.expected and len(members) > 1:
            raise ValueError("give expected rows as member=rows where there are several members")
        return [_One(self.path, m) for m in members]

    def _wanted(self, member: str) -> int | None:
        if not self.expected:
            return None
        if "=" not in self.expected:
            return int(self.expected)
        return next((int(n) for m, n in (x.rsplit("=", 1) for x in self.expected.split(",")) if m == member), None)

    def read(self, partition: _One) -> Iterator[pa.RecordBatch]:
        system, path = _opened(partition.path)
        schema = pa.schema([("member", pa.string()), ("source_row", pa.int64()), *[(c, pa.string()) for c in self.columns]])
        with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as z, z.open(partition.name) as f:
            rows = csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline=""), delimiter=self.delimiter)
            header = next(rows, [])
            missing = [c for c in self.columns if c not in header]
            if missing:
                raise ValueError(f"{partition.name} lacks {', '.join(missing)}")
            at = [header.index(c) for c in self.columns]
            held: list[list[str | None]] = []
            n = 0
            for row in rows:
                if not row:
                    continue
                if len(row) > len(header):
                    raise ValueError(f"{partition.name}: row {n} has fields beyond the header")
                held.append([row[i] if i < len(row) else None for i in at])
                n += 1
                if len(held) == ROWS:
                    yield self._batch(partition.name, n, held, schema)
                    held = []
            if held:
                yield self._batch(partition.name, n, held, schema)
        wanted = self._wanted(partition.name)
        if wanted is not None and wanted != n:
            raise ValueError(f"{partition.name} has {n} rows, not {wanted}")

    def _batch(self, member: str, n: int, held: list[list[str | None]], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) if self.columns else []
        return pa.RecordBatch.from_arrays([pa.array([member] * len(held)), pa.array(range(n - len(held), n), pa.int64()), *[pa.array(c, pa.string()) for c in columns]], schema=schema)


def register(spark: SparkSession) -> None:
    for source in (FileHashes, ZippedRows):
        spark.dataSource.register(source)


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, ok, size, sha256) of the manifest's files (name, size, sha256) below path; a name that leaves the folder, or isn't there, is not ok. Files may have any size."""
    register(spark)
    files = spark.read.format("file_hashes").load(path).select("name", F.col("size").alias("_size"), F.col("sha256").alias("_sum"))
    inside = ~F.col("name").rlike(r"\\|^/|(^|/)\.\.?(/|$)")
    met = manifest.join(files, "name", "left")
    return met.select("name", F.coalesce(inside & (F.col("size") == F.col("_size")) & (F.lower("sha256") == F.col("_sum")), F.lit(False)).alias("ok"), F.col("_size").alias("size"), F.col("_sum").alias("sha256"))
