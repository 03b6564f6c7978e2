"""Files as rows: hashes and Parquet footers read in the tasks, a stream at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

#: Bytes that a task holds of a file it hashes.
BLOCK = 8 << 20


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a name as Spark's listing gives it, which quotes nothing."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(spark: SparkSession, paths: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of every file that has any bytes, as Spark's scans leave out others; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(paths if isinstance(paths, str) else list(paths)).select("path", "length", "modificationTime")


def stream_sha256(path: str, block: int = BLOCK) -> str:
    """Of a file of any length, block by block."""
    system, name = _located(path)
    digest, buffer = hashlib.sha256(), bytearray(block)
    with system.open_input_file(name) as f:
        while n := f.readinto(buffer):
            digest.update(memoryview(buffer)[:n])
    return digest.hexdigest()


def file_hashes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, length, file_sha256) of the raw bytes of every file.

    Files are dealt over tasks by their size, and a task streams each through a fixed
    buffer, so a file may be longer than a row or a task's memory could be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path")):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([stream_sha256(path.as_py())])], names=["path", "length", "file_sha256"])

    return listed(spark, paths).select("path", "length").mapInArrow(run, "path string, length long, file_sha256 string")


def footer_schema(path: str) -> T.StructType:
    """Columns of a Parquet file as Spark types, read from its footer; a type Spark has no name for is a null type."""
    system, name = _located(path)
    with system.open_input_file(name) as f:
        found = pq.read_schema(f)
    return T.StructType([T.StructField(c.name, _spark_type(c.type), True) for c in found])


def _spark_type(kind: pa.DataType) -> T.DataType:
    if pa.types.is_dictionary(kind):
        kind = kind.value_type
    try:
        return from_arrow_type(kind, prefer_timestamp_ntz=True)
    except Exception:
        return T.NullType()


def schema_differences(schema: T.StructType, expected: T.StructType) -> dict[str, list[str]]:
    """Missing columns and columns of another type; extra columns are allowed."""
    have = {f.name: f.dataType for f in schema.fields}
    return {
        "missing": [f.name for f in expected.fields if f.name not in have],
        "wrong_type": [f.name for f in expected.fields if f.name in have and have[f.name] != f.dataType],
    }


def schema_problems(spark: SparkSession, paths: str | Sequence[str], expected: T.StructType) -> DataFrame:
    """(path, length, missing, wrong_type, unreadable): one row per file, empty lists and null for a file as expected.

    Footers are read in the tasks, one file at a time. A file without a readable
    footer has its error in `unreadable` and no lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict[str, Any]] = []
            for path in batch.column("path"):
                try:
                    found.append(schema_differences(footer_schema(path.as_py()), expected) | {"unreadable": None})
                except (pa.ArrowException, OSError) as error:
                    found.append({"missing": [], "wrong_type": [], "unreadable": str(error)[:200]})
            told = {"missing": pa.list_(pa.string()), "wrong_type": pa.list_(pa.string()), "unreadable": pa.string()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([f[c] for f in found], kind) for c, kind in told.items()]], names=["path", "length", *told])

    schema = "path string, length long, missing array<string>, wrong_type array<string>, unreadable string"
    return listed(spark, paths).select("path", "length").mapInArrow(run, schema)


def broken(problems: DataFrame) -> DataFrame:
    return problems.filter((F.size("missing") > 0) | (F.size("wrong_type") > 0) | F.col("unreadable").isNotNull())


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the subfolders that a finished job wrote, in order of name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()]
    return sorted(n for n in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
