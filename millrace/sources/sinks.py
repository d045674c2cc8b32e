"""Outputs: text, Parquet with zstd, rolling parts; whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import workers_import

PER_PART = 100_000_000


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _path(spark, path)
    return bool(system.exists(p))


def check_apart(spark: SparkSession, output: str, inputs: list[str]) -> None:
    """An error if output is an input, or lies in or around one."""
    system, out = _path(spark, output)
    out = system.makeQualified(out).toString().rstrip("/") + "/"
    for path in inputs:
        s, p = _path(spark, path)
        p = s.makeQualified(p).toString().rstrip("/") + "/"
        if out.startswith(p) or p.startswith(out):
            raise ValueError(f"the output {output} and the input {path} overlap")


def write(rows: DataFrame, path: str, kind: str = "parquet", per_part: int = PER_PART, inputs: list[str] | None = None) -> bool:
    """Writes rows to a new folder, with at most per_part rows a file; False, and nothing written, if there are none.

    A failed job leaves no _SUCCESS and no part in place (the committer moves parts at the end).
    """
    spark = rows.sparkSession
    check_apart(spark, path, inputs or [])
    if per_part < 1:
        raise ValueError("per_part must be 1 or more")
    if rows.isEmpty():
        return False
    out = rows.write.option("maxRecordsPerFile", per_part)
    if kind == "text":
        out.option("lineSep", "\n").text(path)
    elif kind == "parquet":
        out.option("compression", "zstd").parquet(path)
    else:
        raise ValueError(f"unknown kind of output: {kind}")
    return True


def write_encoded(rows: DataFrame, folder: str, suffix: str, encode: Callable[[Iterator[str], int], Iterator[bytes]], line: str = "line") -> int:
    """Writes a file part-NNNNN + suffix for each partition that has rows, in a form that Spark has no writer for: encode
    turns a partition's lines, and its number, into bytes. A file gets its name when it is whole; how many there are."""
    workers_import(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        full = (b for b in batches if b.num_rows)
        if (head := next(full, None)) is None:
            return
        part = TaskContext.get().partitionId()
        system.create_dir(at, recursive=True)
        draft = f"{at}/_{part}-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            for data in encode((x for b in chain([head], full) for x in b.column(0).to_pylist()), part):
                out.write(data)
        name = f"{at}/part-{part:05d}{suffix}"
        if system.get_file_info(name).type == fs.FileType.NotFound:
            system.move(draft, name)
        else:  # of a task that was run twice
            system.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

    return rows.select(line).mapInArrow(run, "n long").agg(F.count("n")).first()[0]
