"""Literal search over text and zstd files: where each hit lies, in order, and what could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.strings import trim_line
from millrace.operators import search
from millrace.sources import text

#: What orders hits: file by file in the order of their paths, block by block, line by line.
ORDER = ["path", "chunk", "seq", "offset"]


def lines_of_files(spark: SparkSession, paths: list[str], index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, chunk, seq, line), (path, chunk, error)) of all text and zstd files in paths: a chunk is where a block of a
    text file begins or the number of a frame, seq rises with the lines of a chunk. A frame that can't be read is an
    error and the others go on. index: of the zstd files, if there is one already."""
    raw = spark.read.option("pathGlobFilter", text.TXT).option("recursiveFileLookup", True).text(paths)
    plain = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("seq"), trim_line(F.col("value")).alias("line"))
    index = index if index is not None else text.frame_index(spark, paths)
    lines, faults = text.zstd_lines(spark, index.where("error IS NULL"))
    lines = lines.withColumnRenamed("frame", "chunk")
    errors = faults.withColumnRenamed("frame", "chunk").unionByName(text.damaged(index).select("path", F.col("frame").alias("chunk"), "error"))
    return plain.where("line != ''").unionByName(lines), errors


def search_files(spark: SparkSession, paths: list[str], pattern: str, per_chunk: int | None = None, matched: int | None = None, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, chunk, seq, offset, line[, capped]), (path, chunk, error)): hits in no order; with per_chunk the first so many of each chunk."""
    lines, errors = lines_of_files(spark, paths, index)
    hits = search.occurrences(lines, pattern, "line", matched)
    if per_chunk is not None:
        hits = search.capped(hits, ["path", "chunk"], ["seq", "offset"], per_chunk)
    return hits, errors


def first_hits(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits in order, all or the first so many."""
    return search.limited(hits, ORDER, limit) if limit is not None else hits.orderBy(*ORDER)
