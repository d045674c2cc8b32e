"""Literal search: one hit for each occurrence, with caps, order and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _needle(pattern: str) -> str:
    if not pattern:
        raise ValueError("the pattern is empty")
    if "\n" in pattern:
        raise ValueError("the pattern may not hold a line feed")
    return pattern


def matching(lines: DataFrame, pattern: str, line: str = "line") -> DataFrame:
    """Lines that hold the pattern, byte for byte; * alone is every non-empty line. The predicate reaches a scan."""
    if _needle(pattern) == "*":
        return lines.where(F.length(line) > 0)
    return lines.where(F.col(line).contains(pattern))


def _running(sizes: Column, start: Column) -> Column:
    """start, and start with each further element of sizes added."""
    return F.aggregate(sizes, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _starts(sizes: Column) -> Column:
    """The sum of all elements before each element. Each step copies what it extends, so sums are taken within stretches
    of about the root of the array's length, and over the stretches."""
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes))).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / wide).cast("int") - 1), lambda k: F.slice(sizes, k * wide + 1, wide))
    bound = F.transform(F.array(parts), lambda p: F.zip_with(p, F.slice(_running(F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda acc, n: acc + n)), F.lit(0)), F.lit(1), F.size(p)), lambda x, base: F.slice(_running(x, base), F.lit(1), F.size(x))))
    return F.flatten(bound[0])


def occurrences(lines: DataFrame, pattern: str, line: str = "line", matched: int | None = None) -> DataFrame:
    """A row for each occurrence, overlapping ones too, with its byte offset in the line (0 for *). Lines are searched
    whole; with matched, only so many of their first characters are, and `cut` tells of each hit whether its line is longer."""
    if matched is not None:
        lines = lines.withColumn("cut", F.length(line) > matched)
        within = occurrences(lines.withColumn("_whole", F.col(line)).withColumn(line, F.substring(line, 1, matched)), pattern, line)
        return within.withColumn(line, F.col("_whole")).drop("_whole")
    rows = matching(lines, pattern, line)
    if pattern == "*":
        return rows.withColumn("offset", F.lit(0))
    # a line is cut before every occurrence, overlapping ones too: each piece starts one, the first only if the line does
    quoted = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pieces = F.transform(F.array(F.transform(F.split(line, f"(?={quoted})"), F.octet_length)), _starts)[0]
    first = F.startswith(line, F.lit(pattern))
    places = F.transform(F.array(pieces), lambda p: F.when(first, p).otherwise(F.slice(p, F.lit(2), F.size(p))))[0]
    return rows.withColumn("offset", F.explode(places))


def capped(hits: DataFrame, chunk: list[str], order: list[str], limit: int) -> DataFrame:
    """The first `limit` hits of each chunk; `capped` tells whether the chunk had more. Ranks above the limit are
    cut in each task before the shuffle."""
    by = Window.partitionBy(*chunk)
    totals = hits.groupBy(*chunk).agg(F.count("*").alias("total"))
    first = hits.withColumn("rank", F.row_number().over(by.orderBy(*order))).where(F.col("rank") <= limit).drop("rank")
    return first.join(totals, chunk).withColumn("capped", F.col("total") > limit).drop("total")


def limited(hits: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first `limit` hits in order."""
    return hits.orderBy(*order).limit(limit)
