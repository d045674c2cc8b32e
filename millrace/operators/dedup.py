"""Exact deduplication on chosen key columns, and numbering of rows over the whole input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import few, written


def first_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key its first row in `order`. The least row is a partial aggregate, so a key with any share of
    the rows is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    ranked = order + [c for c in rest if c not in order]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*(c for c in ranked if c not in keys))).alias("first"))
    return least.select(*(F.col(c) if c in keys else F.col(f"first.{c}").alias(c) for c in rows.columns))


def first_of_content(rows: DataFrame, content: str, ids: list[str]) -> DataFrame:
    """The row of each distinct content (by digest and length) with the least ids, which tell rows apart; null is a content.
    Contents stay where they are unless more rows go than can be broadcast: what moves is digests and ids."""
    digest, size = F.coalesce(F.sha2(content, 256), F.lit("")), F.coalesce(F.octet_length(content), F.lit(-1))
    keyed = rows.select(digest.alias("_digest"), size.alias("_size"), F.struct(*ids).alias("_ids"))
    least = keyed.groupBy("_digest", "_size").agg(F.min("_ids").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    go = keyed.join(few(written(least, "repeated")), ["_digest", "_size"]).where("_ids != _first").select("_ids.*")
    return rows.join(few(written(go, "copies")), ids, "left_anti")


def union_distinct(*runs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, runs).distinct()


def once_per_content(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """(digest, order, n_rows): the first row of each distinct content, by its columns in `order`, and how many rows have
    it: what an expensive step has to see. Contents are not moved, only their digests."""
    digest = F.sha2(content, 256)
    least = rows.select(digest.alias("digest"), *order).groupBy("digest").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n_rows"))
    return least.select("digest", *(F.col(f"first.{c}").alias(c) for c in order), "n_rows")


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """rows with their place in `order`, from 1. Ranges are sorted apart; only their sizes are summed in one task. Rows
    that are equal in `order` may be dealt over several ranges."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    part = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    part = written(part.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    at = F.shiftright("_at", 33)
    sizes = part.groupBy(at.alias("_part")).agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    local = F.col("_at") - F.shiftleft(at, 33)
    return part.withColumn("_part", at).join(F.broadcast(base), "_part").select(*rows.columns, (F.col("_base") + local + 1).alias(name))


def part_numbers(rows: DataFrame, order: list[str], per_part: int) -> DataFrame:
    """rows with the output part (from 1) that a writer opening a new part every per_part rows would use."""
    if per_part < 1:
        raise ValueError("per_part must be 1 or more")
    return numbered(rows, order).withColumn("part", F.expr(f"(number - 1) div {per_part} + 1")).drop("number")
