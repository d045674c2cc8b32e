"""Deduplication of a stream, with state bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet file as a stream of files."""
    at = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(at).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events whose key has not come within the watermark's span before."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_once(events: DataFrame, folder: str, checkpoint: str) -> None:
    """Works off all there is and stops; a restart goes on from the checkpoint."""
    events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
