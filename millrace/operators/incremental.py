"""New rows against a library of what earlier runs kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.dedup import first_of_key
from millrace.session import written


def other_runs(library: DataFrame, run_id: str, run_col: str = "run_id") -> DataFrame:
    """The library without the current run's own rows."""
    return library.where(F.col(run_col) != run_id)


def unseen(batch: DataFrame, library: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key that the library lacks. Rows are reduced to one a key before they move, so a key with
    any share of the batch is one row of the join, which has the same partitioning."""
    return first_of_key(batch, keys, order).join(library.select(*keys).distinct(), keys, "left_anti")


def seen(batch: DataFrame, library: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of batch whose key the library has. The library's distinct keys are written, so that both sides of the
    join are plain shuffles and one with a frequent key can be split while it runs."""
    return batch.join(written(library.select(*keys).distinct(), "known"), keys, "left_semi")


def run_stats(batch: DataFrame, library: DataFrame, keys: list[str]) -> DataFrame:
    """What a run would do, without writing: rows accepted, new keys, rows that the library has, and repeats of new keys."""
    known = library.select(*keys).distinct().withColumn("known", F.lit(True))
    per_key = batch.groupBy(*keys).agg(F.count("*").alias("n")).join(known, keys, "left")
    got = F.coalesce("known", F.lit(False))
    zero = F.lit(0)
    return per_key.agg(
        F.coalesce(F.sum("n"), zero).alias("n_accepted"), F.count_if(~got).alias("n_new"),
        F.coalesce(F.sum(F.when(got, F.col("n"))), zero).alias("n_skipped"), F.count_if(got).alias("n_common_keys"),
        F.coalesce(F.sum(F.when(~got, F.col("n") - 1)), zero).alias("n_duplicates"),
    )
