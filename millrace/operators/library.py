"""A library: what all runs kept, as Parquet by run, with a table of keys beside it.

    folder/data/run_id=R/part-*.parquet   rows
    folder/keys/run_id=R/part-*.parquet   key_hash, the key columns, key_version; sorted by key_hash

Keys are written after the data, and under another name before they get their own, so a run without keys is
one that was cut off and is made good by rebuild(). Matching compares the key columns, never the hash alone;
the hash serves to read a range of the keys without the rest.
"""

from __future__ import annotations

import re
import secrets
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.strings import row_key
from millrace.operators import incremental
from millrace.sources.sinks import _path, exists

#: Changes whenever the rule for keys does; keys of another version are made anew.
KEY_VERSION = 1
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
RUN = re.compile(r"^\d{8}-[0-9A-HJKMNP-TV-Z]{6}$")


def new_run_id(now: datetime | None = None) -> str:
    """The date and six random base-32 characters."""
    return f"{now or datetime.now(UTC):%Y%m%d}-" + "".join(secrets.choice(CROCKFORD) for _ in range(6))


class Library:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], version: int = KEY_VERSION) -> None:
        self.spark, self.folder, self.keys, self.version = spark, folder.rstrip("/"), keys, version
        #: Parts that the last rebuild() could not read and left out.
        self.corrupt: list[str] = []

    def _runs(self, what: str) -> list[str]:
        system, path = _path(self.spark, f"{self.folder}/{what}")
        if not system.exists(path):
            return []
        names = [s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()]
        return sorted(n.removeprefix("run_id=") for n in names if n.startswith("run_id=") and RUN.match(n.removeprefix("run_id=")))

    def runs(self) -> list[str]:
        """Ids of the runs that have data; a folder that is there but can't be listed is an error, not an empty library."""
        return self._runs("data")

    def data(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/data") if self.runs() else None

    def key_table(self, exclude: str | None = None) -> DataFrame | None:
        """Keys of all runs but `exclude`."""
        if not self._runs("keys"):
            return None
        found = self.spark.read.parquet(f"{self.folder}/keys").withColumn("run_id", F.col("run_id").cast("string"))
        return incremental.other_runs(found, exclude) if exclude else found

    def classify(self) -> dict[str, str]:
        """fresh, missing (no keys) or stale (keys of another version, or of another number of rows) for each run."""
        data, keyed = self.runs(), set(self._runs("keys"))
        if not data:
            return {}
        rows = self.spark.read.schema("run_id string").option("ignoreCorruptFiles", "true").parquet(f"{self.folder}/data")
        n = {r.run_id: r.n for r in rows.groupBy("run_id").agg(F.count("*").alias("n")).collect()}  # a row a run
        k: dict[str, tuple[int, int]] = {}
        if keyed:
            got = self.key_table().groupBy("run_id").agg(F.count("*").alias("n"), F.min("key_version").alias("lo"), F.max("key_version").alias("hi")).collect()
            k = {r.run_id: (r.n, r.lo if r.lo == r.hi else -1) for r in got}
        return {r: "missing" if r not in keyed else "fresh" if k.get(r) == (n.get(r), self.version) else "stale" for r in data}

    def _parts(self, run_id: str) -> list[str]:
        system, path = _path(self.spark, f"{self.folder}/data/run_id={run_id}")
        found = [s.getPath() for s in system.listStatus(path) if s.isFile()]
        return sorted(p.toString() for p in found if not p.getName().startswith(("_", ".")))

    def _readable(self, part: str) -> bool:
        """Whether every column of a part can be read to its end."""
        try:
            rows = self.spark.read.option("ignoreCorruptFiles", "false").parquet(part)
            rows.agg(F.max(F.xxhash64(*rows.columns))).collect()
        except Exception as e:  # Spark has no error of its own for this
            if "FAILED_READ_FILE" not in str(e) and "CANNOT_READ_FILE" not in str(e) and "not a Parquet file" not in str(e):
                raise
            return False
        return True

    def _write_keys(self, run_id: str, parts: list[str] | None = None) -> None:
        rows = self.spark.read.parquet(*(parts or [f"{self.folder}/data/run_id={run_id}"]))
        keyed = rows.select(row_key(*self.keys).alias("key_hash"), *self.keys, F.lit(self.version).alias("key_version"))
        draft, place = f"{self.folder}/keys/_draft-{run_id}-{uuid.uuid4().hex}", f"{self.folder}/keys/run_id={run_id}"
        keyed.repartitionByRange("key_hash").sortWithinPartitions("key_hash").write.option("compression", "zstd").parquet(draft)
        (system, old), (_, new) = _path(self.spark, place), _path(self.spark, draft)
        if system.exists(old):
            system.delete(old, True)
        if not system.rename(new, old):
            raise OSError(f"the keys of run {run_id} could not get their name")

    def key_range(self, low: int, high: int, exclude: str | None = None) -> DataFrame | None:
        """Keys whose hash is low or more and less than high; keys are sorted by it, so other row groups are not read."""
        found = self.key_table(exclude)
        return found if found is None else found.where((F.col("key_hash") >= low) & (F.col("key_hash") < high))

    def rebuild(self) -> list[str]:
        """Makes the keys of runs that lack them or have stale ones; returns those runs. Parts that can't be read
        are left out and listed in `corrupt`; a run of nothing else gets no keys and is not returned."""
        todo, made = [r for r, state in self.classify().items() if state != "fresh"], []
        self.corrupt = []
        for run_id in todo:
            parts = self._parts(run_id)
            good = [p for p in parts if self._readable(p)]
            self.corrupt += sorted(set(parts) - set(good))
            if good:
                self._write_keys(run_id, good)
                made.append(run_id)
        return made

    def sweep(self) -> list[str]:
        """Removes the keys of runs without data; returns those runs."""
        orphans = sorted(set(self._runs("keys")) - set(self.runs()))
        for run_id in orphans:
            system, path = _path(self.spark, f"{self.folder}/keys/run_id={run_id}")
            system.delete(path, True)
        return orphans

    def add(self, batch: DataFrame, order: list[str], run_id: str | None = None, dry: bool = False) -> tuple[str | None, dict[str, int]]:
        """Adds what of batch is new. (run id, counters); dry only counts, and an absent library counts as empty.
        Nothing is written if nothing is new."""
        known = self.key_table(run_id)
        known = known if known is not None else batch.select(*self.keys).limit(0)
        stats = incremental.run_stats(batch, known, self.keys).first().asDict()
        if dry or not stats["n_new"]:
            return None, stats
        run_id = run_id or new_run_id()
        if not RUN.match(run_id):
            raise ValueError(f"not a run id: {run_id!r}")
        if exists(self.spark, f"{self.folder}/data/run_id={run_id}"):
            raise ValueError(f"run {run_id} is there already")
        fresh = incremental.unseen(batch, known, self.keys, order)
        fresh.write.option("compression", "zstd").parquet(f"{self.folder}/data/run_id={run_id}")
        self._write_keys(run_id)
        return run_id, stats
