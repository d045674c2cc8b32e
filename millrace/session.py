"""Session helpers shared by every subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a session that runs in one process may have none: it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = spark.conf.get("spark.millrace.local.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.millrace.local.dir", found)
        _made.append(found)
    return found


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/millrace-{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more, before the driver ends."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path in _made:
            remove(df.sparkSession, path)
            _made.remove(path)


#: Bytes of an Arrow batch that goes to a Python worker (one row at least): it is held several times, on both sides.
BATCH_BYTES = 4 << 20
#: A worker has one core, so libraries start no threads of their own, and what is freed goes back to the machine:
#: workers live on from stage to stage, beside a JVM that keeps its heap.
WORKER_ENV = {
    "TOKENIZERS_PARALLELISM": "false",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(16 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(16 << 20),
}


#: Rows of a few numbers each that are broadcast at most.
FEW = 1_000_000


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df marked for a broadcast if it has no more rows than that; else a join shuffles it. df is counted, so it should be
    a written table."""
    return F.broadcast(df) if df.count() <= rows else df


def workers_import(spark: SparkSession) -> None:
    """Makes the session's Python workers ready: they import this package from where the driver has it (single-machine
    sessions), get bounded batches, and hold no more memory than they use. What the user has set stays."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, "64m") in ("67108864b", "64m"):
        spark.conf.set(limit, str(BATCH_BYTES))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that df reads, 0 if it has none; no job runs."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else 0


@atexit.register
def _clean() -> None:
    spark = SparkSession._instantiatedSession
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            for path in _made:
                remove(spark, path)
    except Exception:  # the JVM may have ended before the driver's Python
        pass
