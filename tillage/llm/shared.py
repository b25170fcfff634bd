"""Tables read by the queries, and scratch tables in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are long, so Arrow batches hold fewer rows and bytes than Spark's defaults.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(2**63 - 1), str(16 << 20))}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, (default, smaller) in ARROW.items():
        if spark.conf.get(key, None) in (default, None):  # a value of the user's own stays
            spark.conf.set(key, smaller)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and driver and executors are one
    process, as in tests.  A cluster that names no shared folder is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tillage.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tillage-")
        spark.conf.set("tillage.scratch.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tillage-{name}-{uuid.uuid4().hex}"


#: Rows of a scratch file, where their number is known beforehand; a file for every shuffle partition would hold a few.
ROWS_A_FILE = 50_000


def save(df: DataFrame, name: str, rows: int | None = None, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files: this cuts lineage and outlives executors.

    ``rows``: at most so many will come, if that is known.  They are then written as so many files as they fill at most,
    by as many tasks; with many rows this changes nothing.  ``paths`` gets the table's path, to be deleted when no lazy
    result needs it any more.
    """
    path = scratch_path(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str, distinct: bool = False, sort: bool = False, buckets: int | None = None, paths: list[str] | None = None) -> DataFrame:
    """As save(), in buckets by ``keys``: joins and groups by these keys move none of its rows again.  ``distinct``: a row
    for each key, found after the one shuffle; ``sort``: buckets are in order of their keys.

    Spark writes buckets by a table's name only.  The name goes at once, the files stay.
    """
    spark = df.sparkSession
    table, path = f"tillage_{name}_{uuid.uuid4().hex}", scratch_path(spark, name)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, *keys)
    dealt = dealt.dropDuplicates([*keys]) if distinct else dealt
    writer = dealt.write.bucketBy(buckets, *keys)
    (writer.sortBy(*keys) if sort else writer).option("path", path).option("compression", "zstd").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    if paths is not None:
        paths.append(path)
    return found


def worker_objects() -> dict:
    """What this Python worker keeps over the tasks of one stage.  A task of another stage starts with nothing, and with
    the memory given back that the last stage's objects and arrays took.

    Functions reach a worker by value with each task, so their modules' globals don't last; a module of this name does.
    """
    kept = sys.modules.setdefault("tillage_worker", types.ModuleType("tillage_worker")).__dict__
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if "objects" not in kept or kept["stage"] != stage:
        kept.update(stage=stage, objects={})
        release()
    return kept["objects"]


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """An object that lasts as long as the Python worker works for this stage."""
    kept = worker_objects()
    if key not in kept:
        kept[key] = make()
    return kept[key]


def release() -> None:
    """Give free memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def least_hashes(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of some three times ``n`` keys, those with the least hashes, or all if there are fewer.  To take ``n`` keys
    in order of their hashes is then small work, whatever there are."""
    share = min(1.0, 3 * n / max(1, rows.agg(F.approx_count_distinct(key)).first()[0]))
    return rows.where(F.xxhash64(key) <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))))


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables that no later step reads."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()
