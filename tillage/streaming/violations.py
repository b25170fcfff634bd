"""Violation rates over a stream of events, with a watermark for late ones or, in a backfill, none."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions import guardrails


def stream_of(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """A table in a folder, one file or a directory of part files, as a stream, a few files a trigger."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        return stream.parquet(f"{folder}/{file}")
    return stream.option("pathGlobFilter", file).parquet(folder)  # a stream's path has to be a directory


def hourly_rates(events: DataFrame, late: str | None = "2 hours") -> DataFrame:
    """Events of each kind in each hour; hours older than the watermark are closed and forgotten.  ``late``: None for a
    backfill, whose files come in any order; no event is late then, and all hours stay in the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return guardrails.violation_rates(timed.withWatermark("ts", late) if late else timed, "ts", "event_type")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where driver and executors are one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return root.rstrip("/")


def run_once(rates: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there and return the last state of each window.  The checkpoint lets a restarted query go on."""
    spark = rates.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    rates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "batch").alias("n"))
