"""Label files as a stream: each new file goes into the stored graph and the ledger, in one version of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.operators.graph import load_labels
from tillage.operators.graph_store import RULES
from tillage.sources.readers import LABEL_RECORD
from tillage.sources.store import BUCKETS, Rule, Store

LEDGER = {"ledger": Rule(("file",))}


def label_stream(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """A row for each label file of a folder, some files a trigger; a bad one has _corrupt_record."""
    rows = spark.readStream.schema(LABEL_RECORD).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files).json(folder)
    rows = rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where("NOT startswith(file, '_') AND file <> 'extraction_summary.json'")
    return rows.withColumn("stem", F.regexp_replace("file", r"\.json$", "")).withColumn("seq", F.col("stem"))


def load_batch(store: Store, batch: DataFrame, buckets: int = BUCKETS) -> int | None:
    """Merge the files of a batch that the ledger lacks: good ones into the graph, all into the ledger, as one version.

    A batch that comes again changes nothing, as its files are in the ledger by then.
    """
    if "ledger" in store.names():
        batch = batch.join(store.read("ledger").where("status = 'ok'").select("file"), "file", "left_anti")
    batch = batch.persist()
    try:
        if batch.isEmpty():
            return None
        good = batch.where("_corrupt_record IS NULL")
        size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        bad = F.col("_corrupt_record").isNotNull()
        ledger = batch.select(
            "file", F.when(bad, "failed").otherwise("ok").alias("status"), F.when(bad, F.concat(F.lit("no label record: "), F.substring("_corrupt_record", 1, 200))).alias("error"),
            *(F.when(bad, 0).otherwise(size(c)).alias(n) for n, c in (("crops", "registered_crops"), ("weeds", "registered_weeds"), ("controls", "weed_control_entries"))),
        )
        g = load_labels(good)
        g.mode_of_action = g.state = None
        return store.merge(g.tables() | {"ledger": ledger}, RULES | LEDGER, buckets=buckets)
    finally:
        batch.unpersist()


def load_available(spark: SparkSession, folder: str, store: Store, checkpoint: str, files: int = 1000, buckets: int = BUCKETS) -> DataFrame:
    """Load what the folder has and the checkpoint lacks; returns the ledger.  Safe to kill and start again at any point."""
    stream = label_stream(spark, folder, files).writeStream.foreachBatch(lambda batch, _: load_batch(store, batch, buckets) and None)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return store.read("ledger")
