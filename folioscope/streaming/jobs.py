"""Streams: new files, the state of jobs, and the event log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from folioscope.operators.library import job_states
from folioscope.sources.files import ignorable, stable
from folioscope.sources.tables import Versioned

EVENT = "seq long, path string, title string, status string, detail string, updated double"


def arrivals(spark: SparkSession, root: str, per_batch: int = 100) -> DataFrame:
    """New PDF files below ``root`` as a stream; the checkpoint makes each file come once."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return files.filter(~ignorable(F.col("path")))


def settled(files: DataFrame, seconds: float = 2.0, tries: int = 30) -> DataFrame:
    """The files of a batch once they have stopped growing; those that still changed are read again.

    A file that never settles raises, so the batch stays open and comes again.
    """
    young = [r.path for r in files.join(stable(files, seconds).select("path"), "path", "left_anti").select("path").distinct().collect()]  # a batch's files
    reader = files.sparkSession.read.format("binaryFile")
    for _ in range(tries if young else 0):
        time.sleep(seconds)
        again = reader.load(young).select(files.columns)
        if stable(again, seconds).count() == len(young):
            return files.filter(~F.col("path").isin(young)).unionByName(again)
    if young:
        raise RuntimeError(f"still being written: {young[:3]}")
    return files


def ingest(files: DataFrame, index: Callable[[DataFrame], None], checkpoint: str, seconds: float = 2.0) -> DataStreamWriter:
    """Hands each batch of distinct, settled files to ``index``; one owner a path follows from the checkpoint."""
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: index(settled(batch.dropDuplicates(["path"]), seconds)))


def keep_states(events: DataFrame, table: Versioned, checkpoint: str) -> DataStreamWriter:
    """Upserts the newest state of each job into a table.

    A batch that is run again changes nothing: an older or equal state never replaces a newer one.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        new = job_states(batch)
        both = table.read().unionByName(new) if table.exists() else new
        newest = Window.partitionBy("job").orderBy(F.desc("updated"), F.desc("status"), F.desc("detail"))
        table.write(both.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").drop("_place"))

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(upsert)


def since(log: DataFrame, seq: int) -> DataFrame:
    """Events after a consumer's last one, in order."""
    return log.filter(F.col("seq") > seq).orderBy("seq")


def retained(log: DataFrame, keep: int = 300) -> DataFrame:
    """The newest ``keep`` events."""
    return log.orderBy(F.desc("seq")).limit(keep)


def tidied(jobs: DataFrame, existing: DataFrame) -> DataFrame:
    """Jobs whose file is still there, or that have none; one row for each path, the newest."""
    newest = Window.partitionBy(F.coalesce("path", "title")).orderBy(F.desc("updated"), F.desc("id"))
    kept = jobs.join(existing.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left").filter(F.col("_there").isNotNull() | F.col("path").isNull())
    return kept.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").drop("_there", "_place")
