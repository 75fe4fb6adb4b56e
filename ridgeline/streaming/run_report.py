"""Reports of runs while their logs grow.

A micro-batch of new lines is summed up by run (runlog.summed) and combined with what the batches before have left, so
the state is a row for each run, however long the logs are. A batch writes the state under its own number from that of the
one before it: a batch that is done again after a failure writes the same, and a restart goes on where the checkpoint is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import runlog
from ..sources import storage

#: What tells runs apart: the folder of a run's log.
RUN = "run"


def versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(path.rsplit("-", 1)[1]) for path, _ in storage.matching(spark, f"{folder.rstrip('/')}/state-*") if storage.exists(spark, f"{path}/_SUCCESS"))


def advance(spark: SparkSession, batch: DataFrame, number: int, folder: str) -> None:
    """Combine a batch with the state before it. The state of the batch before stays until the next one is there."""
    before = [v for v in versions(spark, folder) if v < number]
    found = runlog.summed(batch, [RUN])
    if before:
        found = runlog.combined(spark.read.parquet(f"{folder}/state-{before[-1]}").unionByName(found), [RUN])
    found.write.mode("overwrite").parquet(f"{folder}/state-{number}")
    for old in before[:-1]:
        storage.delete(spark, f"{folder}/state-{old}")


def follow(spark: SparkSession, logs: str, folder: str, at_once: bool = False, per_batch: int = 1000) -> StreamingQuery:
    """Keep the state of all runs whose logs lie in folders under `logs`; folder has the state and the stream's checkpoint. at_once: what is there now, and then end; per_batch: files of a batch."""
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    lines = spark.readStream.schema(runlog.LOG).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).json(logs).withColumn(RUN, run)
    writer = lines.writeStream.foreachBatch(lambda batch, number: advance(batch.sparkSession, batch, number, folder)).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if at_once else writer).start()


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """The report of each run so far; no rows before the first batch is done."""
    there = versions(spark, folder)
    if not there:
        return runlog.report(spark.createDataFrame([], f"{RUN} string, {runlog.LOG}"), [RUN])
    return runlog.finished(spark.read.parquet(f"{folder}/state-{there[-1]}"), [RUN])
