"""Running counts of chunks per topic, kept as chunks arrive.

The batch operators count the whole store at every call.  Here Spark keeps the count
of each topic as state of a stream over the stored chunk files; a micro-batch writes
only the topics it changed, under its own number, so a batch that runs again after a
failure replaces what it wrote.  The newest row of a topic is its count, and the
topics still missing are those without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.text import py_strip

COUNTS = "topic string, n_chunks long"


def run_counts(spark: SparkSession, pattern: str, table: str, checkpoint: str, *, schema="topic string",
               max_files: int = 1000) -> None:
    """Count the chunk files that are new since the last run into ``table``.

    ``pattern`` names parquet files with a ``topic`` column, each chunk stored once;
    only that column is read.  A null topic is counted as a topic.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    counts = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(pattern)
              .groupBy("topic").agg(F.count(F.lit(1)).alias("n_chunks")))
    (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).foreachBatch(write).start().awaitTermination())


def running_counts(spark: SparkSession, table: str, window: int = config.COUNT_WINDOW) -> DataFrame:
    """Counts as ``topic_counts`` gives them, from the rows of the micro-batches."""
    rows = spark.read.schema(f"{COUNTS}, batch long").parquet(table)
    return (rows.groupBy("topic").agg(F.max_by("n_chunks", "batch").alias("n_chunks"))
            .withColumn("n_capped", F.least(F.col("n_chunks"), F.lit(window)))
            .withColumn("capped", F.col("n_chunks") >= F.lit(window)))


def still_missing(topics: DataFrame, table: str) -> DataFrame:
    """Requested topics without a count: the ones to ingest."""
    wanted = topics.select(py_strip(F.col("topic")).alias("topic")).distinct()
    return wanted.join(running_counts(topics.sparkSession, table).select("topic"), "topic", "left_anti")
