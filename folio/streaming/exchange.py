"""Prompts and responses as two streams.

A response may come in a later micro-batch than its prompt, or before it.  Spark's
state store keeps what still waits; watermarks bound it: a prompt waits ``wait``
for its response, rows later than ``delay`` behind the newest are dropped.  A prompt
that gets none is given out without one when its time is over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip

PROMPTS = "prompt_id string, topic string, kind string, text string, at timestamp"
RESPONSES = "prompt_id string, text string, at timestamp"
DELAY, WAIT = "10 minutes", "1 hour"
CLOSING = ""  # prompt_id of a closing row


def write_in_order(df: DataFrame, path: str, time: str, files: int) -> None:
    """Append ``df`` in ``files`` steps of rising time, as a source would, then two closing
    rows far behind: the first moves the watermark, the second lets open waits end."""
    low, high = df.agg(F.min(F.unix_timestamp(time)), F.max(F.unix_timestamp(time))).first()
    low, high = low or 0, high or 0
    step = (high - low) // files + 1
    number = F.floor((F.unix_timestamp(time) - low) / step)
    for i in range(files):
        df.where(number == i).coalesce(1).write.mode("append").parquet(path)
    for days in (10, 20):
        end = F.timestamp_seconds(F.lit(high + days * 86_400))
        closing = df.sparkSession.range(1).select(*(
            end.alias(c) if c == time else F.lit(CLOSING if c == "prompt_id" else None).cast(t).alias(c)
            for c, t in df.dtypes))
        closing.write.mode("append").parquet(path)


def exchange_stream(prompts: DataFrame, responses: DataFrame, *, delay: str = DELAY, wait: str = WAIT) -> DataFrame:
    """``operators.lessons.exchange`` for streams: every prompt with the response of its
    ``prompt_id`` given within ``wait``, or null."""
    p = prompts.withWatermark("at", delay)
    r = (responses.select(F.col("prompt_id").alias("_id"), py_strip(F.col("text")).alias("response"),
                          F.col("at").alias("answered")).withWatermark("answered", delay))
    waits = (F.col("prompt_id") == F.col("_id")) & (F.col("answered") >= F.col("at")) & \
        (F.col("answered") <= F.col("at") + F.expr(f"INTERVAL {wait}"))
    return p.join(r, waits, "left_outer").drop("_id")


def run_exchange(spark: SparkSession, prompts: str, responses: str, sink: str, state: str, *,
                 files_per_batch: int = 1, delay: str = DELAY, wait: str = WAIT) -> DataFrame:
    """Join what lies in two folders (new files only) into ``sink`` and read it back.

    ``state`` keeps offsets and open waits, so a run that starts again goes on where
    the last one ended and gives nothing twice.
    """
    def source(path: str, schema: str) -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    joined = exchange_stream(source(prompts, PROMPTS), source(responses, RESPONSES), delay=delay, wait=wait)
    # closing rows go into the sink too: a filter here would be pushed below the watermark
    query = (joined.writeStream.format("parquet").outputMode("append")
             .option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema("prompt_id string, topic string, kind string, text string, at timestamp, "
                             "response string, answered timestamp").parquet(sink).where(F.col("prompt_id") != CLOSING)
