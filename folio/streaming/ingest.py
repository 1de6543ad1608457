"""Incremental ingest as a Structured Streaming job.

New document files arriving in a folder are cleaned, chunked and embedded in
micro-batches and appended to a parquet chunk table, or upserted into a
chunk store.  Every stage is
row-local, so the stream keeps no state; the file sink's commit log plus the
query checkpoint give exactly-once output across restarts and lost
executors.  Topics that are already stored can be skipped with a
stream-static anti join against the store (the "ingest only what is missing"
rule).

``trigger(availableNow=True)`` processes everything present and stops, which
is how a scheduled incremental job runs; without it the query keeps running.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INGEST_CHUNKS, ChunkOptions, EmbedOptions
from ..operators.store import ChunkStore, dedup_written, materialize
from ..plans.ingest import sections_to_chunks
from ..session import shared_path
from ..sources.tables import document_sections


def document_stream(spark: SparkSession, pattern: str, schema, max_files: int = 1000) -> DataFrame:
    """File-source stream of document rows (``pattern`` may be a glob); each
    micro-batch takes at most ``max_files`` new files, so a large backlog is
    processed (and checkpointed) in bounded steps."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
                 .parquet(pattern))


def stream_chunks(docs: DataFrame, chunk_options: ChunkOptions = INGEST_CHUNKS,
                  embed_options: EmbedOptions = EmbedOptions(),
                  skip_topics: DataFrame | None = None) -> DataFrame:
    """The ingest plan on a streaming frame."""
    secs = document_sections(docs)
    if skip_topics is not None:
        secs = secs.join(skip_topics.select("topic").distinct(), "topic", "left_anti")
    return sections_to_chunks(secs, chunk_options, embed_options, ingested_at=F.lit(0))


def _upsert(store: ChunkStore, rows: DataFrame) -> None:
    rows = dedup_written(materialize(rows))
    if not rows.isEmpty():
        store.upsert(rows, materialized=True)


def run_ingest(spark: SparkSession, pattern: str, *, sink: str | None = None,
               checkpoint: str | None = None, schema=None,
               chunk_options: ChunkOptions = INGEST_CHUNKS,
               embed_options: EmbedOptions = EmbedOptions(),
               skip_topics: DataFrame | None = None, store: ChunkStore | None = None,
               timeout_s: int | None = None) -> str:
    """Run the stream until all present files are processed (however long that
    takes, unless ``timeout_s`` is given); return the sink path.  Sink and checkpoint default to fresh folders in the shared
    checkpoint folder."""
    run = uuid.uuid4().hex[:12]
    sink = sink or shared_path(spark, f"stream-{run}/chunks")
    checkpoint = checkpoint or shared_path(spark, f"stream-{run}/_checkpoint")
    if schema is None:
        schema = spark.read.parquet(pattern).schema
    chunks = stream_chunks(document_stream(spark, pattern, schema), chunk_options,
                           embed_options, skip_topics)
    stream = (chunks.writeStream.option("checkpointLocation", checkpoint)
              .trigger(availableNow=True))
    if store is not None:
        sink = store.root
        query = stream.foreachBatch(lambda rows, batch: _upsert(store, rows)).start()
    else:
        query = stream.format("parquet").outputMode("append").start(sink)
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError("streaming ingest did not finish")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return sink
