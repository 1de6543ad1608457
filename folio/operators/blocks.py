"""Two tables of any size met block by block.

``pack`` cuts a table into blocks of some megabytes, a row each, in the shared
folder; ``meet`` pairs the blocks that share a key by a replicated nested loop: a
task reads a part of either table again instead of getting a copy by shuffle, so
what is written grows with the tables and not with their product, a frequent key
is spread over all tasks, and nothing passes through the driver.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path

BLOCK_BYTES = 4 << 20
FILE_BLOCKS = 16  # a file is one unit of a scan: at most about 64 MB
_SCHEMA = "name string, keys array<string>, dim int, block binary"


def pack(df: DataFrame, key: str, vector: str, name: str, rows: int = 1 << 20) -> DataFrame:
    """Blocks ``(name, keys, dim, block)`` of at most about ``rows`` rows: the strings of
    ``key`` found in one, the length of its longest ``vector``, and its rows as an
    Arrow stream.  Rows without a key are left out; the order in a partition stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            at = batch.schema.get_field_index
            dim = pc.max(pc.list_value_length(batch.column(at(vector)))).as_py() or 0
            return pa.record_batch([pa.array([uuid.uuid4().hex]),
                                    pa.array([pc.unique(batch.column(at(key))).to_pylist()], pa.list_(pa.string())),
                                    pa.array([dim], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                   ["name", "keys", "dim", "block"])

        for batch in batches:
            step = max(1, min(rows, BLOCK_BYTES * batch.num_rows // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                n += held[-1].num_rows
                if n >= step:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    # not compressed: a scan's parts then have the size in memory
    (df.where(F.col(key).isNotNull()).mapInArrow(run, _SCHEMA)
     .write.option("maxRecordsPerFile", FILE_BLOCKS).option("compression", "none").parquet(path))
    out = spark.read.schema(_SCHEMA).parquet(path)
    out._written_path = path  # for ``session.drop_shared``
    return out


def longest(blocks: DataFrame) -> int:
    """The length of the longest vector of packed rows, 1 at least."""
    return max(1, blocks.agg(F.max("dim")).first()[0] or 1)


def _rows_of(block: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(block.as_py()).read_next_batch()  # a copy: the pairs' buffers can go


def meet(rows: DataFrame, queries: DataFrame, open_rows: Callable, open_queries: Callable, schema) -> DataFrame:
    """Every block of ``rows`` goes to every block of ``queries`` that shares a key.

    A task opens each block of its queries once, ``open_queries(batch)``, calls ``add``
    of it with the opened blocks of rows, in their order, and at its end returns what
    ``result`` of it gives, a record batch or ``None``.  The rows are cut into few
    parts where the queries are many, so results grow with the queries.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, last, now = {}, None, None
        for batch in batches:
            for row_name, row_block, name, block in zip(*batch.columns):
                if row_name.as_py() != last:
                    last, now = row_name.as_py(), open_rows(_rows_of(row_block))
                if name.as_py() not in asked:
                    asked[name.as_py()] = open_queries(_rows_of(block))
                asked[name.as_py()].add(now)
        for one in asked.values():
            out = one.result()
            if out is not None:
                yield out

    slots = rows.sparkSession.sparkContext.defaultParallelism
    parts = math.ceil(4 * slots / max(1, queries.rdd.getNumPartitions()))
    left = rows.coalesce(parts).select("keys", F.col("name").alias("row_name"), F.col("block").alias("row_block"))
    right = queries.select(F.col("keys").alias("query_keys"), "name", "block")
    return (left.hint("shuffle_replicate_nl").crossJoin(right).where(F.arrays_overlap("keys", "query_keys"))
            .select("row_name", "row_block", "name", "block").mapInArrow(run, schema))
