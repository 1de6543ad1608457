"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute available)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_defaults, shared_path

# Bytes of text hashed at once: bounds the memory of one step inside a task.
SLICE_BYTES = 1 << 20
# Arrow batches between Spark and Python: small ones bound the memory of both sides.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 1000

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    values[_SPACE] = 0
    return values


_VALUES = {flag: _byte_values(flag) for flag in (False, True)}
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def range_hash(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order-aware hashes of the ranges ``values[first:end]``."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    size = (end - first).astype(np.uint64)
    return mix((total[end] - total[first]) * down[first] + size * np.uint64(0xA24BAED4963EE407))


class Ranges:
    """How far two places of a sequence of word hashes agree, by hashes of ranges."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.total[1:])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ranges of ``size`` values at ``a`` and at ``b`` are equal."""
        return ((self.total[a + size] - self.total[a]) * self.down[a]
                == (self.total[b + size] - self.total[b]) * self.down[b])

    def agree(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """The largest size up to ``limit`` at which the ranges that start at ``a`` and
        ``b`` (``back``: that end before them) are equal."""
        low, high = np.zeros(len(a), np.int64), np.asarray(limit, np.int64).copy()
        step = np.minimum(high, 8)  # most places part soon: widen, then halve
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            size = np.clip(step[open_], low[open_] + 1, high[open_])
            at, to = a[open_], b[open_]
            ok = self.same(at - size, to - size, size) if back else self.same(at, to, size)
            low[open_[ok]] = size[ok]
            high[open_[~ok]] = size[~ok] - 1
            grow = np.where(ok & (size == step[open_]), 2 * size, 0)
            half = (low[open_] + high[open_] + 1) // 2
            step[open_] = np.where(grow > 0, np.minimum(grow, high[open_]), half)


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + values[j: j + n]
    return mix(h)


class Words:
    """The words of a few texts: hash, row and byte range of each.

    A word is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]``.  ``first``
    holds, for each row, the number of words before it (one more entry than
    rows).
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) or
                                pa.types.is_binary(texts.type) else np.int64)
        offsets = offsets[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        size = int(offsets[-1] - offsets[0])
        self.data = (np.frombuffer(data, np.uint8, size, int(offsets[0])) if size
                     else np.zeros(0, np.uint8))
        offsets = offsets - offsets[0]
        self.offsets = offsets
        if texts.null_count:
            # bytes under a null are undefined; count them as no text
            valid = np.asarray(texts.is_valid())
            keep = np.repeat(valid, np.diff(offsets))
            self.data = np.where(keep, self.data, 0x20).astype(np.uint8)
        inside = ~_SPACE[self.data]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if size else inside
        after = np.concatenate([inside[1:], [False]]) if size else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(texts)), self.count)
        self.lower = lower

    @cached_property
    def hash(self) -> np.ndarray:
        return range_hash(_VALUES[self.lower][self.data], self.start, self.end)

    def row_end(self) -> np.ndarray:
        """For each word, the number of words up to the end of its row."""
        return np.repeat(self.first[1:], self.count)


def text_slices(batch: pa.RecordBatch, column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of at most ``limit`` bytes of text each."""
    texts = batch.column(batch.schema.get_field_index(column))
    if len(texts) == 0:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def with_end(batches: Iterator) -> Iterator:
    """The batches, then None."""
    yield from batches
    yield None


def long_array(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def settle(spark: SparkSession) -> None:
    """Session defaults; Arrow batches are made smaller, never larger."""
    apply_defaults(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if size is None or not 0 < int(size[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that survive the loss of an executor, and lets
    Spark drop the shuffle files of the plan above.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(clean)
        else:
            spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = df.sparkSession._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs on another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return (ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
            .where("below + above > 1").isEmpty())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a partition as stars: every node on the least node it reaches
    inside the partition."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([p[j] for p in parts] or [np.zeros(0, np.int64)]) for j in range(2))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    hangs = np.flatnonzero(label != np.arange(len(nodes)))
    for at in range(0, len(hangs), 100_000):
        some = hangs[at:at + 100_000]
        yield pa.record_batch([pa.array(nodes[some]), pa.array(nodes[label[some]])], ["u", "v"])


def connected_components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b; both longs).

    The result is a staged table, for ``drop_table`` when it is not needed.

    The component is the smallest node that links reach.  Alternates the large
    and small star steps until only stars are left; each step is a
    grouped minimum (combined before the shuffle) and a join, so a node with
    many links is never gathered in one task.  Each partition of the input's links
    is made a forest first: few links need no steps, and with them none of the
    driver's memory for their plans.
    """
    e = stage_table(edges.where("a is not null and b is not null and a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct().mapInArrow(_forest, "u long, v long"), name)
    while not _only_stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v"))
        large = stage_table(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct().mapInArrow(_forest, "u long, v long"))
        new = stage_table(small, name)
        drop_table(large)
        drop_table(e)
        e = new
    pairs = e.select("u", F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct()
    out = (pairs.select(F.col("u").alias("node"), "component")
           .union(roots.select("node", F.col("node").alias("component"))))
    out._staged_path = e._staged_path
    return out
