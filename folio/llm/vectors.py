"""Embedding near-dedup by a product of blocks.

Unit vectors of one label and length with cosine at least ``c`` are linked.  The
points are written once in blocks of some megabytes, and every block meets every
block of its label in place (``operators.blocks``): tasks read the blocks again, so
what is written grows with the points, not with their pairs, and a large label is
spread over all tasks.  A product in single precision, with a bound on its error,
decides all pairs but those at the limit, which are decided by their exact cosine.

Equal vectors of one label are one point from the start.  Tasks return counts and a
spanning forest of links, so neither a group of near copies nor a frequent vector
makes a row for each of its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import meet, pack
from ..session import drop_shared
from ._util import connected_components, drop_table, stage_table

COSINE = 0.98
TILE = 256  # points of a block compared at once with another block
BLOCK = 16_384  # points of a block at most


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps the squares from overflowing
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class _Part:
    """The points of one (label, dim) in an opened block."""

    def __init__(self, rows: pa.RecordBatch):
        column = lambda c: rows.column(rows.schema.get_field_index(c))
        self.row, self.point, self.size = (column(c).to_numpy(zero_copy_only=False) for c in ("row", "point", "size"))
        self.raw = column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        self.rough = unit_rows(self.raw).astype(np.float32)

    def unit(self, at: np.ndarray) -> np.ndarray:
        return unit_rows(self.raw[at])


def _parts(block: pa.RecordBatch) -> dict[str, _Part]:
    """The points of an opened block by key."""
    keys = np.array(block.column(block.schema.get_field_index("key")).to_pylist(), object)
    return {k: _Part(block.take(pa.array(np.flatnonzero(keys == k)))) for k in dict.fromkeys(keys.tolist())}


def _join(label: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Merges rows that a column of ``mask`` links, in ``label`` (the least row of each row's
    part, changed in place), and gives the part of each column."""
    far = len(label)
    while True:
        column = np.where(mask, label[:, None], far).min(0)
        least = np.where(mask, column[None, :], far).min(1)
        if not (least < label).any():
            return column
        np.minimum.at(label, label.copy(), least)  # whole parts move, not rows
        while (label[label] != label).any():
            label[:] = label[label]


class _Links:
    """A block of points and what is linked to them in the blocks that come by: counts, and
    the links of a forest."""

    def __init__(self, block: pa.RecordBatch, cosine: float, tile: int):
        self.parts, self.cosine, self.tile = _parts(block), cosine, tile
        self.counts = {k: np.zeros(len(p.row), np.int64) for k, p in self.parts.items()}
        self.a, self.b = [], []

    def add(self, other: dict[str, _Part]) -> None:
        for key, part in self.parts.items():
            if key in other:
                self._add(other[key], part, self.counts[key])

    def _add(self, rows: _Part, asks: _Part, counts: np.ndarray) -> None:
        error = np.finfo(np.float32).eps * (rows.raw.shape[1] + 8)
        own = rows.row[0] == asks.row[0]  # a block meets itself
        forest = rows.row[0] <= asks.row[0]  # of two orders of a pair of blocks one gives links
        label = np.arange(len(rows.row))
        for at in range(0, len(asks.row), self.tile):
            cols = np.arange(at, min(at + self.tile, len(asks.row)))
            rough = rows.rough @ asks.rough[cols].T
            near = rough >= self.cosine - error
            if own:
                near[cols, np.arange(len(cols))] = False
            some = np.flatnonzero(near.any(1))
            if not len(some):
                continue
            near = near[some]
            r, c = np.nonzero(near & (rough[some] < self.cosine + error))  # at the limit
            for lo in range(0, len(r), 1 << 14):
                x, y = r[lo:lo + (1 << 14)], c[lo:lo + (1 << 14)]
                near[x, y] = (rows.unit(some[x]) * asks.unit(cols[y])).sum(1) >= self.cosine
            linked = np.flatnonzero(near.any(0))
            near, cols = near[:, linked], cols[linked]
            if not len(cols):
                continue
            counts[cols] += (rows.size[some][:, None] * near).sum(0)
            if forest:
                order = np.argsort(label[some], kind="stable")
                names, first = np.unique(label[some[order]], return_index=True)
                merged = np.arange(len(names))
                column = names[_join(merged, np.logical_or.reduceat(near[order], first, axis=0))]
                to = np.arange(len(label))
                to[names] = names[merged]
                label = to[label]
                self.a.append(asks.point[cols])
                self.b.append(rows.point[column])
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            self.a.append(rows.point[moved])
            self.b.append(rows.point[label[moved]])

    def result(self) -> pa.RecordBatch | None:
        points = np.concatenate([p.point for p in self.parts.values()])
        n = np.concatenate(list(self.counts.values()))
        hit = np.flatnonzero(n)
        if not len(hit) and not self.a:
            return None
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.a, self.b))
        return pa.record_batch(
            [pa.array(np.concatenate([points[hit], a])),
             pa.array(np.concatenate([np.zeros(len(hit), np.int64), b]), mask=np.arange(len(hit) + len(a)) < len(hit)),
             pa.array(np.concatenate([n[hit], np.zeros(len(a), np.int64)]),
                      mask=np.arange(len(hit) + len(a)) >= len(hit))], ["point", "other", "n"])


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Link vectors of one label with cosine >= ``cosine`` and group them.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding`` (an array of
    numbers); other columns are ignored.  Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null label or vec_id,
    link with nothing; vectors of different lengths do not link.  Repeated rows
    are separate vectors that link; their ``vec_id`` then forms one component.
    An empty table gives an empty result.

    Returns vec_id, n_links (other vectors linked directly), component_id and
    kept (vec_id = component_id).
    """
    kind = "float" if "array<float>" in dict(vectors.dtypes)["embedding"] else "double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"),
                       F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
              & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) |
                          (F.abs(x) == float("inf")))
              & F.exists("embedding", lambda x: x != 0))
    good = v.where(usable).withColumn("label", F.xxhash64(F.col("label").cast("string")))
    points = (good.groupBy("label", "embedding")
              .agg(F.min("vec_id").alias("point"), F.count("*").alias("size")))
    points = stage_table(points.withColumn("row", F.monotonically_increasing_id()), "points")
    key = F.concat_ws(" ", "label", F.size("embedding")).alias("key")
    blocks = pack(points.select(key, "row", "point", "size", "embedding").sortWithinPartitions("key"),
                  "key", "embedding", "point-blocks", block)
    found = stage_table(meet(blocks, blocks, _parts, lambda rows: _Links(rows, cosine, tile),
                             "point long, other long, n long"), "found")
    drop_shared(blocks)
    counts = stage_table(found.where("n is not null").groupBy("point").agg(F.sum("n").alias("n")),
                         "counts")
    groups = connected_components(found.where("other is not null")
                                  .select(F.col("point").alias("a"), F.col("other").alias("b")))
    drop_table(found)
    labels = (points.select("label", "embedding", "point", "size")
              .join(counts, "point", "left")
              .join(groups.withColumnRenamed("node", "point"), "point", "left")
              .select("label", "embedding",
                      (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                      F.coalesce("component", "point").alias("component_id")))
    linked = good.join(labels, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = v.where(~F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
