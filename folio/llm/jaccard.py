"""Jaccard join of shingle sets with a count-vector R-tree.

The shingles of a document are hashed into ``GROUPS`` groups; the counts of the
groups are a point.  For any two sets the overlap is at most the sum of the
coordinate minima of their points, and for a node of the tree at most the sum of
the minima with the node's upper corner.  Pairs whose bound falls short are
dropped, the others are verified on the shingles.

Count vectors of unrelated texts of one length lie close together, so a tree
over the points alone cannot spread the work over a cluster.  Its top levels
are therefore exact sub-points: hash space is cut into more blocks than two
linked sets can differ in, so linked sets agree entirely in one block.  Each
block's content is a leaf key.  There are a quarter more blocks than that, so
linked sets share many leaves, and sets that share fewer (a common passage) are
left out.  The others that share leaves form a cluster; inside it the points are
indexed by R-trees, the bound and the shingles decide.

Equal sets are one class from the start.  Each leaf first compares its members
with its smallest class; members that this connects are not compared again, so a
group of near copies costs about one comparison a member, not all pairs.  Only
clusters that still hold several components are searched with the trees, in
tiles of bounded size.  The result is exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import (Words, connected_components, drop_table, mix, range_hash, stage_table, text_slices,
                    with_end)

SHINGLE = 3
PERCENT = 90
GROUPS = 64
TILE = 512
FANOUT = 16
_EMPTY = np.uint64(0x5851F42D4C957F2D)


def size_classes(limit: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the classes of set sizes; each is half as wide as its start."""
    bounds = [1]
    while bounds[-1] < limit:
        bounds.append(bounds[-1] * 3 // 2 + 1)
    return np.array(bounds, np.int64)


_CLASSES = size_classes()


PLANS = 64  # size classes that a leaf key can name; the last begins beyond 10^11 shingles


def block_plan(cls: int, percent: int) -> tuple[int, int]:
    """(blocks, spare) of a size class.

    Two linked sets of sizes up to ``top`` differ in at most ``r`` shingles, so
    of ``r + 1 + spare`` blocks more than ``spare`` agree.
    """
    top = int(_CLASSES[cls + 1]) - 1
    r = 2 * top * (100 - percent) // (100 + percent)
    spare = 0 if r == 0 else 1 + r // 4
    return r + 1 + spare, spare


def leaf_keys(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(leaf keys, needs) of a set, given as sorted distinct hashes.

    The keys name their plan (size class) in the lowest bits.  ``needs`` has for
    each plan how many leaves a set shares at least with a partner: more than
    ``spare`` blocks agree, and no more than its empty blocks are left out.
    """
    size = len(shingles)
    cls = int(np.searchsorted(_CLASSES, size, "right")) - 1
    plans = [cls]
    if size * 100 // percent >= _CLASSES[cls + 1]:  # a partner may be in the next class
        plans.append(cls + 1)
    content = mix(shingles)
    high = shingles >> np.uint64(32)
    out, needs = [], []
    for plan in plans:
        blocks, spare = block_plan(plan, percent)
        block = (high * np.uint64(blocks)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        salt = np.uint64((plan + 1) * 0x9FB21C651E98DF25 % (1 << 64))
        keys = mix(np.add.reduceat(content, first) + mix(block[first] + salt))
        empty = blocks - len(first)
        if empty > spare:  # partners may agree in nothing but empty blocks
            none = np.setdiff1d(np.arange(blocks, dtype=np.uint64), block[first])
            keys = np.concatenate([keys, mix(_EMPTY + mix(none + salt))])
            empty = 0
        out.append((keys & ~np.uint64(PLANS - 1)) | np.uint64(plan % PLANS))
        needs.append((plan % PLANS, spare + 1 - empty))
    return np.concatenate(out), needs


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (upper case A-Z folded)."""
    words = Words(texts, lower=True)
    n = len(words.hash)
    at = np.arange(max(0, n - shingle + 1))
    grams = range_hash(words.hash, at, at + shingle)
    for i in range(len(texts)):
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        if hi - lo >= shingle:
            yield np.unique(grams[lo:hi - shingle + 1])
        elif hi > lo:
            yield range_hash(words.hash[lo:hi], np.array([0]), np.array([hi - lo]))
        else:
            yield np.zeros(0, np.uint64)


def set_class(shingles: np.ndarray) -> int:
    """The hash of a whole set."""
    h = range_hash(shingles, np.array([0]), np.array([len(shingles)]))
    return int(h.view(np.int64)[0])


def _text(part: pa.RecordBatch) -> pa.Array:
    return part.column(part.schema.get_field_index("text"))


def _sizes(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = list(shingle_sets(_text(part), shingle))
                needs = [[{"plan": p, "need": k} for p, k in leaf_keys(s, percent)[1]] if len(s) else None
                         for s in sets]
                yield pa.record_batch(
                    [part.column(part.schema.get_field_index("doc_id")),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_class(s) if len(s) else None for s in sets], pa.int64()),
                     pa.array(needs, pa.list_(pa.struct([("plan", pa.int32()), ("need", pa.int64())])))],
                    ["doc_id", "n", "cls", "needs"])
    return run


def _leaves(shingle: int, percent: int, memory: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies met in this task give no new rows
        for batch in batches:
            for part in text_slices(batch):
                keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for s in shingle_sets(_text(part), shingle):
                    if not len(s):
                        continue
                    cls = set_class(s)
                    if cls in seen:
                        continue
                    if len(seen) >= memory:
                        seen.clear()
                    seen.add(cls)
                    k = leaf_keys(s, percent)[0]
                    keys.append(k)
                    owners.append(np.full(len(k), cls, np.int64))
                yield pa.record_batch(
                    [pa.array(np.concatenate(keys).view(np.int64), pa.int64()),
                     pa.array(np.concatenate(owners), pa.int64())], ["leaf", "cls"])
    return run


def _points(shingle: int, groups: int, memory: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - (groups - 1).bit_length())
        seen: set[int] = set()  # a repeated row gives no second point in this task
        for batch in batches:
            for part in text_slices(batch):
                wanted = part.column(part.schema.get_field_index("wanted")).to_pylist()
                cls, n, counts, shingles = [], [], [], []
                for want, s in zip(wanted, shingle_sets(_text(part), shingle)):
                    if not len(s) or want in seen or set_class(s) != want:
                        continue
                    if len(seen) >= memory:
                        seen.clear()
                    seen.add(want)
                    cls.append(want)
                    n.append(len(s))
                    counts.append(np.bincount((mix(s) >> shift).astype(np.int64), minlength=groups)
                                  .astype(np.int32))
                    shingles.append(s.view(np.int64))
                yield pa.record_batch(
                    [pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(counts, pa.list_(pa.int32())),
                     pa.array(shingles, pa.list_(pa.int64()))], ["cls", "n", "counts", "shingles"])
    return run


class CountTree:
    """An R-tree over count vectors, packed in order of size and coordinates."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, fanout: int = FANOUT):
        self.order = np.lexsort((*counts.T[:3], sizes))
        self.fanout = fanout
        level = (counts[self.order], sizes[self.order])
        self.levels = [level]
        while len(level[1]) > 1:
            cut = np.arange(0, len(level[1]), fanout)
            # the upper corner bounds the overlap, the least size the overlap that is needed
            level = (np.maximum.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut))
            self.levels.append(level)

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Indexes of the points whose overlap with ``point`` may be large enough."""
        nodes = np.array([0])
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            if depth < len(self.levels) - 1:
                nodes = (nodes[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                nodes = nodes[nodes < len(least)]
            overlap = np.minimum(corner[nodes], point).sum(1)
            nodes = nodes[(100 + percent) * overlap >= percent * (size + least[nodes])]
            if not len(nodes):
                break
        return self.order[nodes]


def _search_tiles(percent: int):
    """Links that join components, found in each (cluster, left, right) run of two tiles.

    The points of the right tile are indexed, those of the left tile searched.
    Pairs already connected are not compared, so a run returns fewer links than
    it has rows.
    """
    names = ["cluster", "left", "right"]

    def links(rows: pa.Table) -> tuple[list, list]:
        cls = rows["cls"].to_numpy()
        tile = rows["tile"].to_numpy()
        sizes = rows["n"].to_numpy()
        counts = np.stack(rows["counts"].to_numpy()).astype(np.int64)
        sets = rows["shingles"].combine_chunks()
        _, up = np.unique(rows["component"].to_numpy(), return_inverse=True)
        up = up.tolist()  # union-find over the components
        comp = list(up)
        up = list(range(max(up) + 1))

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        i, j = rows["left"][0].as_py(), rows["right"][0].as_py()
        right = np.flatnonzero(tile == j)
        tree = CountTree(counts[right], sizes[right])
        a, b = [], []
        for x in np.flatnonzero(tile == i).tolist():
            own = None
            for y in right[tree.search(counts[x], int(sizes[x]), percent)].tolist():
                rx, ry = root(comp[x]), root(comp[y])
                if rx == ry:
                    continue
                if own is None:
                    own = sets[x].values.to_numpy()
                both = len(np.intersect1d(own, sets[y].values.to_numpy(), True))
                if 100 * both >= percent * (len(own) + int(sizes[y]) - both):
                    up[max(rx, ry)] = min(rx, ry)
                    a.append(cls[x])
                    b.append(cls[y])
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in with_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                rest = table if rest is None else pa.concat_tables([rest, table])
            if rest is None or not rest.num_rows:
                continue
            keys = np.stack([rest[c].to_numpy() for c in names], 1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            ends = cut if batch is None else cut[:-1]  # the last run may go on
            for lo, hi in zip(ends[:-1], ends[1:]):
                a, b = links(rest.slice(lo, hi - lo))
                if a:
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                          ["a", "b"])
            rest = rest.slice(ends[-1])
    return run


def _tiles(open_rows: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """(cluster, left, right, tile, cls, component): the tile pairs that need a search.

    A component larger than a tile has tiles of its own, the others share tiles.
    Two tiles of one component need no search, so a large group that is already
    connected is compared with what is left of its cluster only.

    ``open_rows`` must be a staged table; the rows with their tiles are staged too and
    given first, for ``drop_table``.  In one plan of all steps each table would stand
    many times, and the driver's memory would go into plans and broadcasts.
    """
    large = (open_rows.groupBy("cluster", "component").agg(F.count("*").alias("size"))
             .where(F.col("size") > tile).select("cluster", "component", F.lit(True).alias("large")))
    rows = (open_rows.join(large, ["cluster", "component"], "left")
            .withColumn("pure", F.when(F.col("large"), F.col("component"))).drop("large"))
    pools = (rows.groupBy("cluster", "pure")
             .agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    rows = (rows.join(pools.withColumnRenamed("cluster", "c2").withColumnRenamed("pure", "p2"),
                      (F.col("cluster") == F.col("c2")) & F.col("pure").eqNullSafe(F.col("p2")))
            .withColumn("tile", F.xxhash64("pure", F.pmod(F.xxhash64("cls"), F.col("parts"))))
            .select("cluster", "pure", "tile", "cls", "component"))
    rows = stage_table(rows, "tiled")
    tiles = rows.select("cluster", "pure", "tile").distinct()
    other = tiles.select("cluster", F.col("pure").alias("pure2"), F.col("tile").alias("tile2"))
    pairs = (tiles.join(other, "cluster")
             .where("tile <= tile2 and not (pure is not null and pure <=> pure2)")
             .select("cluster", F.col("tile").alias("left"), F.col("tile2").alias("right")))
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("left", "right"))).alias("tile"))
    return rows, rows.drop("pure").join(sides, ["cluster", "tile"])


def _verified(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: bound first, then the shingles."""
    def side(name, *cols):
        return points.select(F.col("cls").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols])

    likely = (pairs.join(side("a", "n", "counts"), "a").join(side("b", "n", "counts"), "b")
              .where(F.expr(f"{100 + percent} * aggregate(zip_with(counts_a, counts_b, "
                            f"(x, y) -> least(x, y)), 0, (s, x) -> s + x) >= {percent} * (n_a + n_b)"))
              .select("a", "b"))
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return (likely.join(side("a", "n", "shingles"), "a").join(side("b", "n", "shingles"), "b")
            .withColumn("both", both)
            .where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both")))
            .select("a", "b").distinct())


def _shared(leaves: DataFrame) -> DataFrame:
    """``members(leaf, cls, head)`` of the leaves that several sets have; ``head`` is the least.

    Leaves are most of what a search writes, so they are dealt out by leaf once: the
    aggregate, the join and the distinct rows all keep to that one shuffle.
    """
    leaves = leaves.repartition("leaf")
    heads = (leaves.groupBy("leaf").agg(F.min("cls").alias("head"), F.max("cls").alias("last"))
             .where("head < last").select("leaf", "head"))
    return leaves.join(heads.hint("merge"), "leaf").distinct()


def _supported(members: DataFrame, needs: DataFrame, rounds: int = 3) -> DataFrame:
    """``members(leaf, cls, head)`` without the sets that share too few leaves with others.

    Linked sets share at least ``need`` leaves of a plan, so they keep each other at
    every round, while sets that share a common passage only fall away.
    """
    plan = F.col("leaf").bitwiseAND(PLANS - 1).cast("int")
    for _ in range(rounds):
        before = members.count()
        enough = (members.groupBy("cls", plan.alias("plan")).agg(F.count("*").alias("shared"))
                  .join(needs, ["cls", "plan"]).where("shared >= need").select("cls", "plan"))
        left = members.select("leaf", "cls", plan.alias("plan")).join(enough, ["cls", "plan"]).select("leaf", "cls")
        heads = (left.groupBy("leaf").agg(F.min("cls").alias("head"), F.max("cls").alias("last"))
                 .where("head < last").select("leaf", "head"))
        new = stage_table(left.join(heads, "leaf"), "members")
        drop_table(members)
        members = new
        if members.count() > 0.9 * before:
            break
    return members


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                   tile: int = TILE, groups: int = GROUPS) -> DataFrame:
    """Components of documents whose shingle sets have Jaccard >= percent/100.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Words are
    runs of bytes other than white space, A-Z lower-cased; a text with fewer
    words than a shingle is one shingle.  Null, empty and blank texts have an
    empty set and link with nothing.  Equal sets are linked.  Every input row
    gives one row, repeated rows too; rows with a null ``doc_id`` take part in
    nothing and are their own (null) component.  An empty table gives an empty
    result.  ``percent`` must be at least 67.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable).
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must lie between 67 and 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    ids = stage_table(docs.mapInArrow(_sizes(shingle, percent), "doc_id long, n long, cls long, "
                                      "needs array<struct<plan: int, need: long>>"), "sets")
    classes = (ids.where("doc_id is not null and cls is not null")
               .groupBy("cls").agg(F.min("doc_id").alias("doc_id")))
    needs = (ids.where("doc_id is not null and cls is not null").groupBy("cls").agg(F.first("needs").alias("needs"))
             .select("cls", F.inline("needs")))

    members = stage_table(_shared(known.select("text").mapInArrow(_leaves(shingle, percent), "leaf long, cls long")),
                          "members")
    members = _supported(members, needs)

    wanted = members.select("cls").distinct().join(classes, "cls")
    points = stage_table(
        known.join(wanted.select("doc_id", F.col("cls").alias("wanted")), "doc_id")
        .select("wanted", "text")
        .mapInArrow(_points(shingle, groups), "cls long, n long, counts array<int>, shingles array<long>"),
        "points")
    if not points.groupBy("cls").count().where("count > 1").isEmpty():  # a row that occurs in several tasks
        several = points
        points = stage_table(points.dropDuplicates(["cls"]), "points")
        drop_table(several)

    star = (members.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b"))
            .distinct())
    links = stage_table(_verified(star, points, percent), "star")

    # classes that share leaves form a cluster; those in several components are searched
    parts = connected_components(links, "part")
    clusters = connected_components(star, "clusters")
    part = parts.withColumnRenamed("node", "cls")
    cluster = clusters.select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
    rows = stage_table(cluster.join(part, "cls", "left")
                       .select("cluster", "cls", F.coalesce("component", "cls").alias("component")), "rows")
    spread = (rows.groupBy("cluster").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                          F.count("*").alias("size"))
              .where("lo < hi and size > 2").select("cluster"))  # a pair has been compared
    open_rows = stage_table(rows.join(spread, "cluster"), "open")
    keys = ["cluster", "left", "right"]
    tiled, sides = _tiles(open_rows, tile)
    tiles = sides.join(points, "cls").select(*keys, "tile", "cls", "component", "n", "counts", "shingles")
    more = stage_table(tiles.repartition(*keys).sortWithinPartitions(*keys)
                       .mapInArrow(_search_tiles(percent), "a long, b long"), "more")

    found = connected_components(links.unionByName(more), "linked")
    for done in (members, points, links, parts, clusters, rows, open_rows, tiled, more):
        drop_table(done)
    least = (found.join(classes.withColumnRenamed("cls", "node"), "node")
             .groupBy("component").agg(F.min("doc_id").alias("component_id")))
    labels = (classes.join(found.withColumnRenamed("node", "cls"), "cls", "left")
              .join(least, "component", "left")
              .select("cls", F.coalesce("component_id", "doc_id").alias("component_id")))
    return (ids.join(labels, "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
                    .alias("component_id")))
