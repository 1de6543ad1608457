"""Benchmark decontamination by latent semantic retrieval.

Passages (overlapping word windows of every document) and the windows of all
benchmark items are TF-IDF vectors over hashed words.  A randomised singular
value decomposition of the corpus passages, distributed over its tasks, gives
the latent space.  Items shorter than a passage are met by passages of their own
length at every word.  In the latent space, passages within a cosine of an item's window are
candidates; they are kept if the longest common subsequence of the item and the
text around the passage covers enough of the item and the item's answer (its
last words) is there too.

Document frequencies and the decomposition cover all passages.  The tables that
tasks get are as large as the benchmark, which is read in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import _VALUES, Words, range_hash, text_slices

BITS = 16  # hashed vocabulary
WINDOW = 12  # words of a passage
STRIDE = 4
RANK = 24
EXTRA = 8  # more random directions than the rank
COMMON = 0.05  # words in more of the passages are left out of the latent space, but see TELLING
COSINE = 0.75
OVERLAP = 0.5  # of the telling words of an item's window that a candidate must have
TELLING = 4  # words not left out that a window needs, unless its item has no such window;
# items with fewer keep all their words
KNOWN = 0.65  # of a passage's squared length that words of the benchmark must hold
SHARE = 0.6  # of the item's words in the longest common subsequence
ANSWER = 6  # last words of an item
ANSWER_SHARE = 0.5
BLOCK_ITEMS = 2000
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]{}|*#$%&"]] = True


class Bag:
    """Words of a few texts without case and outer punctuation: identity and bucket."""

    def __init__(self, texts: pa.Array):
        words = Words(pc.utf8_lower(texts), lower=True)
        start, end, data = words.start.copy(), words.end.copy(), words.data
        for edge, step in ((end, -1), (start, 1)):
            at = np.arange(len(edge))
            while len(at):  # words that still end (begin) with punctuation
                at = at[(end[at] - start[at] > 1) & _TRIM[data[edge[at] - (step < 0)]]]
                edge[at] += step
        self.id = range_hash(_VALUES[True][data], start, end)
        self.bucket = (self.id >> np.uint64(64 - BITS)).astype(np.int64)
        self.first, self.row, self.count = words.first, words.row, words.count


def windows_of(bag: Bag, stride: int, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First and end words of the windows; the last window of a text ends it."""
    n = bag.count
    steps = np.where(n > width, -(-(n - width) // stride) + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), steps)
    k = np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)
    start = bag.first[:-1][row] + np.minimum(k * stride, np.maximum(n[row] - width, 0))
    return start, np.minimum(start + width, bag.first[1:][row])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the number of passages with each bucket, and of all passages."""
    counts = np.zeros((1 << BITS) + 1, np.int64)
    for batch in batches:
        for part in text_slices(batch):
            bag = Bag(part.column(part.schema.get_field_index("text")))
            # passages here do not overlap; a word counts once in each
            place = np.arange(len(bag.id)) - bag.first[bag.row]
            new = np.ones(len(bag.id), bool)
            for k in range(1, WINDOW):
                new[k:] &= (bag.bucket[k:] != bag.bucket[:-k]) | (place[k:] % WINDOW < k)
            counts[:-1] += np.bincount(bag.bucket[new], minlength=1 << BITS)
            counts[-1] += int((place % WINDOW == 0).sum())
    at = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["bucket", "n"])


def inverse_frequency(counts: dict[int, int]) -> np.ndarray:
    total = counts.get(1 << BITS, 0)
    seen = np.zeros(1 << BITS)
    for k, n in counts.items():
        if k < 1 << BITS:
            seen[k] = n
    return np.log((total + 1) / (seen + 1)) + 1e-3


def _sketch(idf: np.ndarray, slot: np.ndarray, width: int):
    """Per task: the rows of A'A W for a random W, by one pass over its passages.

    ``slot`` numbers the buckets of the benchmark's words (-1: others); only
    those columns of A matter for its items.
    """
    size = int(slot.max()) + 1
    random = np.random.default_rng(11).standard_normal((size + 1, width)).astype(np.float32)
    random[size] = 0  # words that no item has
    weight_of = np.zeros(size + 1, np.float32)
    weight_of[slot[slot >= 0]] = idf[slot >= 0]
    weighted = random * weight_of[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, width))
        for batch in batches:
            for part in text_slices(batch):
                bag = Bag(part.column(part.schema.get_field_index("text")))
                at = np.flatnonzero(slot[bag.bucket] >= 0)
                if not len(at):
                    continue
                s = slot[bag.bucket[at]]
                passage = (bag.row[at].astype(np.int64) << 24) + (at - bag.first[bag.row[at]]) // WINDOW
                cut = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                y = np.add.reduceat(weighted[s], cut)
                of = np.repeat(np.arange(len(cut)), np.diff(np.concatenate([cut, [len(at)]])))
                order = np.argsort(s, kind="stable")
                s = s[order]
                cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                out[s[cut]] += np.add.reduceat(y[of[order]], cut) * weight_of[s[cut], None]
        filled = np.flatnonzero(np.abs(out).sum(1))
        yield pa.record_batch([pa.array(filled), pa.array(list(out[filled]), pa.list_(pa.float64()))],
                              ["slot", "row"])
    return run, random[:size]


def latent_basis(sketch: np.ndarray, random: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular directions of A from A'A W (Nystroem form)."""
    if not np.abs(sketch).sum():
        return np.eye(len(sketch), min(rank, len(sketch)))
    core = random.T.astype(float) @ sketch
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    good = value > value.max() * 1e-9
    half = sketch @ (vector[:, good] / np.sqrt(value[good]))
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    return left[:, :rank]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel over ``a``)."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Index:
    """The windows of benchmark items in the latent space."""

    def __init__(self, ids: list[int], texts: pa.Array, idf: np.ndarray):
        self.ids = ids
        self.bag = Bag(texts)
        self.idf = idf
        rare = idf[self.bag.bucket] >= np.log(1 / COMMON)
        poor = np.bincount(self.bag.row[rare], minlength=len(ids)) < TELLING
        used = np.unique(self.bag.bucket[rare | poor[self.bag.row]])
        self.slot = np.full(1 << BITS, -1, np.int64)
        self.slot[used] = np.arange(len(used))
        self.known = np.zeros(1 << BITS, bool)  # words of the items, common ones too
        self.known[self.bag.bucket] = True
        self.start, self.end = windows_of(self.bag, 1)
        self.basis = self.unit = None

    def lengths(self, bag: Bag, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Squared lengths of the windows' TF-IDF vectors, and of their part in the items' words."""
        weight = self.idf[bag.bucket]
        known = self.known[bag.bucket]
        square = np.concatenate([[0], np.cumsum(weight * weight)])
        inside = np.concatenate([[0], np.cumsum(weight * weight * known)])
        return square[end] - square[start], inside[end] - inside[start]

    def latent(self, bag: Bag, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros((len(start), self.basis.shape[1]), np.float32)
        table = np.concatenate([self.basis, np.zeros((1, self.basis.shape[1]))]).astype(np.float32)
        for k in range(WINDOW):
            at = start + k
            ok = at < end
            b = bag.bucket[np.minimum(at, len(bag.bucket) - 1)]
            out += table[self.slot[b]] * (self.idf[b] * ok)[:, None].astype(np.float32)
        return out

    def finish(self, basis: np.ndarray) -> None:
        self.basis = basis
        v = self.latent(self.bag, self.start, self.end)
        norm = np.linalg.norm(v, axis=1)
        total = np.concatenate([[0], np.cumsum(self.slot[self.bag.bucket] >= 0)])
        telling = total[self.end] - total[self.start]
        item = self.bag.row[self.start]
        best = np.zeros(len(self.ids), np.int64)
        np.maximum.at(best, item, telling)
        keep = (norm > 0) & (telling >= np.minimum(TELLING, best[item]))
        self.start, self.end, self.item = self.start[keep], self.end[keep], item[keep]
        self.need = np.ceil(OVERLAP * telling[keep]).astype(np.int64)
        self.unit = (v[keep] / norm[keep, None]).astype(np.float32)
        # passages at any offset that a window of a short item has: (width, windows)
        width = self.end - self.start
        short = self.bag.count[self.item] < WINDOW + STRIDE - 1
        self.short = [(int(n), np.flatnonzero(short & (width == n))) for n in np.unique(width[short])]


def _search(index: Index, cosine: float, share: float, answer_share: float):
    words = [index.bag.id[index.bag.first[i]:index.bag.first[i + 1]] for i in range(len(index.ids))]

    def near(bag: Bag) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item window) of the candidate passages."""
        start, end = windows_of(bag, STRIDE)
        full, inside = index.lengths(bag, start, end)
        # a passage of words that no item has cannot hold most of an item's words
        ok = inside >= KNOWN * full
        found = [alike(bag, start[ok], end[ok], np.arange(len(index.unit)))]
        # a passage may hold only a part of a short item, so those have passages of their width
        telling = np.concatenate([[0], np.cumsum(index.slot[bag.bucket] >= 0)])
        for width, windows in index.short:
            start, end = windows_of(bag, 1, width)
            ok = telling[end] - telling[start] >= index.need[windows].min()
            found.append(alike(bag, start[ok], end[ok], windows))
        at, window = zip(*found)
        return np.concatenate(at), np.concatenate(window)

    def alike(bag: Bag, start: np.ndarray, end: np.ndarray,
              windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item window) of the passages that are like one of ``windows``."""
        unit = index.unit[windows]
        at, window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(start), 512):
            s, e = start[lo:lo + 512], end[lo:lo + 512]
            v = index.latent(bag, s, e)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            close = v @ unit.T >= cosine * np.maximum(norm, 1e-30)
            some = np.flatnonzero(close.any(1))
            x, y = np.nonzero(close[some])
            x, y = some[x], windows[y]
            common = np.zeros(len(x), np.int64)
            theirs = np.minimum(index.start[y][:, None] + np.arange(WINDOW), index.end[y][:, None] - 1)
            theirs = index.bag.id[theirs]
            for k in range(WINDOW):
                own = bag.id[np.minimum(s[x] + k, e[x] - 1)]
                telling = index.slot[bag.bucket[np.minimum(s[x] + k, e[x] - 1)]] >= 0
                common += telling & (s[x] + k < e[x]) & (theirs == own[:, None]).any(1)
            ok = common >= index.need[y]
            x, y = x[ok], y[ok]
            at.append(s[x])
            window.append(y)
        return np.concatenate(at), np.concatenate(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                bag = Bag(part.column(part.schema.get_field_index("text")))
                doc_ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                found = {}
                if len(bag.id) and len(index.unit):
                    at, window = near(bag)
                    item = index.item[window]
                    offset = index.start[window] - index.bag.first[item]
                    # where the item would begin in the text
                    begin = at - offset
                    for a, i, b in sorted(set(zip(bag.row[at].tolist(), item.tolist(),
                                                  (begin // WINDOW).tolist()))):
                        want = words[i]
                        if found.get((a, i), (0,))[0] == 1.0:
                            continue
                        lo = max(bag.first[a], b * WINDOW - WINDOW)
                        hi = min(bag.first[a + 1], (b + 1) * WINDOW + len(want) * 5 // 4 + WINDOW)
                        text = bag.id[lo:hi]
                        if np.isin(want, text).sum() < share * len(want):
                            continue  # bounds the common subsequence
                        part_share = common_subsequence(want, text) / len(want)
                        if part_share < share:
                            continue
                        last = want[-ANSWER:]
                        answer = common_subsequence(last, text) / len(last)
                        if answer >= answer_share and part_share > found.get((a, i), (0,))[0]:
                            found[a, i] = (part_share, answer, int(lo - bag.first[a]))
                rows = [(doc_ids[a], index.ids[i], *v) for (a, i), v in found.items()]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.record_batch(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                     pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()),
                     pa.array(cols[4], pa.int64())],
                    ["doc_id", "item_id", "common_share", "answer_share", "first_word"])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = SHARE,
               answer_share: float = ANSWER_SHARE, rank: int = RANK,
               block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Benchmark items found in documents, one row for each document and item.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and
    ``text``; other columns are ignored.  Words are compared without case and
    outer punctuation.  An item is found where at least ``share`` of its
    words, and ``answer_share`` of its last words, are a common subsequence with
    the text.  Null, empty and blank texts and items are never found; rows with a
    null id are left out.  Repeated documents are found each by its row, repeated
    items once.  Empty tables give an empty result.

    Returns doc_id, item_id, common_share, answer_share, first_word (where the
    text that was compared begins).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .where("doc_id is not null")
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                              F.col("text").cast("string").alias("text"))
             .where(F.col("item_id").isNotNull() & F.col("text").rlike(r"[^ \t\n\r\f\x0B]"))
             .groupBy("item_id", "text").count().orderBy("item_id", "text"))
    table = (docs.select("text").mapInArrow(_frequencies, "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())  # at most 2**BITS + 1 rows
    counts = dict(zip(table["bucket"].to_pylist(), table["n"].to_pylist()))
    idf = inverse_frequency(counts)
    out = None
    block, last = [], False
    rows = items.toLocalIterator()
    while not last:
        row = next(rows, None)
        last = row is None
        if row is not None:
            block.append(row)
        if block and (last or len(block) == block_items):
            index = Index([r.item_id for r in block], pa.array([r.text for r in block]), idf)
            sketch, random = _sketch(idf, index.slot, rank + EXTRA)
            total = np.zeros(random.shape)
            # a row for each bucket of the block's words
            for r in (docs.select("text").mapInArrow(sketch, "slot long, row array<double>")
                      .groupBy("slot").agg(*[F.sum(F.col("row")[k]).alias(f"r{k}")
                                             for k in range(random.shape[1])]).collect()):
                total[r.slot] = r[1:]
            index.finish(latent_basis(total, random, rank))
            found = docs.mapInArrow(_search(index, cosine, share, answer_share),
                                    "doc_id long, item_id long, common_share double, "
                                    "answer_share double, first_word long")
            out = found if out is None else out.unionByName(found)
            block = []
    if out is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, common_share double, answer_share double, first_word long")
    return out
